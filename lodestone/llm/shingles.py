"""Hashes of words and word shingles, made with array operations over many texts at once."""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import SLICE_CHARS

_U = np.uint64
#: Bytes of words, A-Z lower-cased; 0 for bytes that no word has. Bytes beyond ASCII belong to words.
_BYTES = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.multiply.accumulate(np.r_[_U(1), np.full(n, base, _U)])
    return _powers[0], _powers[1]


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text, and where they start. A hash depends on the word alone."""
    letters = _BYTES[np.frombuffer(data, np.uint8)]
    edges = np.diff(np.r_[np.int8(0), (letters != 0).view(np.int8), np.int8(0)])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverses = _powers_to(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, _U)
    np.cumsum(letters.astype(_U) * powers[: len(letters)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U)), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and how many each text has. Long texts are cut between words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = total = 0

    def flush(stop: int) -> None:
        if group:
            found, starts = _words_of(b"\n".join(group))
            bounds = np.cumsum([len(g) + 1 for g in group])
            counts[first:stop] += np.bincount(np.searchsorted(bounds, starts, "right"), minlength=len(group))
            hashes.append(found)

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if total + len(data) > 2 * SLICE_CHARS:
            flush(i)
            group, first, total = [], i, 0
            while len(data) > 2 * SLICE_CHARS:
                cut = 2 * SLICE_CHARS
                while cut < len(data) and _BYTES[data[cut]]:
                    cut += 1
                group = [data[:cut]]
                flush(i + 1)
                data, group = data[cut:], []
        group.append(data)
        total += len(data)
    flush(len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, _U), counts


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and how many each text has.

    A text of fewer than ``size`` words, but not none, has one shingle of all its words.
    """
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(words)
    padded, owners = np.r_[words, np.zeros(size, _U)], np.r_[owner, np.full(size, -1)]
    total = np.zeros(n, _U)
    for j in range(size):
        total = mix(total + np.where(owners[j : j + n] == owner, padded[j : j + n], _U(j + 1)))
    begin = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    valid = (owners[size - 1 : size - 1 + n] == owner) | (begin & (np.minimum(counts, size)[owner] < size))
    total, owner = total[valid], owner[valid]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.r_[True, (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])] if len(total) else np.zeros(0, bool)
    return total[keep], np.bincount(owner[keep], minlength=len(texts))
