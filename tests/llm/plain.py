"""Plain versions of what the operators compute with arrays."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_of(words, size):
    size = min(size, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []
