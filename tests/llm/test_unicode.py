"""The codec beside the library on every code point, alone and in between, and on random texts; clashing names."""

import random

import corpus_pipeline
from lodestone.llm import bpe_codec, language_id, token_counts
from lodestone.llm.common import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = tokenizer_path("word_bpe_49k.json")


def same(texts):
    codec = bpe_codec.codec(PATH)
    wanted = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [t for t, w in zip(texts, wanted, strict=True) if codec.encode(t) != w.ids]


def test_every_code_point():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not 0x4E00 <= i < 0x9F00 and not 0xAC00 <= i < 0xD700 and not 0x20000 <= i < 0x2A000 and not 0xE0200 <= i]
    texts = ["".join(f"a{c}b1{c}2 " for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    texts += [" ".join(points[k : k + 50]) for k in range(0, len(points), 50)]
    assert same(texts) == []


def test_random_texts():
    rng = random.Random(9)
    pool = "abcXYZ  \t\n.,!?'0123456789éßİΣσςǅŒ́՘ᲉꟋꟌꟜ\U00010d50\U00016ea0\U0001246f中あ한  "
    assert same(["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]) == []


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "k"), (2, "quite other words here", "k")], "doc_id long, text string, _key string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("_found", "_bpe", "_n_tokens", "_KEY_")})
    model = language_id.train(spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string"))
    for out in (language_id.identify(docs, model), bpe_codec.digests(docs, PATH), token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")), corpus_pipeline.join_stage(spark, docs, "")):
        assert {(r._key, r._found, r._bpe, r._n_tokens, r["_KEY_"]) for r in out.collect()} == {("k", "mine", "mine", "mine", "mine")}
