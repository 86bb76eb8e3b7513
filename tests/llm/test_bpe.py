import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from affinis.llm import bpe, queries

RANKS = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "Hello  world's\n\n été 你好 𝄞  x", "a" * 5000, "ab" * 3000 + "!?" * 900, "\x00\x1c﻿", "<|endoftext|>", "١٢٣ Ⅷ é"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_equals_the_library(text):
    e = bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache=3)
    ids = e.encode(text)
    assert ids == ENC.encode_ordinary(text or "") and e.decode(ids) == (text or "").encode()


def test_long_and_short_folds_agree():
    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(2, 60)))
        if piece not in RANKS:
            assert bpe._merge_long(piece, RANKS) == bpe.merge(piece, RANKS)


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, d).collect()}
    for doc in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = ENC.encode_ordinary(doc.text or "")
        r = got[doc.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_higher_order_fold_on_distinct_words(spark):
    words = ["the", "Thereou", " ofthst", "été", "x", "ation", "zzzzqq", "你好"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in bpe.merge_words(df, RANKS).collect()}
    assert got == {w: list(bpe.merge(w.encode(), RANKS)) for w in words}


def test_round_trip_of_tables(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "ids_of int, text string, new_0 int")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert {r.ids_of: bytes(r.decoded) for r in out} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect() == []
