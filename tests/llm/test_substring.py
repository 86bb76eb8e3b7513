import hashlib
import random

import pytest

from affinis.llm import queries, substring


def naive(docs, size=20):
    first = {}
    for i, t in sorted(docs.items()):
        ws = (t or "").encode().split()
        for j in range(len(ws) - size + 1):
            first.setdefault(tuple(ws[j : j + size]), (i, j))
    out = {}
    for i, t in docs.items():
        ws = (t or "").encode().split()
        gone = set()
        for j in range(len(ws) - size + 1):
            if first[tuple(ws[j : j + size])] != (i, j):
                gone |= set(range(j, j + size))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def made(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(2000)]
    passages = [rng.choices(vocab, k=rng.choice([19, 20, 21, 60, 150])) for _ in range(12)]
    docs = {0: None, 1: "", 2: "a", 3: "x " * 300, 4: "a b " * 50 + "c", 5: "\t a\nb \x0b" * 40}
    for i in range(10, 120):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            ws += rng.choices(vocab, k=rng.randrange(60))
            if rng.random() < 0.6:
                p = passages[0] if rng.random() < 0.4 else rng.choice(passages)
                ws += p[rng.randrange(4) :]
        docs[i] = rng.choice([" ", "  ", "\n"]).join(ws)
    docs[200] = docs[50]
    docs[201] = docs[50]
    return docs


@pytest.mark.parametrize(("size", "bits"), [(20, 1 << 27), (20, 1 << 16), (30, 1 << 18)])
def test_same_as_brute_force(spark, size, bits):
    docs = made(size + bits)
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in docs.items()], "doc_id long, text string, at int, h1 int").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df, size, 6, bits).collect()}
    assert got == naive(docs, size)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, d).collect()} == naive(docs)


def test_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(120_000))
    part = " ".join(long.split()[70_000:70_100])
    docs = {1: long, 2: "start " + part + " end", 3: long}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df).collect()} == naive(docs)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.digests(df).collect() == []
    text = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring.deduplicate(df).collect()} == {(None, 25), (5, 0)}


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    text = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    p, q, z = text("p", 25), text("q", 30), text("z", 30)
    rows = [(None, p + " " + text("a", 40)), (None, p), (1, q), (None, text("b", 100) + " " + q), (7, z), (7, text("c", 3) + " " + z), (8, text("d", 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.deduplicate(df).collect()]
    left = {n: (gone, t) for i, n, gone, t in got}
    assert len(got) == 7 and left[130] == (30, text("b", 100)) and left[60][0] == 0
    assert sorted([left[65][0], left[25][0]]) == [0, 25]  # equal windows at one offset: one of the two goes
    assert sorted(gone for i, _, gone, _ in got if i == 7) == [0, 30]
    assert [gone for i, _, gone, _ in got if i == 1] == [0]
