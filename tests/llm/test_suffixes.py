import random

import pytest

from affinis.llm import queries, suffixes


def naive(docs, size=50):
    """Words covered by a window of `size` words found at two places."""
    seen = {}
    for i, t in docs.items():
        ws = (t or "").split()
        for j in range(len(ws) - size + 1):
            seen.setdefault(tuple(ws[j : j + size]), []).append((i, j))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                out.setdefault(i, set()).update(range(j, j + size))
    return out


def naive_later(docs, size=50):
    """Words covered by a window found earlier too, and the components of documents that share windows."""
    seen, out, up = {}, {}, {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(docs):
        ws = (docs[i] or "").split()
        for j in range(len(ws) - size + 1):
            first = seen.setdefault(tuple(ws[j : j + size]), (i, j))
            if first != (i, j):
                out.setdefault(i, set()).update(range(j, j + size))
                a, b = sorted((root(i), root(first[0])))
                up[b] = a
    return out, {i: root(i) for i in docs}


def words_of(spans):
    return {k for s in spans.split(",") if s for k in range(*map(int, s.split(":")))}


def check(rows, docs):
    later, component = naive_later(docs)
    assert {r.doc_id: words_of(r.spans) for r in rows} == naive(docs)
    assert {r.doc_id: words_of(r.later_spans) for r in rows if r.n_later} == later
    assert all(r.component_id == component[r.doc_id] and r.n_words == len(words_of(r.spans)) and r.n_later == len(words_of(r.later_spans)) for r in rows)
    assert {i for i, c in component.items() if c != i} <= {r.doc_id for r in rows}


def made():
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(3000)]
    passages = [rng.choices(vocab, k=k) for k in (49, 50, 51, 60, 70, 130, 400)]
    docs = {0: None, 1: "", 2: "a", 3: "x " * 300, 4: "a b c " * 60}
    for i in range(10, 150):
        ws = []
        for _ in range(rng.randrange(1, 4)):
            ws += rng.choices(vocab, k=rng.randrange(90))
            if rng.random() < 0.5:
                ws += passages[5] if rng.random() < 0.5 else rng.choice(passages)
        docs[i] = " ".join(ws)
    docs[200] = docs[50]
    return docs


@pytest.mark.parametrize(("bits", "block"), [(1 << 26, 40_000), (1 << 15, 40_000), (1 << 26, 1), (1 << 26, 7)])
def test_same_words_as_brute_force(spark, bits, block):
    docs = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, key string").repartition(5)
    check(suffixes.repeated_passages(df, 50, bits, block).collect(), docs)


def families(seed):
    """Texts that share pieces of 10 to 49 words in many combinations, so that few partners are neighbours in sorted order."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(5000)]
    cores = [rng.choices(vocab, k=30) for _ in range(4)] + [rng.choices(vocab, k=k) for k in (25, 40, 49)]
    sides = [[rng.choices(vocab, k=k) for _ in range(12)] for k in (10, 22)]
    docs = {}
    for i in range(320):
        ws = rng.choices(vocab, k=rng.randrange(5)) if i % 3 else []
        for _ in range(rng.randrange(1, 3)):
            ws = ws + rng.choice(sides[0]) + rng.choice(cores) + rng.choice(sides[1])
        docs[i] = " ".join(ws)
    return docs


@pytest.mark.parametrize(("seed", "block"), [(1, 40_000), (2, 50)])
def test_partners_that_are_no_neighbours(spark, seed, block):
    docs = families(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    check(suffixes.repeated_passages(df, block=block).collect(), docs)


def test_a_frequent_line_inside_a_shared_passage(spark):
    """A and C alone share 12 words and a line of 40; a third of all documents hold the line."""
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(9000)]
    line = rng.choices(vocab, k=40)
    docs = {}
    for p in range(30):
        x = rng.choices(vocab, k=12)
        docs[2 * p] = " ".join(rng.choices(vocab, k=30) + x + line + rng.choices(vocab, k=30))
        docs[2 * p + 1] = " ".join(rng.choices(vocab, k=5) + x + line + rng.choices(vocab, k=8))
    docs |= {100 + i: " ".join(rng.choices(vocab, k=60) + line + rng.choices(vocab, k=60)) for i in range(100)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = suffixes.repeated_passages(df, block=64).collect()
    assert {r.doc_id for r in rows} == set(range(60)) and all(r.n_words == 52 for r in rows)
    check(rows, docs)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check(queries.op6_suffix_array_dedup(spark, d).collect(), docs)


def test_very_long_null_and_repeated_rows(spark):
    rng = random.Random(5)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(120_000))
    part = " ".join(long.split()[70_000:70_100])
    df = spark.createDataFrame([(1, long), (2, "start " + part), (None, part), (3, None), (4, "y"), (4, "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.spans) for r in suffixes.repeated_passages(df).collect()}
    assert got == {1: (100, "70000:70100"), 2: (100, "1:101"), None: (100, "0:100")}


def test_rows_of_one_id_and_rows_without(spark):
    rng = random.Random(6)
    part, other = (" ".join("w%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(2))
    rows = [(1, part), (1, part), (1, "x " + other), (2, "y y " + other), (None, "z " + part), (None, other), (None, other), (3, "alone")]
    got = sorted((str(r.doc_id), r.spans, r.later_spans, str(r.component_id)) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "0:60", "", "1"), ("1", "1:61", "", "1"), ("2", "2:62", "2:62", "1"), ("None", "1:61", "1:61", "1"), ("None", "0:60", "0:60", "1")])
    same = spark.createDataFrame([(5, part)] * 3, "doc_id long, text string")
    assert suffixes.repeated_passages(same).collect() == []


def test_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
