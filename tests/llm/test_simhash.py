import random
import re

import numpy as np
import pytest
import xxhash

from affinis.llm import queries, simhash


def naive_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_classes(prints, budget=4):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


TEXTS = [None, "", " \t\n", "One two", "ONE two", "été ÉTÉ one two three four", "a b c d e f g", "A  b\tc d e f\x0bg", "x " * 5000, "Z" * 200000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_plain_definition(text):
    assert simhash.fingerprint(text) == naive_print(text)


def test_trie_finds_the_components_of_all_links():
    rng = random.Random(7)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(rng.randrange(1, 6))]
    prints = sorted(set(prints))
    want = naive_classes(dict(enumerate(prints)))
    f = np.array(prints, np.uint64)
    a, b = simhash.linked(np.zeros(len(f), np.int64), np.zeros(len(f), np.int64), f)
    up = list(range(len(f)))
    for i, j in zip(a, b, strict=True):
        up[max(i, j)] = min(i, j)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    got = [root(i) for i in range(len(f))]
    assert len(a) == len(f) - len(set(want.values()))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in want for j in want)


def test_links_agree_on_two_blocks():
    rng = random.Random(5)
    for budget in (1, 4, 7):
        cuts = simhash.blocks(budget)
        assert sum(w for _, w in cuts) == 64 and len(cuts) == budget + 2
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), budget))
            assert sum(d >> lo & ((1 << w) - 1) == 0 for lo, w in cuts) >= 2


@pytest.mark.parametrize(("chunk", "listed"), [(20_000, 500_000), (2, 500_000), (2, 0)])
def test_classes_match_brute_force(spark, chunk, listed, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", listed)
    monkeypatch.setattr(simhash.forest_edges, "__defaults__", (4, chunk))
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for g in range(25):
        ws = rng.choices(vocab, k=rng.choice([3, 40, 200]))
        for _ in range(rng.randrange(1, 5)):
            copy = list(ws)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + len(rows), " ".join(copy if rng.random() < 0.6 else ws)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(5)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect()}
    prints = {i: naive_print(t) for i, t in rows}
    want = naive_classes(prints)
    assert got == {i: (prints[i], want[i]) for i in prints}
    kept = simhash.deduplicate(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).collect() == []


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    prints = {r.doc_id: naive_print(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = naive_classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, d).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(3, "a b c d e", 1), (1, "a b c d e", 2), (1, "a b c d e", 3), (None, "a b c d e", 4), (None, "p q r s t u", 5), (None, "p q r s t u", 6), (9, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.classes(docs).collect())
    assert got == sorted([("3", "1"), ("1", "1"), ("1", "1"), ("None", "1"), ("None", "None"), ("None", "None"), ("9", "8"), ("8", "8")])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.gone_id for r in kept.collect()) == [2, 3, 4, 5, 6, 8]


A, B = "one two three four five six", "other words that nothing else here has"


def test_a_text_stays_though_another_of_its_id_goes(spark):
    rows = [(3, A), (7, A), (7, B), (9, B + " "), (8, "x y z"), (8, "x y z")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, A), (7, B), (8, "x y z"), (8, "x y z")]


def test_one_text_of_a_class_stays_within_an_id(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "changed ")
    assert bin(naive_print(base) ^ naive_print(near)).count("1") <= 4
    kept = simhash.deduplicate(spark.createDataFrame([(5, base), (5, near), (6, near)], "doc_id long, text string")).collect()
    assert len(kept) == 1 and kept[0].doc_id == 5


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 5000} x{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text[::-1])], "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {i: (naive_print(t), c) for i, t, c in ((1, text, 1), (2, text + " end", 1), (3, text[::-1], 3))}
