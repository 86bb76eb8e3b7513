import hashlib

import pytest

from affinis.llm import mixing

NODES = {"a": 10, "b": 100, "c": 1000}


def naive_fill(budget, caps, weights):
    """Share out by weight, again and again, until nothing is left or all are full."""
    got, left, open_ = dict.fromkeys(caps, 0.0), float(budget), set(caps)
    while open_ and left > 1e-9:
        total, spent = sum(weights[k] for k in open_), 0.0
        for k in sorted(open_):
            more = min(caps[k] - got[k], left * weights[k] / total)
            got[k] += more
            spent += more
        open_ = {k for k in open_ if caps[k] - got[k] > 1e-9}
        left -= spent
    return got


@pytest.mark.parametrize("budget", [0, 9, 30, 150, 700, 1110, 5000])
@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 5.0, "b": 0.5, "c": 2.0}])
def test_shortage_goes_to_siblings(spark, budget, weights):
    rows = spark.createDataFrame([(k, NODES[k], weights[k], budget) for k in NODES], "name string, cap long, w double, budget long")
    got = {r.name: r.got for r in mixing.fill(rows, [], "name", "budget").collect()}
    want = naive_fill(budget, NODES, weights)
    assert all(want[k] - 1 < got[k] <= want[k] + 1e-6 for k in NODES)


def test_prefix_of_a_hot_leaf(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "hot", 0) for i in range(500)], "doc_id long, text string, lang string, source string, lead int")
    out = {r.doc_id: r for r in mixing.mix(docs, {}, share=1.3, epochs=2, seed=5).collect()}
    total = sum(i % 7 + 1 for i in range(500))
    rest, up = int(total * 1.3) - total, 0
    for i in sorted(range(500), key=lambda i: (int(hashlib.md5(f"5:2:{i}".encode()).hexdigest()[:10], 16), i)):
        up += i % 7 + 1
        assert out[i].mix_copies == 1 + (up <= rest)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (3, "a b", None, "s"), (None, "c d", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {(r.doc_id, r.mix_copies) for r in mixing.mix(docs, {}, share=1.0).collect()} == {(1, 0), (2, 0), (3, 1), (None, 1)}
    assert mixing.sample(docs, {}, share=1.0).columns == docs.columns
    assert mixing.mix(docs.limit(0)).collect() == []


def test_sample_takes_the_rows_that_mix_takes(spark):
    """Ids that are repeated, in one leaf and in several, ids that are null, and very long texts."""
    rows = [(i % 40, f"{i} " * (i % 9), "en" if i % 3 else None, f"s{i % 5}", i) for i in range(400)] + [(None, "n " * (i % 4), "en", "s1", 900 + i) for i in range(20)]
    rows += [(7, "w " * 300_000, "en", "s2", 990), (8, None, "en", "s1", 991), (None, None, None, None, 992)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_id long").repartition(3)
    for seed in range(3):
        copies = mixing.chosen(df, {}, 0.7, 2, seed)
        took, size = {}, {}
        for r in copies.collect():
            took.setdefault((r.doc_id, r.language, r.origin, r.n > 0), set()).add(r.copies)
            leaf = r.language, r.origin
            size[leaf] = size.get(leaf, 0) + r.copies * r.n
        assert all(len(c) == 1 for c in took.values())
        got = {}
        for r in mixing.sample(df, {}, 0.7, 2, seed).collect():
            got[r.mix_id] = got.get(r.mix_id, 0) + 1
        want = {mark: max(took[i, lang or "", s or "", bool((t or "").split())]) for i, t, lang, s, mark in rows}
        assert got == {k: v for k, v in want.items() if v}
        plan = {(r.language, r.origin): r.budget for r in mixing.budgets(copies.where("n > 0").groupBy(*mixing.LEVELS).agg(mixing.F.sum("n").alias("tokens")), {}, 0.7, 2).collect()}
        assert all(n <= plan.get(leaf, 0) for leaf, n in size.items())
