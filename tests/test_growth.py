import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import inference, motifs
from affinis.operators.graphs import pairs_of


def brute(graphs, floor, sizes=(3, 5)):
    """All connected edge sets of 3 to 5 nodes that `floor` graphs hold, by growing one set at a time."""
    edges = sorted({e for g in graphs for e in g})
    support = lambda s: sum(s <= set(g) for g in graphs)
    seen, todo = {}, [frozenset([e]) for e in edges]
    while todo:
        s = todo.pop()
        nodes = {n for e in s for n in e}
        if s in seen or len(nodes) > sizes[1] or support(s) < floor:
            continue
        seen[s] = (len(nodes), support(s))
        todo += [s | {e} for e in edges if e not in s and nodes & set(e)]
    return {tuple(sorted(s)): (n, len(s), k) for s, (n, k) in seen.items() if n >= sizes[0]}


def grow(spark, graphs, floor, sizes=(3, 5)):
    df = spark.createDataFrame([(f"g{i:03d}", list(g)) for i, g in enumerate(graphs)], "graph_id string, edges array<struct<a:string,b:string>>")
    rows = motifs.grown(df, floor, sizes).collect()
    out = {tuple((e.a, e.b) for e in r.edges): (r.node_count, r.edge_count, r.support_count) for r in rows}
    assert len(out) == len(rows)
    return out


def random_graphs(n, conditions, edges, seed=3):
    rng = random.Random(seed)
    every = list(combinations([f"C{i:02d}" for i in range(conditions)], 2))
    core = rng.sample(every, edges)
    return [sorted({e for e in core if rng.random() < 0.7} | set(rng.sample(every, 2))) for _ in range(n)]


@pytest.mark.parametrize(("conditions", "sizes"), [(6, (3, 5)), (16, (3, 4)), (16, (3, 5))])
def test_growth_equals_brute_force(spark, conditions, sizes):
    graphs = random_graphs(70, conditions, 9)  # two words of bits
    want = brute(graphs, 20, sizes)
    assert len(want) > 5 and grow(spark, graphs, 20, sizes) == want


def test_growth_of_odd_tables(spark):
    assert grow(spark, [], 1) == {} and grow(spark, [[]] * 3, 1) == {}
    assert grow(spark, [[("a", "b")]] * 3, 1) == {}
    assert grow(spark, [[("a", "b"), ("a", "b"), ("b", "c")]] * 2 + [[("c", "d")]], 2) == {(("a", "b"), ("b", "c")): (3, 2, 2)}


def test_growth_equals_the_enumeration_at_ten_conditions(spark):
    names = [f"COND_{x}" for x in "ABCDEFGHIJ"]
    pairs = pairs_of(names)
    rng = np.random.default_rng(4)
    masks = [int(sum(1 << i for i in range(45) if rng.random() < p)) for p in rng.uniform(0.1, 0.5, 24)]
    df = spark.createDataFrame([(f"g{i}", m) for i, m in enumerate(masks)], "graph_id string, mask long")
    want = {(r.mask, r.node_count, r.edge_count, r.support_count) for r in motifs.frequent(df.select("mask"), 6).collect()}
    listed = df.select("graph_id", F.transform(motifs.motif_edges(F.col("mask")), lambda e: F.struct(e[0].alias("a"), e[1].alias("b"))).alias("edges"))
    at = {p: i for i, p in enumerate(pairs)}
    got = {(sum(1 << at[e.a, e.b] for e in r.edges), r.node_count, r.edge_count, r.support_count) for r in motifs.grown(listed, 6).collect()}
    assert len(want) > 30 and got == want


def test_redundancy_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    masks, nodes, edges = (x.tolist() for x in motifs.pattern_arrays((3, 4), tuple(f"COND_{x}" for x in "ABCDEF")))
    chosen = sorted(rng.choice(len(masks), 120, replace=False).tolist())
    rows = [(f"m{i}", masks[i], nodes[i], edges[i], [f"g{rng.integers(3)}"]) for i in chosen]
    catalog = spark.createDataFrame(rows, "motif_id string, mask long, node_count int, edge_count int, graph_ids array<string>")
    got = {r.mask: (r.is_closed, r.is_maximal, r.occurrence_class_size) for r in motifs.redundancy(catalog, [f"COND_{x}" for x in "ABCDEF"]).collect()}
    for _, m, _, _, g in rows:
        above = [r for r in rows if r[1] & m == m and r[1] != m]
        assert got[m] == (not any(r[4] == g for r in above), not above, sum(r[4] == g for r in rows))


@pytest.mark.parametrize("n", [1, 3, 8, 47])
def test_blocks_of_the_sign_bank_are_its_bits(n):
    states = list(range(2, n + 2))
    want = np.random.Generator(np.random.PCG64(20230904)).integers(0, 2, size=(1001, n), dtype=np.int8) * 2 - 1
    signs = inference.PcgSigns(tuple(states), 1001, 20230904)
    assert (inference.sign_bank(states[::-1], 1001, 20230904) == want).all()
    for block in (1, 7, 64, 1000):
        assert (np.concatenate([signs.block(i, min(i + block, 1001)) for i in range(0, 1001, block)]) == want).all()


def test_bank_is_drawn_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(inference, "FLIPS", 10)
    rows = inference.bank_frame(spark, [5, 2, 9], 33, 7).collect()
    want = inference.sign_bank([2, 5, 9], 33, 7)
    assert {(r.permutation, r.geography_code): r.sign for r in rows} == {(i + 1, s): want[i, j] for i in range(33) for j, s in enumerate((2, 5, 9))}
    with pytest.raises(ValueError, match="unique"):
        inference.bank_frame(spark, [1, 1], 3, 1)


def test_signs_in_tasks_equal_those_of_a_table(spark):
    states = spark.createDataFrame([(s,) for s in (3, 1, 7)], "geography_code int")
    table = inference.as_signs(inference.hash_signs(spark, states, 40, 11))
    assert (table.block(0, 40) == inference.HashSigns((1, 3, 7), 40, 11).block(0, 40)).all() and inference.state_list(states) == (1, 3, 7)


def test_one_job_and_blocks_of_rows_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"m{i}", s, float(rng.choice([-1, 0, 0.5, 1]))) for i in range(30) for s in range(1, 9) if rng.random() < 0.8] + [("one", 3, 0.0)]
    res = spark.createDataFrame(rows, "motif_id string, geography_code int, difference double")
    for signs in (inference.PcgSigns(tuple(range(1, 9)), 500, 5), inference.HashSigns(tuple(range(1, 9)), 500, 5)):
        read = lambda f, s=signs: sorted(map(tuple, f(res, s, ["motif_id"]).select("motif_id", "a", "b").collect()))
        with monkeypatch.context() as m:
            m.setattr(inference, "FLIPS", 64)
            got = read(inference.shared_flips)
        assert got == read(inference.block_flips) and len(got) == 31
    d = {}
    for m, s, x in rows:
        d.setdefault(m, np.zeros(8))[s - 1] = x
    n = {m: sum(r[0] == m for r in rows) for m in d}
    bank = inference.HashSigns(tuple(range(1, 9)), 500, 5).block(0, 500)
    t = {m: np.abs(inference._t_rounded(np.array([n[m]]), (bank @ x)[None], np.array([(x * x).sum()])))[0] for m, x in d.items()}
    t0 = {m: np.abs(inference._t_rounded(np.array([n[m]]), np.array([[x.sum()]]), np.array([(x * x).sum()])))[0, 0] for m, x in d.items()}
    top = np.max(list(t.values()), axis=0)
    assert got == sorted((m, int((t[m] >= t0[m]).sum()), int((top >= t0[m]).sum())) for m in d)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_replicate_support_equals_a_count(spark, batch):
    rng = np.random.default_rng(6)
    rows = [(int(rep), int(rng.integers(1 << 8)), int(rng.integers(1 << 8))) for rep in (1, 2, 4) for _ in range(9)] + [(99, 255, 255)]
    names = [(f"m{i}", int(m)) for i, m in enumerate(rng.integers(1, 1 << 5, 12))]
    graphs = spark.createDataFrame(rows, "replicate int, mask long, paired_opportunity long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.motif_id, r.replicate): r.support for r in inference.replicate_support(graphs, spark.createDataFrame(names, "motif_id string, mask long"), 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(n, rep): sum(r == rep and m & o & x == x for r, m, o in rows) for n, x in names for rep in range(1, 6)}
    none = spark.createDataFrame([], "motif_id string, mask long")
    assert inference.replicate_support(graphs, none, 5).collect() == []
