import math
import random

import pytest
from pyspark.sql import functions as F

from affinis.llm import maxscore, queries


def naive(items, qs, k=5):
    out = {}
    for q, x in qs:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in items if v != q)  # noqa: B905  zip pads with nothing
        out.update({(q, r + 1): (v, -s) for r, (s, v) in enumerate(scored[:k])})
    return out


@pytest.mark.parametrize(("dims", "spread", "block"), [(64, 120, 4096), (16, 3, 50), (5, 2**27, 7), (3, 2**28, 7)])
def test_same_as_brute_force(spark, dims, spread, block, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_BLOCK", block)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 8)
    rng = random.Random(dims)
    items = [(i, [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(300)]
    items += [(1000 + i, items[3][1]) for i in range(40)] + [(2000, [0] * dims), (2001, items[0][1][:2])]
    df = spark.createDataFrame(items, "vec_id long, weights array<long>").repartition(3)
    qs = [x for x in items if x[0] % 50 == 0]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(df.where("vec_id % 50 = 0"), df, 5).collect()}
    assert got == naive(items, qs)


def test_quantise_and_bad_vectors(spark):
    rows = [(0, [0.5, -0.001]), (50, [math.nan, 1.0]), (100, None), (150, [None, 1.0]), (200, [math.inf, 0.0]), (250, [1.0, 2.0]), (None, [1.0, 1.0]), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", maxscore.quantise(F.col("embedding")).alias("weights"))
    assert {r.vec_id: r.weights for r in df.collect()}[0] == [128, -1]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(df, df, 5).collect()}
    assert got == naive([(0, [128, -1]), (250, [256, 512]), (300, [])], [(0, [128, -1]), (250, [256, 512]), (300, [])])
    assert maxscore.top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_large_components_and_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [2.0**21, 1.0]), (50, [2.0**40, -1.0]), (7, [-(2.0**20), 3.0])], "vec_id long, embedding array<double>").select("vec_id", maxscore.quantise(F.col("embedding")).alias("weights"))
    items = [(r.vec_id, r.weights) for r in df.collect()]
    small = df.where("vec_id <> 50")
    two = [x for x in items if x[0] != 50]
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(small.where("vec_id = 0"), small, 5).collect()} == naive(two, two[:1]) == {(0, 1): (7, -(2**57) + 256 * 768)}
    with pytest.raises(Exception, match="(?i)too large|overflow|to big|int"):
        maxscore.top_k(df.where("vec_id = 0"), df, 5).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>").select(maxscore.quantise(F.col("embedding"))).collect()


def test_repeated_ids_null_ids_and_extra_columns(spark):
    items = [(0, [1, 2], "x"), (0, [1, 2], "y"), (0, [5, 0], "x"), (3, [2, 2], "x"), (3, [2, 2], "x"), (4, [9, 9], "z"), (None, [99, 99], "x")]
    df = spark.createDataFrame(items, "vec_id long, weights array<long>, query_id string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(df.where("vec_id = 0"), df, 5).collect())
    assert got == [(0, 1, 4, 45), (0, 2, 4, 27), (0, 3, 3, 10), (0, 4, 3, 10), (0, 5, 3, 6)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in queries.op1_top_k(spark, d).collect()}
    assert got == naive(items, [x for x in items if x[0] % 50 == 0])
