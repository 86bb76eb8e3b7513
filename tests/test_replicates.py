import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.operators import glm, resample


def person_rows(n=500, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        answers = [None if rng.random() < 0.1 else float(rng.random() < p) for p in (0.4, 0.5, 0.3)]
        out.append((f"g{i % 3}", 1 + (i % 3) // 2, int(i % 4), int(rng.integers(15)), float(rng.random() + 0.1), *answers))
    return out


SCHEMA = "graph_id string, state_code int, survey_strata int, survey_psu int, survey_weight double, A double, B double, C double"


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("parts", [1, 6])
def test_sums_do_not_depend_on_batches(spark, batch, parts):
    rows = person_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    draws = resample.random_draws(df, 270, 9)  # two chunks
    times = np.zeros((3, 4, 15, 270))
    for r in draws.collect():
        for rep, t in zip(r.reps, r.times, strict=True):
            times[r.state_code, r.survey_strata, r.survey_psu, r.chunk * resample.CHUNK + rep] += t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.graph_id, r.source_condition, r.target_condition, r.replicate): r.phi for r in resample.phi_of_draws(df, draws, ["A", "B", "C"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * 3 * 270
    for g in ("g0", "g1", "g2"):
        for i, j in ((0, 1), (0, 2), (1, 2)):
            own = [r for r in rows if r[0] == g and r[5 + i] is not None and r[5 + j] is not None]
            w = np.array([r[4] * times[r[1], r[2], r[3]] for r in own])
            a, b = (np.array([r[5 + k] for r in own])[:, None] for k in (i, j))
            pa_, pb, pab = (w * a).sum(0) / w.sum(0), (w * b).sum(0) / w.sum(0), (w * a * b).sum(0) / w.sum(0)
            want = (pab - pa_ * pb) / np.sqrt(pa_ * (1 - pa_) * pb * (1 - pb))
            assert np.allclose([got[g, "ABC"[i], "ABC"[j], k + 1] for k in range(270)], want, atol=1e-9)


def test_a_psu_that_no_replicate_draws_adds_nothing(spark):
    rows = [("g", 1, 0, p, 1.0, float(p % 2), float(p < 3), 1.0) for p in range(5)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    draws = spark.createDataFrame([(1, 0, p, 1, 1) for p in (0, 1, 3, 4)], "state_code int, survey_strata int, survey_psu int, replicate int, times int")
    got = {(r.source_condition, r.target_condition): r.phi for r in resample.replicate_phi(df, draws, ["A", "B", "C"]).collect()}
    a, b = np.array([0, 1, 1, 0.0]), np.array([1, 1, 0, 0.0])
    assert got["A", "B"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["A", "C"] is None


def test_cells_are_shuffled_once_a_chunk(spark):
    df = spark.createDataFrame(person_rows(), SCHEMA)
    draws = resample.random_draws(df, 200, 9)
    seen = []

    def finish(graph, part, columns, sums):
        seen.append(graph)
        yield pa.RecordBatch.from_arrays([pa.array([graph]), pa.array([float(sums.sum())])], ["g", "s"])

    cells = resample.association.masked(df, ["A", "B", "C"]).select("graph_id", *resample.DESIGN, "case_mask", "seen_mask", df.survey_weight.alias("w"))
    out = {r.g: r.s for r in resample.over_replicates(cells, draws, ["case_mask", "seen_mask"], finish, "g string, s double").collect()}
    assert set(out) == {"g0", "g1", "g2"} and all(v > 0 for v in out.values())


def test_numbers_of_patterns():
    columns = [pa.array([1, 2, 1, None, 2, None]), pa.array(["a", "a", "a", "b", "a", "b"])]
    first, number = resample.numbered(columns)
    rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
    assert len(first) == 3 and all(rows[first[n]] == r for r, n in zip(rows, number, strict=True))


def test_refits_start_where_the_mean_leads():
    rng = np.random.default_rng(3)
    X = np.column_stack([np.ones(200), rng.random(200) < 0.4, rng.random(200) < 0.5]).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(X @ [-1.0, 1.5, 0.5])))).astype(float)
    W = rng.multinomial(200, np.full(200, 1 / 200), 150).T.astype(float)
    warm, cold = [], []
    beta, solvable = glm.refits(X, y, W, warm)
    want = glm.irls(X, y, W, None, cold)
    assert solvable.all() and np.abs(beta - want[0]).max() < 1e-8
    assert sum(warm) < sum(cold) - 150 / 2, (warm, cold)
    # a replicate without variation isn't solvable, and one that diverges from the start is fitted from zero
    W[:, 0] = 0
    W[:, 1] = y
    assert (glm.refits(X, y, W)[1] == glm.irls(X, y, W)[3]).all()


def shuffled_rows(spark, action):
    """Rows that the stages of an action wrote to shuffles."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    listed = lambda: store.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    ids = {listed().apply(i).stageId() for i in range(listed().size())}
    action()
    after = listed()
    return sum(after.apply(i).shuffleWriteRecords() for i in range(after.size()) if after.apply(i).stageId() not in ids)


def odd_people(spark):
    rows = person_rows() + [("g0", 1, None, 3, 2.0, 1.0, 1.0, 0.0), ("g1", 1, 2, None, 2.0, 1.0, 0.0, 0.0), ("g2", 2, 1, 4, -1.0, 1.0, 1.0, 1.0), (None, 1, 2, 77, 1.0, 1.0, 1.0, 1.0), ("none", 2, None, 1, 1.0, 1.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_draws_are_counted_without_a_row_each(spark):
    df = odd_people(spark)
    want = resample.psu_draws(df, 27, 5).groupBy("state_code", "survey_strata", "replicate").agg(F.count("*").alias("p"), F.sum("times").alias("d"))
    got = resample.draw_counts(df, 27, 5)
    # psu_draws() joins PSUs by number, so one without an id is drawn, but no stratum without one
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 27 * 8
    few, many = (shuffled_rows(spark, resample.draw_counts(df, n, 5).collect) for n in (20, 400))
    assert 0 < few and many - few == 8 * 38  # a row a block of ten replicates of a stratum


@pytest.mark.parametrize("batch", [7, 10_000])
def test_phi_of_hashed_draws_made_in_tasks(spark, batch):
    people = odd_people(spark).repartition(3)
    df = people.where("graph_id IS NOT NULL")
    read = lambda d: {(r.graph_id, r.source_condition, r.target_condition, r.replicate): r.phi for r in d.collect()}
    want = read(resample.replicate_phi(df, resample.psu_draws(people, 23, 5), ["A", "B", "C"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = read(resample.hash_phi(df, people, 23, 5, ["A", "B", "C"], 10))  # three chunks
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4 * 3 * 23 and len(want) == 3 * 3 * 23
    assert all(v is None for k, v in got.items() if k[0] == "none")
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_shuffle_of_phi_does_not_grow_with_replicates(spark):
    df = spark.createDataFrame(person_rows(), SCHEMA)
    few, many = (shuffled_rows(spark, resample.hash_phi(df, df, n, 5, ["A", "B", "C"]).collect) for n in (20, 200))
    assert 0 < few == many


def test_influence_makes_a_design_once_for_models_of_the_same_levels(monkeypatch):
    rng = np.random.default_rng(8)
    columns = [rng.integers(0, 8, 60), np.full(60, 7), rng.choice(["1", "2", "3"], 60).astype(object), rng.choice(["F", "M"], 60).astype(object)]
    pairs = [(a, b) for a in range(3) for b in range(3) if a != b]
    models = [{"exposure": a, "outcome": b, "beta": rng.normal(size=5), "row": rng.normal(size=5), "scale": 1.0, "ages": ["1", "2", "3"], "sexes": ["F", "M"]} for a, b in pairs]
    alone = [glm._influence([m], columns)[0][:, 0] for m in models]
    made = []
    plain = glm.design_matrix
    monkeypatch.setattr(glm, "design_matrix", lambda *a: made.append(1) or plain(*a))
    assert (glm._influence(models, columns)[0].T == alone).all() and len(made) == 1
