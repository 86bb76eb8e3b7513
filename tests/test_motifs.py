import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import glm, graphs, inference, motifs, protocol, resample
from affinis.sources.bridge import CONDITIONS

ABC = ["A", "B", "C", "D"]
AT = {e: 1 << i for i, e in enumerate(graphs.pairs_of(ABC))}
AB, AC, BC, CD = (AT[x, y] for x, y in (("A", "B"), ("A", "C"), ("B", "C"), ("C", "D")))
FULL = sum(AT.values())


def paired(spark, masks, opportunity=None):
    rows = [(f"{s}_{c}", s, c, m, (opportunity or {}).get((s, c), FULL)) for (s, c), m in masks.items()]
    return spark.createDataFrame(rows, "graph_id string, geography_code int, ses_category string, mask long, opportunity long")


def test_numbers_of_connected_patterns(spark):
    assert [len(motifs.templates(k)) for k in (3, 4, 5)] == [4, 38, 728]
    got = {r.node_count: r.n for r in motifs.connected_masks(spark).groupBy("node_count").agg(F.count_distinct("mask").alias("n")).collect()}
    assert got == {3: 480, 4: 7980, 5: 183456}


def test_support_counts_of_94_graphs():
    assert motifs.support_thresholds(94) == {0.1: 10, 0.2: 19, 0.3: 29}


def test_opportunity_aware_support(spark):
    g = paired(spark, {(1, "lower"): AB, (1, "higher"): AB + AC, (2, "lower"): AB + AC, (2, "higher"): AB + AC}, {(1, "lower"): AB})
    m = spark.createDataFrame([(AB + AC,)], "mask long")
    r = motifs.evaluability(motifs.state_pairs(g), m).first()
    assert (r.paired_state_count, r.support_count, r.distinct_state_support_count, r.graph_ids) == (1, 2, 1, ["2_higher", "2_lower"])
    s = motifs.evaluability(motifs.state_pairs(motifs.swapped(g)), m).first()
    assert (s.paired_state_count, s.support_count) == (1, 2)


def test_a_state_needs_both_graphs(spark):
    with pytest.raises(Exception, match="lacks one lower"):
        motifs.state_pairs(paired(spark, {(1, "lower"): AB})).collect()


def test_mining_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    masks = [int(x) for x in rng.integers(0, FULL + 1, 30)]
    df = spark.createDataFrame([(m,) for m in masks], "mask long")
    got = {r.mask: r.support_count for r in motifs.frequent(df, 6, (), (3, 4), ABC).collect()}
    every = {r.mask for r in motifs.connected_masks(spark, (3, 4), ABC).collect()}
    want = {p: n for p in every if (n := sum(m & p == p for m in masks)) >= 6}
    assert got == want


def test_redundancy(spark):
    rows = [(AB + AC, 3, 2, "m1", ["g1", "g2"]), (AB + AC + BC, 3, 3, "m2", ["g1", "g2"]), (BC + CD, 3, 2, "m3", ["g3"])]
    c = spark.createDataFrame(rows, "mask long, node_count int, edge_count int, motif_id string, graph_ids array<string>")
    out = {r.motif_id: r for r in motifs.redundancy(c).collect()}
    assert not out["m1"].is_closed and out["m2"].is_closed and out["m2"].occurrence_class_size == 2 and out["m2"].is_occurrence_representative
    assert not out["m1"].is_maximal and out["m2"].is_maximal and out["m3"].is_maximal and out["m3"].is_closed


def test_occurrence_probability(spark):
    p = lambda n, m, r: spark.range(1).select(inference.occurrence_probability(F.lit(n), F.lit(m), F.lit(r))).first()[0]
    assert p(6, 3, 2) == pytest.approx(0.2) and p(10, 2, 3) == 0 and p(3, 2, 4) == 0
    assert p(45, 16, 4) == pytest.approx(math.comb(41, 12) / math.comb(45, 16))
    # the archived difference of one state: a 4-edge motif in a graph of 16 edges, absent from one of 8
    assert 1 - p(45, 16, 4) - (0 - p(45, 8, 4)) == pytest.approx(0.9882546394, abs=1e-9)
    with pytest.raises(Exception, match="more edges"):
        p(2, 3, 1)


def test_sign_bank_bits_and_exact_p_values(spark):
    bank = inference.sign_bank([2, 1], 4, 20230904)
    assert bank.tolist() == [[1, -1], [-1, -1], [1, -1], [-1, 1]]
    with pytest.raises(ValueError, match="unique"):
        inference.sign_bank([1, 1], 4, 1)
    signs = spark.createDataFrame([(p, s, 1.0 if p >> s & 1 else -1.0) for p in range(16) for s in range(4)], "permutation int, geography_code int, sign double")
    rows = [(h, s, float(d)) for h, d in (("a", 0), ("b", 1), ("c", -1)) for s in range(4)]
    res = spark.createDataFrame(rows, "hypothesis_id string, geography_code int, difference double")
    hyp = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, -1)], "hypothesis_id string, family_order int, direction_sign int")
    out = {r.hypothesis_id: r for r in inference.directional_test(res, hyp, signs, 16, 4, 0.5, True).collect()}
    assert (out["a"].studentized_statistic, out["b"].studentized_statistic, out["c"].studentized_statistic) == (0.0, math.inf, -math.inf)
    assert out["a"].one_sided_p_value == 1 and out["b"].one_sided_p_value == out["c"].one_sided_p_value == pytest.approx(2 / 17)
    assert out["b"].replicated and out["c"].replicated and not out["a"].replicated
    few = {r.hypothesis_id: r for r in inference.directional_test(res, hyp, signs, 16, 5, 0.5, False).collect()}
    assert few["b"].one_sided_p_value == 1 and few["b"].studentized_statistic is None and few["b"].test_status == "insufficient_opportunity"


def test_vocabulary(spark):
    g = paired(spark, {(1, "lower"): AB + AC, (1, "higher"): AB, (2, "lower"): AB + AC, (2, "higher"): 0}, {(2, "higher"): AB})
    words = spark.createDataFrame([("x", AB, 1.0), ("y", AB + AC, 0.5)], "motif_id string, mask long, discovery_support_fraction double")
    found = motifs.evaluability(motifs.state_pairs(g), words.select("mask"))
    out = {r.motif_id: r for r in inference.vocabulary(found, words, 0.2, 1).collect()}
    assert [out[k].replication_paired_state_count for k in "xy"] == [2, 1] and [out[k].replication_support_count for k in "xy"] == [3, 1]
    assert out["x"].replicated and out["y"].replicated


def test_selection_masks_decode_and_support(spark):
    rows = [("g1", "A", "B", "b110x", True), ("g1", "A", "C", "b1000", True), ("g2", "A", "B", "b1010", True), ("g2", "A", "C", "b0101", False)]
    b = spark.createDataFrame(rows, "graph_id string, source_condition string, target_condition string, bootstrap_selection_mask string, pair_eligible boolean")
    got = {(r.graph_id, r.replicate): r["mask"] for r in resample.replicate_masks(b, ABC).collect()}
    assert [got["g1", i] for i in (1, 2, 3, 4)] == [AB + AC, AB, 0, 0] and [got["g2", i] for i in (1, 2, 3, 4)] == [AB, 0, AB, 0]
    with pytest.raises(Exception, match="selection mask"):
        resample.replicate_masks(b.withColumn("bootstrap_selection_mask", F.lit("b12")), ABC).collect()


def test_degree_null_keeps_degrees_and_opportunity(spark):
    names = ["A", "B", "C", "D", "E"]
    at = {e: 1 << i for i, e in enumerate(graphs.pairs_of(names))}
    mask = sum(at[e] for e in [("A", "B"), ("B", "C"), ("C", "D"), ("A", "D"), ("D", "E"), ("B", "E")])
    allowed = sum(at.values()) - at["A", "C"]
    g = spark.createDataFrame([("g", mask, allowed), ("none", 0, allowed)], "graph_id string, mask long, opportunity long")
    out = resample.degree_null(g, 20, 10, 1, names).collect()
    degree = lambda m: sorted((n, sum(m & b > 0 for e, b in at.items() if n in e)) for n in names)
    chains = [r for r in out if r.graph_id == "g"]
    assert len(out) == 40 and all(degree(r["mask"]) == degree(mask) and not r["mask"] & at["A", "C"] for r in chains) and any(r.changed for r in chains)
    bad = spark.createDataFrame([("g", mask, 0)], "graph_id string, mask long, opportunity long")
    with pytest.raises(Exception, match="not eligible"):
        resample.degree_null(bad, 1, 1, 1, names).collect()


def test_fixed_edge_null_draws_eligible_pairs(spark):
    g = spark.createDataFrame([("g", AB + AC, FULL - BC), ("z", 0, FULL)], "graph_id string, mask long, opportunity long")
    out = inference.fixed_edge_null(g, 50, 3, 6).collect()
    own = [r["mask"] for r in out if r.graph_id == "g"]
    assert all(m.bit_count() == 2 and not m & BC for m in own) and len(set(own)) > 3 and all(r["mask"] == 0 for r in out if r.graph_id == "z")


def test_protocol_checks(spark):
    v = motifs.named(spark.createDataFrame([(AB + AC, 0.5)], "mask long, support_fraction double"), ABC)
    assert v.first().edge_list == '[["A","B"],["A","C"]]' and v.first().node_labels == '["A","B","C"]'
    full = graphs.pairs_of(CONDITIONS)
    at = {e: 1 << i for i, e in enumerate(full)}
    ok, apart = at["COND_A", "COND_B"] + at["COND_B", "COND_C"], at["COND_A", "COND_B"] + at["COND_C", "COND_D"]
    v = motifs.named(spark.createDataFrame([(ok, 0.5), (apart, 0.1)], "mask long, support_fraction double"))
    r = protocol.motif_violations(v, 0.2).first()
    assert (r.wrong_ids, r.unconnected, r.below_support, r.doubled_ids) == (0, 1, 1, 0)
    ids = [x.motif_id for x in v.collect()]
    f = spark.createDataFrame([("c1", ids[0]), ("c2", ids[0]), ("c3", "other")], "occurrence_class_id string, motif_id string")
    p = protocol.partition_violations(v, f).first()
    assert (p.missing, p.unknown, p.in_two_families) == (1, 1, 1)


def test_logistic_slope_is_the_log_odds_ratio_of_a_2x2_table(spark):
    counts = {(1, 1): 30, (1, 0): 20, (0, 1): 25, (0, 0): 65}
    rows, i = [], 0
    for (a, b), n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((f"g{1}", 1, "lower", float(i % 5 + 1) * 0 + 2.0, i % 3, i, 1, "f", float(a), float(b)))
    df = spark.createDataFrame(rows, "graph_id string, state_code int, ses_category string, survey_weight double, survey_strata int, survey_psu int, age_group int, sex string, A double, B double")
    jobs = spark.createDataFrame([("g1", "A", "B", 1)], "graph_id string, source_condition string, target_condition string, state_code int")
    able = jobs.withColumn("pair_eligible", F.lit(True))
    m = glm.adjusted_edges(glm.adjusted_models(df, jobs, ["A", "B"]), able).first()
    want = math.log(30 * 65 / (20 * 25))
    assert m.log_odds_ratio == pytest.approx(want, abs=1e-6) and m.reverse_log_odds_ratio == pytest.approx(want, abs=1e-6)
    model_se = math.sqrt(1 / 30 + 1 / 65 + 1 / 20 + 1 / 25)
    assert m.standard_error == pytest.approx(model_se, rel=0.1) and m.converged and m.edge_present and m.direction_concordant
    b = glm.stability(glm.adjusted_bootstrap(df, jobs, ["A", "B"], 40, 5)).first()
    assert b.bootstrap_replicates_valid == 40 and b.positive_stability > 0.9 and b.bootstrap_low_log < want < b.bootstrap_high_log
    flat = glm.adjusted_models(df.withColumn("A", F.lit(1.0)), jobs, ["A", "B"]).first()
    assert flat.model_status == "coefficient_missing" and flat.log_odds_ratio is None


def test_t_distribution():
    assert glm.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and glm.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)


def test_replicate_phi_equals_plain_sums(spark):
    rng = np.random.default_rng(8)
    names = ["A", "B", "C"]
    rows = []
    for i in range(400):
        a, b, c = (None if rng.random() < 0.1 else float(rng.random() < p) for p in (0.4, 0.5, 0.3))
        rows.append((f"g{i % 2}", 1, int(i % 3), int(i % 40), float(rng.random() + 0.1), a, b, c))
    df = spark.createDataFrame(rows, "graph_id string, state_code int, survey_strata int, survey_psu int, survey_weight double, A double, B double, C double")
    draws = resample.psu_draws(df, 6, 3)
    want = {(r.graph_id, r.source_condition, r.target_condition, r.replicate): r.phi for r in resample.replicate_phi(df, draws, names).collect()}
    times = {(r.survey_strata, r.survey_psu, r.replicate): r.times for r in draws.collect()}
    for g in ("g0", "g1"):
        for i, j in ((0, 1), (0, 2), (1, 2)):
            for rep in range(1, 7):
                own = [(r[4] * times.get((r[2], r[3], rep), 0), r[5 + i], r[5 + j]) for r in rows if r[0] == g and r[5 + i] is not None and r[5 + j] is not None]
                w = sum(x[0] for x in own)
                pa, pb, pab = (sum(x[0] * v for x in own for v in [f(x)]) / w for f in (lambda x: x[1], lambda x: x[2], lambda x: x[1] * x[2]))
                assert want[g, names[i], names[j], rep] == pytest.approx((pab - pa * pb) / math.sqrt(pa * (1 - pa) * pb * (1 - pb)), abs=1e-9)
    t = resample.draw_times(np.array([1, 1, 1, 2]), 30, np.random.default_rng(1))
    assert (t[:3].sum(axis=0) == 3).all() and (t[3] == 1).all()
    out = resample.random_bootstrap(df, 60, 1, 0.12, names).collect()
    assert len(out) == 6 and all(r.bootstrap_replicates_valid == 60 and len(r.bootstrap_selection_mask) == 61 and r.bootstrap_phi_025 <= r.bootstrap_phi_median <= r.bootstrap_phi_975 for r in out)


def plain_model(rows, design, x, y):
    """Slope, standard error and degrees of freedom from persons (stratum, PSU, weight, age, sex, answers), one by one."""
    dom = [r for r in rows if None not in (r[x], r[y], r[3], r[4])]
    ages, sexes = sorted({r[3] for r in dom}), sorted({r[4] for r in dom})
    X = np.array([[1.0, r[x], *(r[3] == a for a in ages[1:]), *(r[4] == s for s in sexes[1:])] for r in dom], float)
    Y, w = np.array([r[y] for r in dom]), np.array([r[2] for r in dom])
    w = w / w.mean()
    beta = np.zeros(X.shape[1])
    for _ in range(25):
        mu = 1 / (1 + np.exp(-X @ beta))
        beta = beta + np.linalg.solve(X.T @ (X * (w * mu * (1 - mu))[:, None]), X.T @ (w * (Y - mu)))
    mu = 1 / (1 + np.exp(-X @ beta))
    bread = np.linalg.inv(X.T @ (X * (w * mu * (1 - mu))[:, None]))
    z = {p: np.zeros(X.shape[1]) for p in design}
    for r, score in zip(dom, X * (w * (Y - mu))[:, None], strict=True):
        z[r[0], r[1]] += score
    every, meat = np.mean(list(z.values()), axis=0), 0
    for s in {p[0] for p in design}:
        own = np.array([v for p, v in z.items() if p[0] == s])
        d = own - (own.mean(axis=0) if len(own) > 1 else every)
        meat = meat + (len(own) / (len(own) - 1) if len(own) > 1 else 1) * d.T @ d
    used = {(r[0], r[1]) for r in dom}
    return beta[1], math.sqrt((bread @ meat @ bread)[1, 1]), max(1, len(used) - len({u[0] for u in used}) - len(beta) + 1)


def survey(seed, n=600):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        stratum = int(rng.integers(6))
        psu = 0 if stratum == 5 else int(rng.integers(12))  # the last stratum has one PSU
        a = rng.random() < 0.4
        b, c = rng.random() < (0.6 if a else 0.3), rng.random() < 0.5
        miss = lambda v: None if rng.random() < 0.08 else float(v)  # noqa: B023
        rows.append((f"g{i % 2}", 3, stratum, psu, float(rng.random() + 0.2), None if rng.random() < 0.05 else int(rng.integers(1, 4)), "f" if rng.random() < 0.5 else "m", miss(a), miss(b), miss(c)))
    return rows


SURVEY = "graph_id string, state_code int, survey_strata int, survey_psu int, survey_weight double, age_group int, sex string, A double, B double, C double"


def test_models_and_design_errors_equal_a_plain_fit(spark):
    rows = survey(1)
    df = spark.createDataFrame(rows, SURVEY).repartition(5)
    jobs = spark.createDataFrame([(g, *p) for g in ("g0", "g1") for p in (("A", "B"), ("A", "C"), ("B", "C"))], "graph_id string, source_condition string, target_condition string")
    design = sorted({(r[2], r[3]) for r in rows})
    for m in glm.adjusted_models(df, jobs, ["A", "B", "C"]).collect():
        own = [(r[2], r[3], r[4], r[5], r[6], *r[7:]) for r in rows if r[0] == m.graph_id]
        a, b = (5 + "ABC".index(c) for c in (m.source_condition, m.target_condition))
        slope, se, freedom = plain_model(own, design, a, b)
        assert (m.log_odds_ratio, m.standard_error) == pytest.approx((slope, se), rel=1e-6)
        q = glm.t_quantile(0.975, float(freedom))
        assert (m.confidence_low_log, m.confidence_high_log) == pytest.approx((slope - q * se, slope + q * se), rel=1e-6)
        assert (m.reverse_log_odds_ratio, m.reverse_standard_error) == pytest.approx(plain_model(own, design, b, a)[:2], rel=1e-6)
    # refits: the point model, and replicates of the same draws by plain weights
    boot = {(r.graph_id, r.source_condition): r for r in glm.adjusted_bootstrap(df, jobs.where("target_condition = 'B'"), ["A", "B", "C"], 60, 9).collect()}
    times = {}
    for r in resample.random_draws(df, 60, 9).collect():
        for rep, t in zip(r.reps, r.times, strict=True):
            times[r.survey_strata, r.survey_psu, r.chunk * resample.CHUNK + rep] = t
    for g in ("g0", "g1"):
        values = []
        for rep in range(60):
            own = [(r[2], r[3], r[4] * times.get((r[2], r[3], rep), 0), r[5], r[6], *r[7:]) for r in rows if r[0] == g]
            values.append(plain_model([r for r in own if r[2] > 0], design, 5, 6)[0])
        r = boot[g, "A"]
        assert r.bootstrap_replicates_valid == 60 and r.positive_stability == pytest.approx(np.mean(np.array(values) > 0))
        assert (r.bootstrap_low_log, r.bootstrap_high_log) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])), rel=1e-6)


def test_a_state_that_holds_most_rows(spark):
    """One population with most of the rows, dealt over many partitions and small batches, gives the same models."""
    rows = survey(2, 900)
    rows += [("g9", 4, *r[2:]) for r in rows[:60]]
    df = spark.createDataFrame(rows, SURVEY)
    jobs = spark.createDataFrame([(g, "A", "B") for g in ("g0", "g1", "g9")], "graph_id string, source_condition string, target_condition string")
    read = lambda x: sorted((r.graph_id, round(r.log_odds_ratio, 8), round(r.standard_error, 8)) for r in glm.adjusted_models(x, jobs, ["A", "B", "C"]).collect())
    want = read(df.coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert read(df.repartition(9)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_q_is_over_all_models_and_ineligible_pairs_are_no_edges(spark):
    rows = [("g", "A", b, "ok", p, True, 1.0, 0.5, 2.0, e) for b, p, e in (("B", 0.01, True), ("C", 0.02, False), ("D", 0.04, True), ("E", 0.9, False))]
    m = spark.createDataFrame(rows, "graph_id string, source_condition string, target_condition string, model_status string, p_value double, converged boolean, log_odds_ratio double, confidence_low_log double, confidence_high_log double, pair_eligible boolean")
    m = m.withColumn("reverse_log_odds_ratio", F.lit(1.0))
    out = {r.target_condition: r for r in glm.adjusted_edges(m.drop("pair_eligible"), m).collect()}
    assert [out[k].q_value for k in "BCDE"] == pytest.approx([0.04, 0.04, 0.16 / 3, 0.9])
    assert [out[k].edge_present for k in "BCDE"] == [True, False, False, False]


def test_no_jobs_give_typed_empty_results(spark):
    df = spark.createDataFrame(survey(3, 50), SURVEY)
    none = spark.createDataFrame([], "graph_id string, source_condition string, target_condition string, pair_eligible boolean")
    models = glm.adjusted_models(df, none, ["A", "B", "C"])
    edges = glm.adjusted_edges(models, none)
    boot = glm.adjusted_bootstrap(df, none, ["A", "B", "C"], 20, 1)
    assert models.collect() == edges.collect() == boot.collect() == glm.sign_stable(edges, boot, 0.9).collect() == []
    assert dict(models.dtypes)["log_odds_ratio"] == "double" and dict(boot.dtypes)["bootstrap_replicates_valid"] == "int"


def test_adjusted_queries_cover_all_pairs_and_states(spark):
    from affinis.plans import QUERIES, graph_queries

    d = "/root/testdata/sf0.001"
    pairs = {tuple(r) for r in graph_queries.pair_table(spark, d).select("graph_id", "source_condition", "target_condition").collect()}
    models = QUERIES["adjusted_logit"](spark, d).collect()
    assert {(r.graph_id, r.source_condition, r.target_condition) for r in models} == pairs
