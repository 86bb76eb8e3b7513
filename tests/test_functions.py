import math

import pytest
from pyspark.sql import functions as F

from affinis.functions import columns as C
from affinis.operators import association, graphs, population, recode


def test_raw_codes_become_conditions(spark):
    df = spark.createDataFrame([(1.0, 2.0, "1"), (2.0, 1.0, "2"), (7.0, 1.0, "4"), (None, 9.0, "9")], "heart double, asthma double, ses string")
    out = df.select(recode.binary("heart", [1.0], [2.0]).alias("h"), recode.binary("asthma", [1.0], [2.0]).alias("a"), recode.category("ses", recode.SES_GROUPS).alias("s")).collect()
    assert [r.h for r in out] == [1, 0, None, None] and [r.a for r in out] == [0, 1, 1, None] and [r.s for r in out] == ["lower", "lower", "higher", None]


def test_a_code_must_not_mean_both(spark):
    with pytest.raises(ValueError, match="yes and no"):
        recode.check_coding({"x": ("RAW", [1.0], [1.0, 2.0])}, ["RAW"])
    with pytest.raises(ValueError, match="no variable"):
        recode.check_coding({"x": ("RAW", [1.0], [2.0])}, [])


def test_perfect_association(spark):
    rows = [("g", 0.0, 0.0, 1.0), ("g", 0.0, 0.0, 2.0), ("g", 1.0, 1.0, 3.0), ("g", 1.0, 1.0, 4.0), ("g", None, 1.0, 9.0), ("g", 1.0, 1.0, -1.0), ("g", 1.0, 0.0, math.nan), ("g", 1.0, 0.0, math.inf)]
    df = spark.createDataFrame(rows, "graph_id string, A double, B double, survey_weight double")
    e = association.edge_table(df, {"complete": 4, "cases": 2, "cooccurring": 2}, 0.12, conditions=["A", "B"]).first()
    assert (round(e.association, 12), e.n_complete, e.cooccurring_cases, e.edge_present) == (1.0, 4, 2, True)
    assert e.weighted_n == 10.0 and e.kish_effective_n == pytest.approx(100 / 30)
    few = association.edge_table(df, {"complete": 5, "cases": 3, "cooccurring": 3}, 0.12, conditions=["A", "B"]).first()
    assert few.exclusion_reason == "complete_n|source_cases|target_cases|cooccurring_cases" and not few.edge_present


def test_a_constant_condition_has_no_phi_and_no_nan(spark):
    df = spark.createDataFrame([("g", 1.0, float(i % 2), 1.0) for i in range(10)], "graph_id string, A double, B double, survey_weight double")
    e = association.edge_table(df, {"complete": 1, "cases": 0, "cooccurring": 0}, -1.0, conditions=["A", "B"]).first()
    assert e.association is None and e.exclusion_reason == "undefined_association" and e.edge_present is False


def test_benjamini_hochberg_and_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, math.nan)], "i int, p double")
    q = [r.q for r in df.select("i", C.bh(F.col("p"), [F.lit(0)]).alias("q")).orderBy("i").collect()]
    assert q[:3] == pytest.approx([0.03, 0.04, 0.04]) and q[3:] == [None, None]
    h = [r.h for r in df.where("i < 3").select("i", C.holm(F.col("p"), [F.lit(0)], F.col("i")).alias("h")).orderBy("i").collect()]
    assert h == pytest.approx([0.03, 0.06, 0.06])


def test_registry_rules(spark):
    rows = [(1, "lower", 1.0, 1, 1), (1, "lower", 3.0, 1, 2), (1, "higher", 1.0, 1, 1), (1, "higher", 1.0, 1, 3), (3, "lower", 1.0, 1, 1), (3, "lower", 1.0, 1, 2), (3, "higher", 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "state_code int, ses_category string, survey_weight double, survey_strata int, survey_psu int")
    states = spark.createDataFrame([(1,), (2,), (3,)], "state_code int")
    got = {(r.geography_code, r.ses_category): r for r in population.registry(df, 2, states).collect()}
    assert got[1, "lower"].eligibility_status == "eligible" and got[1, "lower"].kish_effective_n == pytest.approx(1.6)
    assert got[2, "lower"].eligibility_status == got[2, "higher"].eligibility_status == "no reporting data"
    assert got[3, "lower"].eligibility_status == "paired SES stratum ineligible" and got[3, "lower"].stratum_eligibility_status == "eligible"
    assert got[3, "higher"].eligibility_status == "insufficient sample" and got[2, "lower"].n_unweighted == 0


def test_graph_similarity_of_two_graphs(spark):
    abc = ["A", "B", "C"]
    rows = [("x", "A", "B", True), ("x", "A", "C", True), ("x", "B", "C", False), ("y", "B", "A", True), ("y", "A", "C", False), ("y", "B", "C", True)]
    e = spark.createDataFrame([(g, a, b, True, p) for g, a, b, p in rows], "graph_id string, source_condition string, target_condition string, pair_eligible boolean, edge_present boolean")
    g = graphs.masks(e, conditions=abc).withColumn("geography_code", F.lit(1)).withColumn("ses_category", F.when(F.col("graph_id") == "x", "lower").otherwise("higher"))
    s = graphs.density_null(graphs.similarity(g, 3), 3).first()
    assert s.edge_jaccard == pytest.approx(1 / 3) and s.edge_agreement == pytest.approx(1 / 3) and s.density_z is not None and s.same_state and not s.same_ses


@pytest.mark.parametrize("bad", ["double", "null", "missing"])
def test_masks_refuse_incomplete_opportunity(spark, bad):
    rows = [("g", "A", "B", True), ("g", "A", "C", True), ("g", "B", "C", None if bad == "null" else True)]
    rows = rows + rows[:1] if bad == "double" else rows[:2] if bad == "missing" else rows
    e = spark.createDataFrame([(*r, False) for r in rows], "graph_id string, source_condition string, target_condition string, pair_eligible boolean, edge_present boolean")
    with pytest.raises(Exception, match="lacks pairs"):
        graphs.masks(e, conditions=["A", "B", "C"]).collect()


def test_hypergeometric_null_reference_value(spark):
    p = spark.createDataFrame([(28, 22, 2 / 3), (0, 0, 1.0)], "edges_a int, edges_b int, edge_jaccard double")
    out = {r.edges_a: r for r in graphs.density_null(p, 45).collect()}
    assert out[28].null_expected == pytest.approx(0.3798288792, abs=1e-9) and out[28].density_z == pytest.approx(4.5641046, abs=1e-6)
    assert out[0].null_expected == 1.0 and out[0].density_z is None


def test_statistics_of_known_graphs(spark):
    names = list("ABCDE")
    at = {e: 1 << i for i, e in enumerate(graphs.pairs_of(names))}
    path = at["A", "B"] + at["B", "C"]
    triangle = path + at["A", "C"]
    rows = spark.createDataFrame([(0, 0), (1, path), (2, triangle + at["D", "E"])], "i int, mask long")
    s = {r.i: r for r in graphs.statistics(rows, None, names).collect()}
    assert (s[0].component_count, s[0].isolate_count, s[0].transitivity, s[0].edge_count) == (5, 5, 0.0, 0)
    assert (s[1].component_count, s[1].isolate_count, s[1].transitivity, s[1].maximum_degree) == (3, 2, 0.0, 2)
    assert (s[2].component_count, s[2].isolate_count, s[2].transitivity, s[2].triangle_count, s[2].largest_component_nodes) == (2, 0, 1.0, 1, 3)


def test_wilson_brackets_the_share(spark):
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(C.wilson(F.lit(0.9), F.lit(200)), ("se", "lo", "hi"), strict=True)], C.wilson(F.lit(0.9), F.lit(0))[1].alias("none")).first()
    assert r.lo < 0.9 < r.hi and r.none is None


def test_state_names(spark):
    assert [r[0] for r in spark.createDataFrame([(6,), (99,)], "c int").select(C.state_name(F.col("c"))).collect()] == ["California", "Unknown (99)"]
