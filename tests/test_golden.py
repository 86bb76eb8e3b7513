import golden
import pytest
from pyspark.sql import functions as F

from affinis.operators import graphs, inference, motifs

FULL = (1 << 45) - 1


@pytest.fixture(scope="module")
def database(spark):
    rows = [(f"{s:02d}_{c}", s, c, m, FULL) for s, (hi, lo) in zip(golden.STATES, zip(golden.MASKS[::2], golden.MASKS[1::2], strict=True), strict=True) for c, m in (("higher", hi), ("lower", lo))]
    return spark.createDataFrame(rows, "graph_id string, geography_code int, ses_category string, mask long, opportunity long")


def test_structure_of_the_graphs(database):
    s = graphs.statistics(database, None, golden.CONDITIONS)
    names = [k for k in golden.TOTALS if k != "ineligible_dyad_count"]
    assert s.agg(*[F.sum(k).alias(k) for k in names]).first().asDict() == {k: golden.TOTALS[k] for k in names}


def test_motif_spectrum(database):
    found = motifs.frequent(database, 8, (), (3, 4, 5), golden.CONDITIONS)
    rows = found.groupBy("node_count", "support_count").count().collect()
    for least, n in golden.SPECTRUM.items():
        assert sum(r["count"] for r in rows if r.support_count >= least) == n
    for least, sizes in golden.SIZES.items():
        assert {k: sum(r["count"] for r in rows if r.support_count >= least and r.node_count == k) for k in sizes} == sizes


def test_redundancy_of_the_catalog(database):
    cat = motifs.mine(database, 40, (0.1, 0.2, 0.3), golden.CONDITIONS)
    red = motifs.redundancy(motifs.named(cat, golden.CONDITIONS))
    r = red.agg(F.count("*").alias("n"), F.count_if("is_closed"), F.count_if("is_maximal"), F.count_distinct("occurrence_class_id")).first()
    # with pairs that were not eligible counted as eligible, opportunity is complete: the published catalog's own counts
    assert (r[0], r[1:]) == (golden.SPECTRUM[10], golden.REDUNDANCY)


def test_confirmatory_p_values(spark):
    rows = [(h, s, d) for h, values in golden.DIFFERENCES.items() for s, d in zip(golden.DIFFERENCE_STATES, values, strict=True)]
    res = spark.createDataFrame(rows, "hypothesis_id string, geography_code int, difference double")
    hyp = spark.createDataFrame([(h, i, t[0]) for i, (h, t) in enumerate(golden.TESTS.items())], "hypothesis_id string, family_order int, direction_sign int")
    signs = inference.bank_frame(spark, golden.DIFFERENCE_STATES, 99_999, 20230904)
    out = inference.directional_test(res, hyp, signs, 99_999, 40, 0.05, True).collect()
    for r in out:
        _, t, p, holm = golden.TESTS[r.hypothesis_id]
        assert (r.studentized_statistic, r.one_sided_p_value, r.holm_adjusted_p_value) == pytest.approx((t, p, holm), abs=1e-8)
        assert r.replicated == (r.hypothesis_id == "H3")


def test_motif_ids(spark):
    at = {e: 1 << i for i, e in enumerate(graphs.pairs_of(golden.CONDITIONS))}
    rows = spark.createDataFrame([(k, sum(at[e] for e in v)) for k, v in golden.IDS.items()], "want string, mask long")
    assert all(r.want == r.motif_id for r in motifs.named(rows, golden.CONDITIONS).collect())
