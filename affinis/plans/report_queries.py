"""Queries of verdicts, diagnostics and figure tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions.columns import r
from affinis.operators import association, graphs, inference, motifs, protocol, reports
from affinis.operators.tables import settle, shared_folder
from affinis.plans import graph_queries as G
from affinis.plans import motif_queries as M
from affinis.plans import robustness_queries as R
from affinis.plans import sqlbase as S
from affinis.plans.register import registered
from affinis.sources.bridge import DEFINITION, YEAR
from affinis.streaming import audit

TARGET = f"{YEAR}_06_{DEFINITION}_lower"
RULES = sorted(S.RULES)


def _rounded(df, digits: int = 7):
    return df.withColumns({c: r(c, digits) for c, t in df.dtypes if t == "double"})


def _gates(gates: list[str]) -> str:
    return "CASE WHEN " + " AND ".join(f"coalesce({g}, true)" for g in gates) + " THEN 'GO' ELSE 'HOLD' END"


S.cte("pstats", "stats pgraphs", "SELECT s.* FROM stats s JOIN pgraphs USING (graph_id) WHERE s.rule_id = 'phi_012'")


@registered(
    S.query(
        "pstats simz",
        f"""SELECT *, {_gates(["structural_heterogeneity", "usable_density"])} AS decision FROM (SELECT *, eligible_graph_count >= 10 AND unique_edge_set_fraction >= 0.5 AND edge_count_maximum > edge_count_minimum AS structural_heterogeneity,
  density_median BETWEEN CAST(0.2 AS DOUBLE) AND CAST(0.6 AS DOUBLE) AS usable_density, CAST(NULL AS BOOLEAN) AS recurrent_motifs, density_maximum >= CAST(0.7 AS DOUBLE) AS density_caution FROM
  (SELECT count(*) AS eligible_graph_count, count(DISTINCT mask) AS unique_edge_sets, min(edge_count) AS edge_count_minimum, {S.r("median(edge_count)", 7)} AS edge_count_median, max(edge_count) AS edge_count_maximum,
   {S.r("median(density)", 7)} AS density_median, {S.r("max(density)", 7)} AS density_maximum, {S.r("count(DISTINCT mask) / CAST(count(*) AS DOUBLE)", 7)} AS unique_edge_set_fraction FROM pstats)
  CROSS JOIN (SELECT {S.r("min(edge_jaccard)", 7)} AS jaccard_minimum, {S.r("median(edge_jaccard)", 7)} AS jaccard_median, {S.r("max(edge_jaccard)", 7)} AS jaccard_maximum, {S.r("avg(CASE WHEN same_state AND NOT same_ses THEN edge_jaccard END)", 7)} AS mean_within_state_jaccard FROM simz))""",
    )
)
def structure_verdict(spark, d):
    g = G.population_graphs(spark, d)
    return _rounded(reports.structure_verdict(graphs.statistics(g), graphs.similarity(g, 45), 10, 0.5, 0.2, 0.6, 0.7))


S.cte("psupport", "scen pgraphs", "SELECT source_condition, target_condition, count(*) FILTER (edge_present) / CAST(count(*) AS DOUBLE) AS support_fraction FROM scen JOIN pgraphs USING (graph_id) WHERE rule_id = 'phi_012' GROUP BY ALL")
_CAL = "graph_count median_edge_target_met maximum_density_target_met median_raw_jaccard median_density_adjusted_z variable_recurrent_edge_count".split()
_CGATES = ["enough_graphs", "moderately_sparse", "heterogeneous_but_comparable", "recurrent_edge_backbone", "bootstrap_complete"]


@registered(
    S.query(
        "pstats simz psupport",
        f"""SELECT {", ".join(_CAL)}, {", ".join(_CGATES)}, {_gates(_CGATES)} AS decision FROM (SELECT *, graph_count >= 10 AS enough_graphs, median_edge_target_met AND maximum_density_target_met AS moderately_sparse,
  median_raw_jaccard < CAST(0.95 AS DOUBLE) AND median_density_adjusted_z > 0 AS heterogeneous_but_comparable, variable_recurrent_edge_count >= 5 AS recurrent_edge_backbone, true AS bootstrap_complete FROM
  (SELECT count(*) AS graph_count, median(edge_count) BETWEEN 10 AND 20 AS median_edge_target_met, max(density) < CAST(0.7 AS DOUBLE) AS maximum_density_target_met FROM pstats)
  CROSS JOIN (SELECT {S.r("median(edge_jaccard)", 7)} AS median_raw_jaccard, {S.r("median(density_z)", 7)} AS median_density_adjusted_z FROM simz)
  CROSS JOIN (SELECT count(*) FILTER (support_fraction BETWEEN CAST(0.10 AS DOUBLE) AND CAST(0.90 AS DOUBLE)) AS variable_recurrent_edge_count FROM psupport))""",
    )
)
def calibration_verdict(spark, d):
    g = G.population_graphs(spark, d)
    cal = graphs.calibration_summary(graphs.statistics(g).withColumn("rule_id", F.lit("phi_012")), 10, 20, 0.7)
    e = G.pair_table(spark, d).join(g.select("graph_id"), "graph_id", "left_semi")
    v = reports.calibration_verdict(cal, graphs.density_null(graphs.similarity(g, 45), 45), graphs.edge_support(e, ()), 10, True)
    return _rounded(v.select(*_CAL, *_CGATES, "decision"))


_LIMITS = {"graphs": 10, "edges_most": 20, "edges_least": 3, "density": 0.7, "stable": 0.4, "adjacent": 0.5, "outer": 0.25, "below_050": 0.25, "jaccard": 0.95, "recurrent": 5, "concordance": 0.9}
S.cte("sgraphs", "stab universe pgraphs", f"SELECT s.graph_id, p.geography_code, p.ses_category, {S.big('sum(CASE WHEN edge_present THEN bit ELSE 0 END)')} AS mask FROM stab s JOIN universe ON a = source_condition AND b = target_condition JOIN pgraphs p USING (graph_id) GROUP BY ALL")
S.cte("ssim", "sgraphs", f"SELECT bit_count(x.mask)::INTEGER AS edges_a, bit_count(y.mask)::INTEGER AS edges_b, {S.jaccard('x.mask', 'y.mask')} AS edge_jaccard FROM sgraphs x JOIN sgraphs y ON x.graph_id < y.graph_id")


def null_z(name: str, source: str) -> None:
    """A CTE `name`: rows of source (edges_a, edges_b, edge_jaccard, ...) with density_z and null_expected."""
    S.cte(
        name,
        f"{source} comb45",
        f"""SELECT s.*, e AS null_expected, CASE WHEN m2 - e * e > CAST(1e-14 AS DOUBLE) THEN (s.edge_jaccard - e) / sqrt(m2 - e * e) END AS density_z FROM {source} s JOIN (
    SELECT edges_a, edges_b, sum(p * j) AS e, sum(p * j * j) AS m2 FROM (SELECT t.edges_a, t.edges_b, x.c * y.c / z.c AS p, CASE WHEN t.edges_a + t.edges_b - i > 0 THEN i / CAST(t.edges_a + t.edges_b - i AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS j
      FROM (SELECT edges_a, edges_b, unnest(range(greatest(0, edges_a + edges_b - 45), least(edges_a, edges_b) + 1)) AS i FROM (SELECT DISTINCT edges_a, edges_b FROM {source})) t
      JOIN comb45 x ON x.n = t.edges_a AND x.k = i JOIN comb45 y ON y.n = 45 - t.edges_a AND y.k = t.edges_b - i JOIN comb45 z ON z.n = 45 AND z.k = t.edges_b) GROUP BY ALL) USING (edges_a, edges_b)""",
    )


null_z("ssimz", "ssim")
S.cte("ssupport", "stab pgraphs", "SELECT source_condition, target_condition, count(*) FILTER (edge_present) / CAST(count(*) AS DOUBLE) AS f FROM stab JOIN pgraphs USING (graph_id) GROUP BY ALL")
S.cte("continuity", "steps", "SELECT bool_and(nested AND CASE WHEN transition_type = 'adjacent' THEN mj >= CAST(0.5 AS DOUBLE) AND fb <= CAST(0.25 AS DOUBLE) ELSE mj >= CAST(0.25 AS DOUBLE) END) AS threshold_continuity FROM (SELECT transition_type, from_rule_id, to_rule_id, bool_and(nested) AS nested, median(edge_jaccard) AS mj, avg(CASE WHEN edge_jaccard < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS fb FROM steps GROUP BY ALL)")
_SGATES = ["enough_graphs", "moderate_density", "meaningful_edge_count", "most_raw_edges_stable", "heterogeneous_but_comparable", "recurrent_edge_backbone", "bootstrap_complete", "threshold_continuity"]
_SCOLS = ["graph_count", "median_edge_count", "maximum_density", "median_raw_jaccard", "median_density_adjusted_z", "variable_recurrent_edge_count", "raw_edge_count", "stable_edge_count", "raw_edge_stable_fraction"]


@registered(
    S.query(
        "sgraphs ssimz ssupport stab continuity",
        f"""SELECT {", ".join(_SCOLS)}, {", ".join(_SGATES)}, {_gates(_SGATES)} AS decision FROM (SELECT *, graph_count >= 10 AS enough_graphs, median_edge_count <= 20 AND maximum_density < CAST(0.7 AS DOUBLE) AS moderate_density,
  median_edge_count >= 3 AS meaningful_edge_count, raw_edge_stable_fraction >= CAST(0.4 AS DOUBLE) AS most_raw_edges_stable, median_raw_jaccard < CAST(0.95 AS DOUBLE) AND median_density_adjusted_z > 0 AS heterogeneous_but_comparable,
  variable_recurrent_edge_count >= 5 AS recurrent_edge_backbone FROM
  (SELECT count(*) AS graph_count, {S.r("median(bit_count(mask))", 7)} AS median_edge_count, {S.r("max(bit_count(mask)) / CAST(45 AS DOUBLE)", 7)} AS maximum_density FROM sgraphs)
  CROSS JOIN (SELECT {S.r("median(edge_jaccard)", 7)} AS median_raw_jaccard, {S.r("median(density_z)", 7)} AS median_density_adjusted_z FROM ssimz)
  CROSS JOIN (SELECT count(*) FILTER (f BETWEEN CAST(0.10 AS DOUBLE) AND CAST(0.90 AS DOUBLE)) AS variable_recurrent_edge_count FROM ssupport)
  CROSS JOIN (SELECT *, {S.r("stable_edge_count / nullif(CAST(raw_edge_count AS DOUBLE), 0)", 7)} AS raw_edge_stable_fraction FROM (SELECT bool_and(valid = {R.B}) AS bootstrap_complete, count(*) FILTER (pair_eligible AND round(association, 9) >= CAST({R.EFFECT} AS DOUBLE)) AS raw_edge_count,
    count(*) FILTER (pair_eligible AND round(association, 9) >= CAST({R.EFFECT} AS DOUBLE) AND valid = {R.B} AND p1 >= CAST({R.STABLE} AS DOUBLE)) AS stable_edge_count FROM stab)) CROSS JOIN continuity)""",
    )
)
def selection_verdict(spark, d):
    st = R.stable_table(spark, d)
    pop = G.population_graphs(spark, d)
    own = st.join(pop.select("graph_id"), "graph_id", "left_semi")
    g = settle(G.described(graphs.masks(own)))
    steps = graphs.transition_summary(graphs.transitions(G.all_graphs(spark, d), G.RULES))
    v = reports.selection_verdict(graphs.statistics(g), graphs.density_null(graphs.similarity(g, 45), 45), graphs.edge_support(own, ()), st, steps, None, R.EFFECT, R.STABLE, _LIMITS)
    return _rounded(v.select(*_SCOLS, *_SGATES, "decision"))


@registered(
    S.query(
        "pstats redundant",
        f"""SELECT * FROM (SELECT count(*) AS graph_count, {S.r("avg(edge_count)", 7)} AS mean_edge_count, min(edge_count) AS minimum_edge_count, max(edge_count) AS maximum_edge_count, count(*) FILTER (edge_count >= 5) AS graphs_with_at_least_five_edges,
  count(*) FILTER (largest_component_nodes >= 5) AS graphs_with_five_node_component, count(*) FILTER (triangle_count > 0) AS graphs_with_triangles FROM pstats)
  CROSS JOIN (SELECT count(*) AS motif_count_total, count(*) FILTER (is_closed) AS closed_motif_count, count(*) FILTER (is_maximal) AS maximal_motif_count, count(DISTINCT occurrence_class_id) AS occurrence_class_count,
  min(paired_state_count) AS paired_state_count_minimum, max(paired_state_count) AS paired_state_count_maximum, {", ".join(f"count(*) FILTER (support_{n}) AS motifs_{n}" for n in M.NAMES)} FROM redundant)""",
    )
)
def feasibility_report(spark, d):
    return _rounded(reports.feasibility(graphs.statistics(G.population_graphs(spark, d)), M.full_catalog(spark, d), M.NAMES))


@registered(S.query("scen", f"SELECT source_condition, target_condition, {S.r('max(association)')} AS weighted_phi, max(n_complete) AS n_complete, max(cooccurring_cases) AS cooccurring_cases, " + ", ".join(f"bool_or(edge_present) FILTER (rule_id = '{x}') AS edge_present_{x}" for x in RULES) + f" FROM scen WHERE graph_id = '{TARGET}' GROUP BY ALL"))
def target_edges(spark, d):
    return reports.target_edges(G.rule_edges(spark, d), TARGET, RULES).withColumn("weighted_phi", r("weighted_phi"))


S.cte("prev_raw", "answers", f"SELECT '{YEAR}_' || lpad(CAST(state_code AS VARCHAR), 2, '0') || '_{DEFINITION}_' || ses_category AS graph_id, ses_category, condition, count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok AND x = 1) AS n_cases, sum(CASE WHEN ok AND x = 1 THEN survey_weight ELSE 0 END) / nullif(sum(CASE WHEN ok THEN survey_weight ELSE 0 END), 0) AS p FROM answers WHERE ses_category IS NOT NULL GROUP BY ALL")
S.cte("target_prev", "prev_raw", f"SELECT o.condition, o.p, m, CASE WHEN mad > 0 THEN (o.p - m) / (CAST(1.4826 AS DOUBLE) * mad) END AS z, o.n_valid, o.n_cases FROM prev_raw o JOIN (SELECT condition, max(m) AS m, median(abs(p - m)) AS mad FROM (SELECT condition, p, median(p) OVER (PARTITION BY condition) AS m FROM prev_raw WHERE ses_category = 'lower' AND graph_id <> '{TARGET}') GROUP BY 1) USING (condition) WHERE o.graph_id = '{TARGET}'")
_TP = f"condition, {S.r('p')} AS weighted_prevalence, {S.r('m')} AS peer_median, {S.r('z', 6)} AS peer_robust_z, n_valid, n_cases"


def _target_prevalence(spark, d):
    nodes = settle(association.node_prevalence(G.populations(spark, d)))
    out = reports.target_prevalence(nodes, TARGET, F.col("graph_id").endswith("_lower"))
    return out.withColumns({"weighted_prevalence": r("weighted_prevalence"), "peer_median": r("peer_median"), "peer_robust_z": r("peer_robust_z", 6)})


@registered(S.query("target_prev", f"SELECT {_TP} FROM target_prev"))
def target_prevalence(spark, d):
    return _target_prevalence(spark, d)


@registered(S.query("target_prev", f"SELECT {_TP} FROM target_prev ORDER BY abs(round(z, 6)) DESC NULLS LAST, condition LIMIT 3"))
def largest_deviations(spark, d):
    return reports.largest_deviations(_target_prevalence(spark, d))


@registered(S.query("reg pairs", f"SELECT graph_id, n_unweighted, {S.r('k', 6)} AS kish_effective_n, {S.r('n_unweighted / k', 6)} AS design_effect, {S.r('pct')} AS percentile, (SELECT min(n_complete) FROM pairs WHERE graph_id = '{TARGET}') AS minimum_pair_complete_n, (SELECT count(*) FROM pairs WHERE graph_id = '{TARGET}' AND round(association, 9) >= CAST(0.12 AS DOUBLE) - CAST(0.02 AS DOUBLE) AND round(association, 9) < CAST(0.12 AS DOUBLE)) AS edges_just_below_threshold FROM (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY ses_category, round(k, 6)) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY ses_category) AS pct FROM (SELECT *, sw * sw / nullif(sw2, 0) AS k FROM reg WHERE eligibility_status = 'eligible') WINDOW w AS (PARTITION BY ses_category ORDER BY round(k, 6))) WHERE graph_id = '{TARGET}'"))
def target_summary(spark, d):
    out = reports.target_summary(G.registry(spark, d), G.pair_table(spark, d), TARGET, 0.12)
    return out.withColumns({"n_unweighted": F.col("n_unweighted").cast("long"), "kish_effective_n": r("kish_effective_n", 6), "design_effect": r("design_effect", 6), "percentile": r("percentile")})


@registered(S.query("stats", "SELECT graph_id, " + ", ".join(f"max(CASE WHEN rule_id = '{x}' THEN edge_count END) AS {x}" for x in RULES) + " FROM stats GROUP BY 1"))
def threshold_counts(spark, d):
    return reports.threshold_counts(graphs.statistics(G.all_graphs(spark, d)), RULES)


@registered(S.query("redundant", "SELECT node_count, " + ", ".join(f"count(*) FILTER (support_{n}) AS support_{n}" for n in M.NAMES) + " FROM redundant GROUP BY 1"))
def motif_size_by_level(spark, d):
    return reports.size_by_level(motifs.shape_summary(M.full_catalog(spark, d), M.FRACTIONS), [f"support_{n}" for n in M.NAMES])


@registered(S.query("raw_edges", f"SELECT CAST(floor((round(association, 9) - CAST({R.EFFECT} AS DOUBLE)) / CAST(0.01 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS edges, {S.r('median(p1)')} AS median_stability FROM raw_edges GROUP BY 1"))
def stability_bins(spark, d):
    return reports.stability_bins(R.raw_edges(spark, d), R.EFFECT).withColumn("median_stability", r("median_stability"))


S.cte("twodef", "pgraphs graphs_all", f"SELECT x.geography_code, x.ses_category, {S.bits('x.mask')} AS edges_a, {S.bits('y.mask')} AS edges_b, {S.jaccard('x.mask', 'y.mask')} AS edge_jaccard FROM pgraphs x JOIN graphs_all y ON y.geography_code = x.geography_code AND y.ses_category = x.ses_category AND y.rule_id = 'phi_014'")
null_z("twodefz", "twodef")


@registered(S.query("twodefz", f"SELECT geography_code, ses_category, edges_a, edges_b, {S.r('edge_jaccard')} AS edge_jaccard, {S.r('null_expected', 7)} AS null_expected, {S.r('density_z', 7)} AS density_z FROM twodefz"))
def definition_sensitivity(spark, d):
    two = reports.definition_sensitivity(G.population_graphs(spark, d), G.all_graphs(spark, d).where("rule_id = 'phi_014'"))
    out = graphs.density_null(settle(two), 45)
    return out.select("geography_code", "ses_category", "edges_a", "edges_b", r("edge_jaccard").alias("edge_jaccard"), r("null_expected", 7).alias("null_expected"), r("density_z", 7).alias("density_z"))


@registered(S.query("edges_of", "SELECT graph_id, '[' || string_agg('[\"' || a || '\",\"' || b || '\"]', ',' ORDER BY edge_idx) || ']' AS edges_json FROM edges_of WHERE rule_id = 'phi_012' GROUP BY 1"))
def graph_json(spark, d):
    g = graphs.masks(G.pair_table(spark, d)).where("mask <> 0")
    return g.select("graph_id", F.to_json(motifs.motif_edges(F.col("mask"))).alias("edges_json"))


# --- protocol checks -------------------------------------------------------------------------------------


@registered(S.query("stab", f"SELECT count(*) FILTER (edge_present) AS frozen_edges, count(*) FILTER (edge_present AND NOT coalesce(association >= CAST({R.EFFECT} AS DOUBLE) AND p1 >= CAST({R.STABLE} AS DOUBLE) AND pair_eligible, false)) AS violations FROM stab"))
def frozen_graphs(spark, d):
    return protocol.frozen_violations(R.stable_table(spark, d), R.EFFECT, R.STABLE)


@registered(S.query("named patterns", f"SELECT count(*) FILTER (motif_id NOT LIKE 'motif_%') AS wrong_ids, count(*) FILTER (mask NOT IN (SELECT mask FROM patterns)) AS unconnected, count(*) FILTER (support_fraction < CAST({M.PRIMARY} AS DOUBLE)) AS below_support, count(*) - count(DISTINCT motif_id) AS doubled_ids FROM named"))
def protocol_motifs(spark, d):
    return protocol.motif_violations(M.full_catalog(spark, d).select("motif_id", "mask", "support_fraction"), M.PRIMARY)


@registered(S.query("redundant", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unknown, count(*) - count(DISTINCT motif_id) AS in_two_families FROM redundant"))
def protocol_families(spark, d):
    c = M.full_catalog(spark, d)
    return protocol.partition_violations(c.select("motif_id"), c.select("occurrence_class_id", "motif_id"))


@registered(f"SELECT c_nationkey AS state_code, count(*) AS n_unweighted, {S.r(f'sum(CASE WHEN {S.VALID} THEN survey_weight ELSE 0 END)', 2)} AS weighted_population_estimate, count(*) FILTER (NOT {S.VALID}) AS n_invalid_weight FROM (SELECT c_nationkey, c_acctbal AS survey_weight FROM customer) GROUP BY 1")
def audit_stream(spark, d):
    """Running totals by Structured Streaming over the files that are there, then stopped."""
    path = f"{d.rstrip('/')}/customer.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path}*").selectExpr("c_nationkey AS state_code", "c_acctbal AS survey_weight")
    folder = shared_folder(spark, "stream")
    name = f"totals_{folder[-32:]}"
    audit.start(stream, name, folder).awaitTermination()
    return spark.table(name).withColumn("weighted_population_estimate", r("weighted_population_estimate", 2))


@registered(S.query("vrep", "SELECT 'discovery_support_fraction' AS field, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS doubled, count(*) FILTER (NOT coalesce(abs(frac - discovery_support_fraction) <= CAST(1e-12 AS DOUBLE), false)) AS mismatches FROM vrep"))
def provenance_check(spark, d):
    """The frozen support of motifs against that of another year: all but those of equal support differ."""
    rep, words = M.replication(spark, d)
    return protocol.provenance_violations(words, rep.select("motif_id", "replication_support_fraction"), "motif_id", {"replication_support_fraction": "discovery_support_fraction"})


@registered(
    S.query(
        "hyp hres named",
        """SELECT count(*) - count(DISTINCT hypothesis_id) AS doubled_ids, count(DISTINCT family_order) < count(*) OR min(family_order) <> 1 OR max(family_order) <> count(*) AS wrong_order,
  count(*) FILTER (NOT coalesce(direction_sign = CASE WHEN e > 0 THEN 1 WHEN e < 0 THEN -1 END, false)) AS wrong_signs, count(*) FILTER (motif_id IS NULL) AS unknown_motifs,
  count(*) FILTER (n.edge_count <> bit_count(h.mask)) AS other_edges
FROM hyp h LEFT JOIN (SELECT hypothesis_id, avg(difference) AS e FROM hres GROUP BY 1) x USING (hypothesis_id) LEFT JOIN named n ON n.mask = h.mask""",
    )
)
def protocol_hypotheses(spark, d):
    """The hypotheses against the given data: their motifs must be in the mined catalog, and their side the one that has more."""
    named = motifs.named(M.hypotheses(spark))
    res = inference.residuals(M.pairs(spark, d), M.hypotheses(spark).select("hypothesis_id", "mask"))
    e = res.groupBy("hypothesis_id").agg(F.avg("difference").alias("e"))
    side = F.when(F.col("e") > 0, "lower").when(F.col("e") < 0, "higher")
    asked = named.join(e, "hypothesis_id", "left").withColumn("expected_enrichment", side)
    return protocol.hypothesis_violations(asked, motifs.named(M.catalog(spark, d)).select("motif_id", "edge_list"))
