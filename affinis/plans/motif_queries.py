"""Queries of the motif and inference operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import r
from affinis.operators import graphs, inference, motifs
from affinis.operators.tables import settle
from affinis.plans import graph_queries as G
from affinis.plans import sqlbase as S
from affinis.plans.register import registered, shared
from affinis.sources.bridge import CONDITIONS, MINIMUM_PAIRED_STATES

#: Support levels of the catalog, and the one whose motifs are tested further.
FRACTIONS, PRIMARY = (0.10, 0.20, 0.30), 0.20
NAMES = [f"{round(f * 100):02d}pct" for f in FRACTIONS]
#: Sign flips of the screening and of the confirmatory tests, and fixed-edge null graphs of each population.
FLIPS, BANK, NULLS, SEED = 9_999, 99_999, 1_000, 20240904
#: Three directional hypotheses: edge lists, expected side (+1: lower).
HYPOTHESES = [("H1", 1, 1, [("COND_A", "COND_B"), ("COND_A", "COND_C")]), ("H2", 2, -1, [("COND_B", "COND_H"), ("COND_D", "COND_E"), ("COND_B", "COND_D")]), ("H3", 3, 1, [("COND_D", "COND_E"), ("COND_E", "COND_F"), ("COND_D", "COND_F")])]


def _mask(edges: list[tuple[str, str]]) -> int:
    at = {e: i for i, e in enumerate(graphs.pairs_of(CONDITIONS))}
    return sum(1 << at[tuple(sorted(e))] for e in edges)


S.cte("un", "universe", "SELECT edge_idx, a, b, bit, (CAST(1 AS BIGINT) << (ascii(right(a, 1)) - 65)) | (CAST(1 AS BIGINT) << (ascii(right(b, 1)) - 65)) AS nm FROM universe")
S.cte("conn", "un", "SELECT bit AS mask, nm FROM un UNION SELECT c.mask | u.bit, c.nm | u.nm FROM conn c JOIN un u ON c.mask & u.bit = 0 AND c.nm & u.nm <> 0 AND bit_count(c.nm | u.nm) <= 5")
S.cte("patterns", "conn", "SELECT mask, CAST(bit_count(nm) AS INTEGER) AS node_count, CAST(bit_count(mask) AS INTEGER) AS edge_count FROM conn WHERE bit_count(nm) >= 3")
_SP = "SELECT l.geography_code, l.graph_id AS lower_id, h.graph_id AS higher_id, l.mask AS lower, h.mask AS higher, l.opportunity AS o1, h.opportunity AS o2, l.opportunity & h.opportunity AS opp FROM {0} l JOIN {0} h USING (geography_code) WHERE l.ses_category = 'lower' AND h.ses_category = 'higher'"
S.cte("spairs", "pgraphs", _SP.format("pgraphs"))


def _catalog(name: str, needs: str, pairs: str, cands: str, where: str = "") -> None:
    S.cte(f"{name}_n", f"{needs}", f"SELECT mask, node_count, edge_count, count(*) AS paired_state_count, {S.big('sum(CASE WHEN lower & mask = mask THEN 1 ELSE 0 END + CASE WHEN higher & mask = mask THEN 1 ELSE 0 END)')} AS support_count, count(*) FILTER (lower & mask = mask OR higher & mask = mask) AS distinct_state_support_count FROM {cands} JOIN {pairs} ON opp & mask = mask GROUP BY ALL")
    limits = ", ".join(f"CAST(ceil(CAST({f} AS DOUBLE) * 2 * paired_state_count) AS BIGINT) AS support_count_{n}" for f, n in zip(FRACTIONS, NAMES, strict=True))
    flags = ", ".join(f"support_count >= support_count_{n} AS support_{n}" for n in NAMES)
    S.cte(name, f"{name}_n", f"SELECT *, {flags} FROM (SELECT *, 2 * paired_state_count AS evaluable_graph_count, support_count / CAST(2 * paired_state_count AS DOUBLE) AS support_fraction, {limits} FROM {name}_n) WHERE paired_state_count >= {MINIMUM_PAIRED_STATES} AND support_count >= support_count_{NAMES[0]} {where}")


_catalog("catalog", "patterns spairs", "spairs", "patterns")
S.cte("occ", "catalog spairs", "SELECT mask, lower_id AS graph_id FROM catalog JOIN spairs ON opp & mask = mask AND lower & mask = mask UNION ALL SELECT mask, higher_id FROM catalog JOIN spairs ON opp & mask = mask AND higher & mask = mask")
S.cte("occ_class", "occ", "SELECT mask, '[\"' || string_agg(graph_id, '\",\"' ORDER BY graph_id) || '\"]' AS graph_ids, 'occ_' || substr(sha256('[\"' || string_agg(graph_id, '\",\"' ORDER BY graph_id) || '\"]'), 1, 16) AS occurrence_class_id FROM occ GROUP BY mask")
S.cte("medges", "catalog un", "SELECT mask, '[' || string_agg('[\"' || a || '\",\"' || b || '\"]', ',' ORDER BY edge_idx) || ']' AS edge_list FROM catalog JOIN un ON mask & bit <> 0 GROUP BY mask")
S.cte("mnodes", "catalog un", "SELECT mask, '[\"' || string_agg(node, '\",\"' ORDER BY node) || '\"]' AS node_labels FROM (SELECT mask, a AS node FROM catalog JOIN un ON mask & bit <> 0 UNION SELECT mask, b FROM catalog JOIN un ON mask & bit <> 0) GROUP BY mask")
S.cte("named", "catalog medges mnodes", "SELECT c.*, edge_list, node_labels, 'motif_' || substr(sha256('{\"edges\":' || edge_list || ',\"nodes\":' || node_labels || '}'), 1, 16) AS motif_id FROM catalog c JOIN medges USING (mask) JOIN mnodes USING (mask)")
S.cte(
    "redundant",
    "named occ_class",
    """SELECT c.*, occurrence_class_id, count(*) OVER (PARTITION BY occurrence_class_id) AS occurrence_class_size, row_number() OVER (PARTITION BY occurrence_class_id ORDER BY node_count DESC, edge_count DESC, motif_id) = 1 AS is_occurrence_representative,
       NOT EXISTS (SELECT 1 FROM catalog d JOIN occ_class e ON e.mask = d.mask WHERE d.mask & c.mask = c.mask AND d.mask <> c.mask AND e.occurrence_class_id = o.occurrence_class_id) AS is_closed,
       NOT EXISTS (SELECT 1 FROM catalog d WHERE d.mask & c.mask = c.mask AND d.mask <> c.mask) AS is_maximal
  FROM named c JOIN occ_class o USING (mask)""",
)
_COUNTS = ["node_count", "edge_count", "paired_state_count", "evaluable_graph_count", "support_count", "distinct_state_support_count", *[f"support_count_{n}" for n in NAMES], *[f"support_{n}" for n in NAMES]]


@shared
def catalog(spark: SparkSession, d: str) -> DataFrame:
    return settle(motifs.mine(G.population_graphs(spark, d), MINIMUM_PAIRED_STATES, FRACTIONS))


@shared
def full_catalog(spark: SparkSession, d: str) -> DataFrame:
    return settle(motifs.redundancy(motifs.named(catalog(spark, d))))


@shared
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return settle(motifs.state_pairs(G.population_graphs(spark, d)))


@registered(S.query("patterns pgraphs", "SELECT node_count, edge_count, count(*) AS n, bit_xor(mask) AS xor_of_masks FROM patterns WHERE mask & (SELECT bit_or(opportunity) FROM pgraphs) = mask GROUP BY ALL"))
def connected_patterns(spark, d):
    """Patterns whose pairs may all be edges somewhere, by size."""
    able = G.population_graphs(spark, d).agg(F.coalesce(F.bit_or("opportunity"), F.lit(0).cast("long")).alias("able"))
    return motifs.connected_masks(spark).crossJoin(F.broadcast(able)).where(F.col("mask").bitwiseAND(F.col("able")) == F.col("mask")).groupBy("node_count", "edge_count").agg(F.count("*").alias("n"), F.bit_xor("mask").alias("xor_of_masks"))


@registered(S.query("pgraphs patterns", "SELECT p.mask, node_count, edge_count, count(*) AS support_count FROM patterns p JOIN pgraphs g ON g.mask & p.mask = p.mask GROUP BY ALL HAVING count(*) >= 8"))
def frequent_motifs(spark, d):
    return motifs.frequent(G.population_graphs(spark, d).select("mask"), 8)


S.cte("pedges", "patterns un", "SELECT mask, '[' || string_agg('[\"' || a || '\",\"' || b || '\"]', ',' ORDER BY edge_idx) || ']' AS edge_list FROM patterns JOIN un ON mask & bit <> 0 GROUP BY mask")


@registered(S.query("pgraphs patterns pedges", "SELECT edge_list, node_count, edge_count, support_count FROM (SELECT p.mask, node_count, edge_count, count(*) AS support_count FROM patterns p JOIN pgraphs g ON g.mask & p.mask = p.mask GROUP BY ALL HAVING count(*) >= 8) JOIN pedges USING (mask)"))
def grown_motifs(spark, d):
    """The motifs of frequent_motifs by growth, whose patterns are lists of edges and need no mask of all pairs."""
    g = G.population_graphs(spark, d)
    edges = F.transform(motifs.motif_edges(F.col("mask")), lambda e: F.struct(e[0].alias("a"), e[1].alias("b")))
    found = motifs.grown(g.select("graph_id", edges.alias("edges")), 8)
    return found.select(F.to_json(F.transform("edges", lambda e: F.array(e["a"], e["b"]))).alias("edge_list"), "node_count", "edge_count", "support_count")


@registered(S.query("catalog", f"SELECT mask, {', '.join(_COUNTS)}, {S.r('support_fraction')} AS support_fraction FROM catalog"))
def motif_support(spark, d):
    return catalog(spark, d).select("mask", *_COUNTS, r("support_fraction").alias("support_fraction"))


@registered(S.query("named", "SELECT mask, motif_id, edge_list, node_labels FROM named"))
def motif_identity(spark, d):
    return motifs.named(catalog(spark, d)).select("mask", "motif_id", "edge_list", "node_labels")


@registered(S.query("redundant", "SELECT motif_id, occurrence_class_id, occurrence_class_size, is_closed, is_maximal, is_occurrence_representative FROM redundant"))
def motif_redundancy(spark, d):
    return full_catalog(spark, d).select("motif_id", "occurrence_class_id", "occurrence_class_size", "is_closed", "is_maximal", "is_occurrence_representative")


_SHAPE = {"tree_fraction": "avg(CASE WHEN edge_count = node_count - 1 THEN 1 ELSE 0 END)", "clique_fraction": "avg(CASE WHEN 2 * edge_count = node_count * (node_count - 1) THEN 1 ELSE 0 END)", "median_edge_count": "median(edge_count)", "median_motif_density": "median(edge_count / (node_count * (node_count - 1) / CAST(2 AS DOUBLE)))"}


@registered(S.query("redundant", " UNION ALL ".join(f"SELECT 'support_{n}' AS support_level, node_count, count(*) AS motif_count, count(*) FILTER (is_closed) AS closed_motif_count, count(*) FILTER (is_maximal) AS maximal_motif_count, count(DISTINCT occurrence_class_id) AS occurrence_class_count, " + ", ".join(f"{S.r(v)} AS {k}" for k, v in _SHAPE.items()) + f" FROM redundant WHERE support_{n} GROUP BY node_count" for n in NAMES)))
def motif_shape(spark, d):
    return motifs.shape_summary(full_catalog(spark, d), FRACTIONS).withColumns({k: r(k) for k in _SHAPE})


@registered(S.query("spairs patterns", "SELECT mask, count(*) AS paired_state_count FROM patterns JOIN spairs ON opp & mask = mask WHERE node_count = 3 GROUP BY mask"))
def motif_evaluability(spark, d):
    m = motifs.connected_masks(spark, (3,)).select("mask")
    return motifs.evaluability(pairs(spark, d), m).select("mask", "paired_state_count")


@registered(S.query("occ named", "SELECT motif_id, graph_id FROM occ JOIN named USING (mask)"))
def motif_occurrences(spark, d):
    return motifs.named(catalog(spark, d)).select("motif_id", F.explode("graph_ids").alias("graph_id"))


@registered(S.query("catalog", "SELECT count(*) AS motif_count, CAST(0 AS BIGINT) AS changed_by_swap FROM catalog"))
def swap_invariance(spark, d):
    g = G.population_graphs(spark, d)
    keep = ["mask", "paired_state_count", "support_count", "distinct_state_support_count"]
    a = settle(motifs.mine(g, MINIMUM_PAIRED_STATES, FRACTIONS).select(*keep))
    b = settle(motifs.mine(motifs.swapped(g), MINIMUM_PAIRED_STATES, FRACTIONS).select(*keep))
    changed = a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("changed_by_swap"))
    return a.agg(F.count("*").alias("motif_count")).crossJoin(changed)


@registered(S.query("graphs un", "SELECT CAST(row_number() OVER (ORDER BY graph_id) - 1 AS INTEGER) AS graph_idx, graph_id, 't # ' || (row_number() OVER (ORDER BY graph_id) - 1) || chr(10) || '" + "' || chr(10) || '".join(f"v {i} {i + 1}" for i in range(10)) + "' || coalesce((SELECT string_agg(chr(10) || 'e ' || (ascii(right(a, 1)) - 65) || ' ' || (ascii(right(b, 1)) - 65) || ' 1', '' ORDER BY edge_idx) FROM un WHERE mask & bit <> 0), '') AS block FROM graphs"))
def graph_database(spark, d):
    g = graphs.masks(G.pair_table(spark, d))
    return motifs.database_lines(g).withColumn("graph_idx", F.col("graph_idx").cast("int"))


@registered("SELECT n, CAST(f AS DOUBLE) AS fraction, CAST(ceil(CAST(f AS DOUBLE) * n) AS BIGINT) AS minimum_support FROM (SELECT unnest([10, 38, 94]) AS n) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3]) AS f)")
def support_counts(spark, d):
    rows = [(n, f, c) for n in (10, 38, 94) for f, c in motifs.support_thresholds(n).items()]
    return spark.createDataFrame(rows, "n int, fraction double, minimum_support long")


# --- density residuals and tests -------------------------------------------------------------------------


def _chance(n: str, m: str, k: str) -> str:
    return f"(CASE WHEN {k} > {n} OR {m} < {k} THEN CAST(0 AS DOUBLE) ELSE list_product(list_transform(range(0, CAST({k} AS BIGINT)), lambda i: ({m} - i) / CAST({n} - i AS DOUBLE))) END)"


@registered(f"SELECT n, m, r, {S.r(_chance('n', 'm', 'r'))} AS probability FROM (SELECT unnest([6, 10, 45]) AS n) CROSS JOIN (SELECT unnest([2, 3, 6]) AS m) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS r)")
def occurrence_probability(spark, d):
    grid = spark.createDataFrame([(n, m, k) for n in (6, 10, 45) for m in (2, 3, 6) for k in (1, 2, 3, 4)], "n int, m int, r int")
    return grid.select("n", "m", "r", r(inference.occurrence_probability(F.col("n"), F.col("m"), F.col("r"))).alias("probability"))


_RES = f"SELECT geography_code, {{m}}, lower & mask = mask AS lower_occurs, higher & mask = mask AS higher_occurs, CASE WHEN lower & mask = mask THEN 1 ELSE 0 END - {_chance('bit_count(o1)', 'bit_count(lower)', 'bit_count(mask)')} AS lower_residual, CASE WHEN higher & mask = mask THEN 1 ELSE 0 END - {_chance('bit_count(o2)', 'bit_count(higher)', 'bit_count(mask)')} AS higher_residual FROM {{f}} JOIN spairs ON opp & mask = mask"
S.cte("primary_motifs", "named", "SELECT motif_id, mask, node_count, edge_count, support_count FROM named WHERE support_20pct")
S.cte("res0", "primary_motifs spairs", _RES.format(m="motif_id", f="primary_motifs"))
S.cte("res", "res0", "SELECT *, lower_residual - higher_residual AS difference FROM res0")


@shared
def primary(spark: SparkSession, d: str) -> DataFrame:
    return settle(motifs.named(catalog(spark, d)).where("support_20pct").select("motif_id", "mask", "node_count", "edge_count", "support_count"))


def residual_table(spark: SparkSession, d: str) -> DataFrame:
    return inference.residuals(pairs(spark, d), primary(spark, d).select("motif_id", "mask"))


@registered(S.query("res", f"SELECT motif_id, geography_code, {S.r('lower_residual')} AS lower_residual, {S.r('higher_residual')} AS higher_residual, {S.r('difference')} AS difference FROM res"))
def density_residuals(spark, d):
    return residual_table(spark, d).select("motif_id", "geography_code", *[r(c).alias(c) for c in ("lower_residual", "higher_residual", "difference")])


def _t(n: str, s: str, ss: str) -> str:
    var = f"(({ss} - {n} * ({s} / {n}) * ({s} / {n})) / nullif({n} - 1, 0))"
    return f"(CASE WHEN {n} > 1 AND {var} > CAST(1e-18 AS DOUBLE) THEN ({s} / {n}) / sqrt({var} / {n}) WHEN abs({s} / {n}) < CAST(1e-12 AS DOUBLE) THEN 0 ELSE sign({s}) * CAST('Infinity' AS DOUBLE) END)"


S.cte("tstat", "res", f"SELECT motif_id, CAST(n AS BIGINT) AS state_pair_count, lo AS lower_support_count, hi AS higher_support_count, (lo - hi) / n AS raw_difference, ml, mh, s / n AS mean_difference, {_t('n', 's', 'ss')} AS t FROM (SELECT motif_id, CAST(count(*) AS DOUBLE) AS n, sum(difference) AS s, sum(difference * difference) AS ss, count(*) FILTER (lower_occurs) AS lo, count(*) FILTER (higher_occurs) AS hi, avg(lower_residual) AS ml, avg(higher_residual) AS mh FROM res GROUP BY motif_id)")
_T = {"raw_support_fraction_difference": "raw_difference", "density_residual_mean_lower": "ml", "density_residual_mean_higher": "mh", "paired_density_residual_difference": "mean_difference", "paired_density_residual_t": "t"}


@registered(S.query("tstat", "SELECT motif_id, state_pair_count, lower_support_count, higher_support_count, " + ", ".join(f"{S.r(v, 7)} AS {k}" for k, v in _T.items()) + " FROM tstat"))
def paired_t(spark, d):
    return inference.paired_t(residual_table(spark, d), ["motif_id"]).withColumns({k: r(k, 7) for k in _T})


S.cte("signs", "spairs", f"SELECT p AS permutation, geography_code, CASE WHEN substr(md5('{SEED}|' || p || '|' || geography_code), 1, 1) >= '8' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS sgn FROM (SELECT unnest(range(1, {FLIPS + 1})) AS p) CROSS JOIN spairs")
S.cte("bank", "spairs", f"SELECT p AS permutation, geography_code, CASE WHEN substr(md5('{SEED}|' || p || '|' || geography_code), 1, 1) >= '8' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS sgn FROM (SELECT unnest(range(1, {BANK + 1})) AS p) CROSS JOIN spairs")
S.cte("flips", "res signs", f"SELECT motif_id, permutation, round({_t('n', 's', 'ss')}, 9) AS t FROM (SELECT motif_id, permutation, CAST(count(*) AS DOUBLE) AS n, sum(difference * sgn) AS s, sum(difference * difference) AS ss FROM res JOIN signs USING (geography_code) GROUP BY ALL)")
S.cte("maxt", "flips tstat", f"SELECT motif_id, (1 + count(*) FILTER (abs(f.t) >= abs(round(o.t, 9)))) / CAST({FLIPS + 1} AS DOUBLE) AS p, (1 + count(*) FILTER (top >= abs(round(o.t, 9)))) / CAST({FLIPS + 1} AS DOUBLE) AS q FROM (SELECT *, max(abs(t)) OVER (PARTITION BY permutation) AS top FROM flips) f JOIN tstat o USING (motif_id) GROUP BY motif_id")
S.cte("maxt_bh", "maxt", "SELECT *, least(1, min(p * m / rn) OVER (ORDER BY p, motif_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh0 FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, motif_id) AS rn FROM maxt)")


@registered(S.query("maxt_bh", f"SELECT motif_id, {S.r('p')} AS permutation_p_value, {S.r('q')} AS permutation_max_t_p_value, {S.r('bh0')} AS permutation_bh_q_value, {S.r(f'sqrt(p * (1 - p) / {FLIPS + 1})')} AS permutation_p_value_mcse, {S.r(f'sqrt(q * (1 - q) / {FLIPS + 1})')} AS permutation_max_t_p_value_mcse FROM maxt_bh"))
def maxt_permutation(spark, d):
    p = pairs(spark, d)
    res = settle(inference.residuals(p, primary(spark, d).select("motif_id", "mask")))
    signs = inference.HashSigns(inference.state_list(p), FLIPS, SEED)
    cols = ["permutation_p_value", "permutation_max_t_p_value", "permutation_bh_q_value", "permutation_p_value_mcse", "permutation_max_t_p_value_mcse"]
    return inference.permutation_test(res, signs, FLIPS, ["motif_id"]).select("motif_id", *[r(c).alias(c) for c in cols])


S.cte("hyp", "", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {o}, {s}, CAST({_mask(e)} AS BIGINT))" for h, o, s, e in HYPOTHESES) + ") t(hypothesis_id, family_order, direction_sign, mask)")
S.cte("hres0", "hyp spairs", _RES.format(m="hypothesis_id", f="hyp"))
S.cte("hres", "hres0", "SELECT *, lower_residual - higher_residual AS difference FROM hres0")


def hypotheses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, o, s, _mask(e)) for h, o, s, e in HYPOTHESES], "hypothesis_id string, family_order int, direction_sign int, mask long")


@registered(S.query("hres", "SELECT geography_code, " + ", ".join(f"{S.r(f'max(CASE WHEN hypothesis_id = {chr(39)}{h[0]}{chr(39)} THEN difference END)')} AS {h[0].lower()}" for h in HYPOTHESES) + " FROM hres GROUP BY 1"))
def state_differences(spark, d):
    res = inference.residuals(pairs(spark, d), hypotheses(spark).select("hypothesis_id", "mask"))
    p = res.groupBy("geography_code").pivot("hypothesis_id", [h[0] for h in HYPOTHESES]).agg(F.max("difference"))
    return p.select("geography_code", *[r(h[0]).alias(h[0].lower()) for h in HYPOTHESES])


def _directional(name: str, where: str) -> str:
    S.cte(f"{name}_obs", "hyp hres", f"SELECT h.hypothesis_id, family_order, direction_sign, n, s / n AS effect, CASE WHEN n >= {MINIMUM_PAIRED_STATES} THEN round({_t('n', 's', 'ss')}, 9) END AS t0 FROM hyp h LEFT JOIN (SELECT hypothesis_id, CAST(count(*) AS DOUBLE) AS n, sum(difference) AS s, sum(difference * difference) AS ss FROM hres WHERE {where} GROUP BY 1) x USING (hypothesis_id)")
    S.cte(f"{name}_flips", "hres bank", f"SELECT hypothesis_id, permutation, round({_t('n', 's', 'ss')}, 9) AS t FROM (SELECT hypothesis_id, permutation, CAST(count(*) AS DOUBLE) AS n, sum(difference * sgn) AS s, sum(difference * difference) AS ss FROM hres JOIN bank USING (geography_code) WHERE {where} GROUP BY ALL)")
    S.cte(f"{name}_p", f"{name}_obs {name}_flips", f"SELECT o.*, CASE WHEN n >= {MINIMUM_PAIRED_STATES} THEN (1 + (SELECT count(*) FROM {name}_flips f WHERE f.hypothesis_id = o.hypothesis_id AND o.direction_sign * f.t >= o.direction_sign * o.t0)) / CAST({BANK + 1} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS p, coalesce(n, 0) >= {MINIMUM_PAIRED_STATES} AS tested FROM {name}_obs o")
    S.cte(f"{name}_h", f"{name}_p", f"SELECT *, least(1, max(raw) OVER (ORDER BY p, family_order ROWS UNBOUNDED PRECEDING)) AS holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, family_order) + 1) * p AS raw FROM {name}_p)")
    return f"SELECT hypothesis_id, family_order, direction_sign, CAST(coalesce(n, 0) AS BIGINT) AS state_pair_count, {S.r('effect')} AS effect_lower_minus_higher, {S.r('t0')} AS studentized_statistic, {S.r('p')} AS one_sided_p_value, CASE WHEN tested THEN 'tested' ELSE 'insufficient_opportunity' END AS test_status, {S.r('holm')} AS holm_adjusted_p_value, {S.r(f'sqrt(p * (1 - p) / {BANK + 1})')} AS p_value_mcse, coalesce(direction_sign * effect > 0, false) AS direction_concordant"


_CONF = _directional("prim", "true"), _directional("sens", "geography_code <= 9")
_RULE = "tested AND coalesce(direction_sign * effect > 0, false) AND holm <= CAST(0.05 AS DOUBLE)"


@registered(S.query("prim_h sens_h", f"{_CONF[0]}, {_RULE} AS replicated, 'primary' AS analysis_set FROM prim_h UNION ALL {_CONF[1]}, false, 'matched' FROM sens_h"))
def sign_flip_test(spark, d):
    p = pairs(spark, d)
    h = hypotheses(spark)
    res = settle(inference.residuals(p, h.select("hypothesis_id", "mask")))
    signs = inference.HashSigns(inference.state_list(p), BANK, SEED)
    a = inference.directional_test(res, h.drop("mask"), signs, BANK, MINIMUM_PAIRED_STATES, 0.05, True).withColumn("analysis_set", F.lit("primary"))
    b = inference.directional_test(res.where("geography_code <= 9"), h.drop("mask"), signs, BANK, MINIMUM_PAIRED_STATES, 0.05, False).withColumn("analysis_set", F.lit("matched"))
    cols = ["effect_lower_minus_higher", "studentized_statistic", "one_sided_p_value", "holm_adjusted_p_value", "p_value_mcse"]
    out = a.unionByName(b).withColumns({c: r(c) for c in cols})
    return out.select("hypothesis_id", "family_order", "direction_sign", "state_pair_count", *cols, "test_status", "direction_concordant", "replicated", "analysis_set")


@registered()
def sign_bank(spark, d):
    """Bit-exact PCG64 signs: held against the archived p-values in tests."""
    states = [r_.geography_code for r_ in pairs(spark, d).select("geography_code").orderBy("geography_code").collect()]  # states: a dimension
    return inference.bank_frame(spark, states, BANK, 20230904)


# --- replication -----------------------------------------------------------------------------------------

S.cte("ngraphs", "graphs_all reg", "SELECT g.graph_id, g.geography_code, g.ses_category, g.mask, g.opportunity FROM graphs_all g JOIN reg USING (graph_id) WHERE rule_id = 'phi_014' AND eligibility_status = 'eligible'")
S.cte("npairs", "ngraphs", _SP.format("ngraphs"))
S.cte("vocab", "redundant", "SELECT motif_id, mask, occurrence_class_id, is_occurrence_representative, support_fraction AS discovery_support_fraction FROM redundant WHERE support_20pct")
S.cte("vrep0", "vocab npairs", f"SELECT v.*, n, s, ds FROM vocab v LEFT JOIN (SELECT motif_id, count(*) AS n, {S.big('sum(CASE WHEN lower & mask = mask THEN 1 ELSE 0 END + CASE WHEN higher & mask = mask THEN 1 ELSE 0 END)')} AS s, count(*) FILTER (lower & mask = mask OR higher & mask = mask) AS ds FROM vocab JOIN npairs ON opp & mask = mask GROUP BY 1) USING (motif_id)")
S.cte("vrep", "vrep0", f"SELECT *, frac - discovery_support_fraction AS diff, n1 >= {MINIMUM_PAIRED_STATES} AND coalesce(frac >= CAST(0.20 AS DOUBLE), false) AS replicated FROM (SELECT *, coalesce(n, 0) AS n1, s / CAST(2 * n AS DOUBLE) AS frac FROM vrep0)")


def replication(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cat = settle(full_catalog(spark, d).where("support_20pct"))
    words = cat.select("motif_id", "mask", "occurrence_class_id", "is_occurrence_representative", F.col("support_fraction").alias("discovery_support_fraction"))
    new = G.all_graphs(spark, d).where("rule_id = 'phi_014'")
    new = new.join(G.registry(spark, d).where("eligibility_status = 'eligible'").select("graph_id"), "graph_id", "left_semi")
    found = motifs.evaluability(settle(motifs.state_pairs(new)), words.select("mask"))
    return inference.vocabulary(found, words, 0.20, MINIMUM_PAIRED_STATES), words


@registered(S.query("vrep", f"SELECT motif_id, n1 AS replication_paired_state_count, coalesce(s, 0) AS replication_support_count, coalesce(ds, 0) AS replication_distinct_state_support_count, {S.r('frac')} AS replication_support_fraction, {S.r('diff')} AS support_fraction_difference, replicated FROM vrep"))
def vocab_replication(spark, d):
    rep, _ = replication(spark, d)
    return rep.select("motif_id", "replication_paired_state_count", "replication_support_count", "replication_distinct_state_support_count", r("replication_support_fraction").alias("replication_support_fraction"), r("support_fraction_difference").alias("support_fraction_difference"), "replicated")


S.cte("vrank", "vrep", f"SELECT *, rank() OVER (ORDER BY round(discovery_support_fraction, 9)) + (count(*) OVER (PARTITION BY round(discovery_support_fraction, 9)) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (ORDER BY round(frac, 9)) + (count(*) OVER (PARTITION BY round(frac, 9)) - 1) / CAST(2 AS DOUBLE) AS ry FROM vrep WHERE n1 >= {MINIMUM_PAIRED_STATES} AND frac IS NOT NULL")


@registered(S.query("vrep vrank", f"SELECT count(*) AS frozen_motif_count, count(*) FILTER (replicated) AS replicated_motif_count, {S.r('avg(CASE WHEN replicated THEN 1 ELSE 0 END)')} AS retention_fraction, min(n1) AS minimum_state_pair_count, (SELECT {S.r('CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END', 7)} FROM vrank) AS support_spearman_correlation, {S.r('median(abs(diff))')} AS median_absolute_support_difference FROM vrep"))
def vocab_summary(spark, d):
    rep, _ = replication(spark, d)
    out = inference.vocabulary_summary(rep, MINIMUM_PAIRED_STATES)
    return out.withColumns({"retention_fraction": r("retention_fraction"), "support_spearman_correlation": r("support_spearman_correlation", 7), "median_absolute_support_difference": r("median_absolute_support_difference")})


_FAM = ["minimum_replication_support", "median_replication_support", "maximum_replication_support", "representative_replication_support_fraction"]


@registered(S.query("vrep", f"SELECT f.occurrence_class_id, f.motif_id AS representative_motif_id, g.c AS replication_member_count, g.k AS replicated_member_count, {S.r('g.lo')} AS minimum_replication_support, {S.r('g.md')} AS median_replication_support, {S.r('g.hi')} AS maximum_replication_support, {S.r('f.frac')} AS representative_replication_support_fraction, f.replicated AS representative_replicated FROM vrep f JOIN (SELECT occurrence_class_id, count(*) AS c, count(*) FILTER (replicated) AS k, min(frac) AS lo, median(frac) AS md, max(frac) AS hi FROM vrep GROUP BY 1) g USING (occurrence_class_id) WHERE f.is_occurrence_representative"))
def family_summary(spark, d):
    rep, words = replication(spark, d)
    fam = words.where("is_occurrence_representative").select("occurrence_class_id", F.col("motif_id").alias("representative_motif_id"))
    return inference.family_summary(settle(rep), fam).withColumns({c: r(c) for c in _FAM})


# --- null models -----------------------------------------------------------------------------------------


def _fixed(table: str) -> str:
    h = f"CAST('0x' || substr(md5('{SEED}|' || rep || '|' || graph_id || '|' || edge_idx), 1, 8) AS BIGINT)"
    return f"SELECT rep AS replicate, graph_id, geography_code, {S.big('sum(CASE WHEN rn <= k THEN bit ELSE 0 END)')} AS mask FROM (SELECT rep, graph_id, geography_code, bit, bit_count(mask) AS k, row_number() OVER (PARTITION BY rep, graph_id ORDER BY {h}, edge_idx) AS rn FROM {table} CROSS JOIN (SELECT unnest(range(1, {NULLS + 1})) AS rep) JOIN universe ON opportunity & bit <> 0) GROUP BY ALL"


S.cte("fixed", "pgraphs universe", _fixed("pgraphs"))


@registered(S.query("fixed", "SELECT CAST(replicate AS INTEGER) AS replicate, graph_id, mask FROM fixed"))
def fixed_edge_null(spark, d):
    return inference.fixed_edge_null(G.population_graphs(spark, d), NULLS, SEED).select("replicate", "graph_id", "mask")


def paired_opportunity(g: DataFrame) -> DataFrame:
    w = F.bit_and("opportunity").over(G.whole("geography_code"))
    return g.withColumn("paired_opportunity", w)


S.cte("null_rep", "primary_motifs fixed spairs", f"SELECT m.motif_id, m.support_count, r.rep, count(f.graph_id) AS support FROM primary_motifs m CROSS JOIN (SELECT unnest(range(1, {NULLS + 1})) AS rep) r LEFT JOIN (SELECT f.*, opp FROM fixed f JOIN spairs USING (geography_code)) f ON f.replicate = r.rep AND f.mask & m.mask = m.mask AND f.opp & m.mask = m.mask GROUP BY ALL")
_NS = {"null_mean": "avg(support)", "null_sd": "stddev_samp(support)", "null_q025": "quantile_cont(support, 0.025)", "null_q975": "quantile_cont(support, 0.975)", "density_null_z": "CASE WHEN stddev_samp(support) > 0 THEN (support_count - avg(support)) / stddev_samp(support) END", "p_value_upper": f"(1 + count(*) FILTER (support >= support_count)) / CAST({NULLS + 1} AS DOUBLE)"}


@registered(S.query("null_rep", "SELECT motif_id, support_count AS observed_support, " + ", ".join(f"{S.r(v, 7)} AS {k}" for k, v in _NS.items()) + " FROM null_rep GROUP BY motif_id, support_count"))
def null_support(spark, d):
    g = paired_opportunity(G.population_graphs(spark, d))
    null = inference.fixed_edge_null(g, NULLS, SEED)
    m = primary(spark, d)
    return inference.null_summary(inference.replicate_support(null, m, NULLS), m, NULLS).withColumns({k: r(k, 7) for k in _NS})


