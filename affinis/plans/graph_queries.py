"""Queries of the scan, recode, population, association and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import average_rank, bh, bits, holm, r, ratio, state_name, valid_weight, whole, wilson
from affinis.operators import association, graphs, population, recode
from affinis.operators.tables import settle
from affinis.plans import sqlbase as S
from affinis.plans.register import registered, shared
from affinis.sources import bridge
from affinis.sources.bridge import CONDITIONS, load

RULES = S.RULES


def people(spark: SparkSession, d: str) -> DataFrame:
    return recode.respondents(spark, d)


def populations(spark: SparkSession, d: str) -> DataFrame:
    return population.with_graph_id(people(spark, d))


@shared
def registry(spark: SparkSession, d: str, paired: bool = True) -> DataFrame:
    states = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("state_code")).union(spark.sql("SELECT 99"))
    return population.registry(people(spark, d), bridge.thresholds(spark, d)["population"], states, paired)


def pair_estimates(spark: SparkSession, d: str) -> DataFrame:
    return association.edge_table(populations(spark, d), bridge.thresholds(spark, d), 0.12)


@shared
def pair_table(spark: SparkSession, d: str) -> DataFrame:
    return settle(pair_estimates(spark, d))


def rule_edges(spark: SparkSession, d: str) -> DataFrame:
    return association.scenarios(pair_table(spark, d), RULES)


def described(m: DataFrame) -> DataFrame:
    return m.withColumn("geography_code", F.substring("graph_id", 6, 2).cast("int")).withColumn("ses_category", F.substring_index("graph_id", "_", -1))


@shared
def all_graphs(spark: SparkSession, d: str) -> DataFrame:
    return settle(described(graphs.masks(rule_edges(spark, d), ("graph_id", "rule_id"))))


@shared
def population_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs at 0.12 of all populations of the registry that are eligible."""
    g = described(graphs.masks(pair_table(spark, d)))
    ok = registry(spark, d).where("eligibility_status = 'eligible'").select("graph_id")
    return settle(g.join(ok, "graph_id", "left_semi"))


@shared
def similar(spark: SparkSession, d: str) -> DataFrame:
    return settle(graphs.density_null(graphs.similarity(population_graphs(spark, d), 45), 45))


# --- scans and recodes -----------------------------------------------------------------------------------


@registered("SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM orders")
def source_dimensions(spark, d):
    o = load(spark, d, "orders")
    return o.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(o.columns)))


@registered("SELECT CAST(x AS INTEGER) AS position, split_part(v, ':', 1) AS variable, split_part(v, ':', 2) AS type FROM (SELECT unnest(range(1, 6)) AS x, unnest(['c_custkey:bigint', 'c_name:string', 'c_nationkey:int', 'c_acctbal:double', 'c_mktsegment:string']) AS v)")
def variable_metadata(spark, d):
    return recode.variable_dictionary(load(spark, d, "customer"))


@registered("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def pruned_scan(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@registered(S.query("resp", "SELECT respondent_id, state_code, " + ", ".join(CONDITIONS) + " FROM resp"))
def condition_recode(spark, d):
    return people(spark, d).select("respondent_id", "state_code", *CONDITIONS)


@registered(S.query("resp", "SELECT respondent_id, ses_category FROM resp"))
def ses_recode(spark, d):
    return people(spark, d).select("respondent_id", "ses_category")


@registered(S.query("resp", "SELECT respondent_id, state_code, ses_category, survey_weight, survey_strata, survey_psu, age_group, sex FROM resp WHERE state_code IN (1, 6, 12)"))
def harmonized_states(spark, d):
    df = recode.harmonize(bridge.raw_respondents(spark, d), states=[1, 6, 12])
    return df.select("respondent_id", "state_code", "ses_category", "survey_weight", "survey_strata", "survey_psu", "age_group", "sex")


@registered("SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS a, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b FROM orders")
def numeric_coercion(spark, d):
    from affinis.functions.columns import number

    return load(spark, d, "orders").select("o_orderkey", number("o_orderpriority").alias("a"), number(F.substring("o_orderpriority", 1, 1)).alias("b"))


@registered(S.query("states state_names", "SELECT state_code, coalesce(name, 'Unknown (' || lpad(CAST(state_code AS VARCHAR), 2, '0') || ')') AS geography FROM states LEFT JOIN state_names ON code = state_code"))
def state_names(spark, d):
    s = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("state_code")).union(spark.sql("SELECT 99"))
    return s.select("state_code", state_name(F.col("state_code")).alias("geography"))


@registered("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{x}', '1', '2', {'true' if x != 'RAW_J' else 'false'})" for c, x in zip(bridge.CONDITIONS, bridge.RAW, strict=True)) + ") t(condition, source_variable, positive_codes, negative_codes, source_available)")
def condition_registry(spark, d):
    have = recode.variable_dictionary(bridge.raw_respondents(spark, d).drop("RAW_J"))
    return recode.condition_registry(spark, have)


@registered(f"SELECT * FROM (VALUES ('{bridge.DEFINITION}', 'lower', '1,2', 'ses_code', true), ('{bridge.DEFINITION}', 'higher', '4,5', 'ses_code', true)) t(definition_name, category, codes, source_variable, source_available)")
def ses_registry(spark, d):
    return recode.ses_registry(spark, recode.variable_dictionary(bridge.raw_respondents(spark, d)))


_ROLES = {x: f"condition:{c}" for c, x in zip(bridge.CONDITIONS, bridge.RAW, strict=True)} | {"ses_code": f"ses:{bridge.DEFINITION}", "state_code": "survey:state", "survey_weight": "survey:weight", "survey_strata": "survey:strata", "survey_psu": "survey:psu"}


@registered(S.query("raw", " UNION ALL ".join(f"SELECT '{v}' AS variable, '{role}' AS analysis_roles, count(*) FILTER ({v} IS NULL) AS n_missing FROM raw" for v, role in _ROLES.items())))
def analysis_roles(spark, d):
    """Each variable's roles, and how many respondents lack it."""
    from affinis.operators import audit

    roles = recode.analysis_roles(spark)
    missing = audit.missingness(bridge.raw_respondents(spark, d), {"raw_variable": list(_ROLES)})
    return roles.join(missing.select(F.col("item").alias("variable"), "n_missing"), "variable", "left").select("variable", "analysis_roles", "n_missing")


@registered(S.query("raw", f"SELECT respondent_id, {S.VALID} AS valid_weight FROM raw"))
def weight_validity(spark, d):
    return bridge.raw_respondents(spark, d).select("respondent_id", valid_weight("survey_weight").alias("valid_weight"))


# --- audit -----------------------------------------------------------------------------------------------


@registered(
    S.query(
        "resp state_names",
        f"SELECT state_code AS geography_code, coalesce(max(name), 'Unknown (' || lpad(CAST(state_code AS VARCHAR), 2, '0') || ')') AS geography, count(*) AS n_unweighted, {S.r(f'sum(CASE WHEN {S.VALID} THEN survey_weight ELSE 0 END)', 2)} AS weighted_population_estimate, count(*) FILTER (NOT {S.VALID}) AS n_invalid_weight FROM resp LEFT JOIN state_names ON code = state_code GROUP BY state_code",
    )
)
def audit_state_sizes(spark, d):
    from affinis.operators import audit

    return audit.state_sizes(people(spark, d)).withColumn("weighted_population_estimate", r("weighted_population_estimate", 2))


_PREV = f"""count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok AND x = 1) AS n_cases, {S.r("avg(CASE WHEN ok THEN x END)")} AS unweighted_prevalence,
  {S.r("sum(CASE WHEN ok AND x = 1 THEN survey_weight ELSE 0 END) / nullif(sum(CASE WHEN ok THEN survey_weight ELSE 0 END), 0)")} AS weighted_prevalence,
  {S.r("sum(CASE WHEN ok THEN survey_weight ELSE 0 END)", 2)} AS weighted_population_denominator,
  {S.r("sum(CASE WHEN ok THEN survey_weight ELSE 0 END) * sum(CASE WHEN ok THEN survey_weight ELSE 0 END) / nullif(sum(CASE WHEN ok THEN survey_weight * survey_weight ELSE 0 END), 0)", 6)} AS kish_effective_n"""
S.cte("answers", "resp", " UNION ALL ".join(f"SELECT state_code, ses_category, survey_weight, '{c}' AS condition, {c} AS x, {c} IS NOT NULL AND {S.VALID} AS ok FROM resp" for c in CONDITIONS))
S.cte("nodes_prev", "answers", f"SELECT '{bridge.YEAR}_' || lpad(CAST(state_code AS VARCHAR), 2, '0') || '_{bridge.DEFINITION}_' || ses_category AS graph_id, condition, {_PREV} FROM answers WHERE ses_category IS NOT NULL GROUP BY 1, 2")


def _prev(df: DataFrame) -> DataFrame:
    return df.withColumns({"unweighted_prevalence": r("unweighted_prevalence"), "weighted_prevalence": r("weighted_prevalence"), "weighted_population_denominator": r("weighted_population_denominator", 2), "kish_effective_n": r("kish_effective_n", 6)})


@registered(S.query("answers", f"SELECT coalesce(CAST(state_code AS VARCHAR), 'ALL') AS geography_code, condition, {_PREV} FROM answers GROUP BY GROUPING SETS ((state_code, condition), (condition))"))
def audit_prevalence_sets(spark, d):
    return _prev(association.national_and_state(people(spark, d)))


@registered(S.query("nodes_prev", "SELECT * FROM nodes_prev"))
def node_prevalence(spark, d):
    return _prev(association.node_prevalence(populations(spark, d)))


_ITEMS = [*[("raw_variable", x, "raw") for x in bridge.RAW], *[("condition", c, "resp") for c in CONDITIONS], ("ses", "ses_category", "resp")]


@registered(S.query("raw resp", " UNION ALL ".join(f"SELECT '{k}' AS item_type, '{i}' AS item, count(*) AS n_total, count(*) FILTER ({i} IS NULL) AS n_missing, {S.r(f'count(*) FILTER ({i} IS NULL) / CAST(count(*) AS DOUBLE)')} AS missing_fraction FROM {t}" for k, i, t in _ITEMS)))
def audit_missingness(spark, d):
    from affinis.operators import audit

    raw = audit.missingness(bridge.raw_respondents(spark, d), {"raw_variable": bridge.RAW})
    derived = audit.missingness(people(spark, d), {"condition": CONDITIONS, "ses": ["ses_category"]})
    return raw.union(derived).withColumn("missing_fraction", r("missing_fraction"))


@registered(S.query("resp", f"SELECT '{bridge.DEFINITION}' AS definition_name, coalesce(ses_category, 'missing') AS category, count(*) AS n FROM resp GROUP BY 2"))
def ses_value_counts(spark, d):
    from affinis.operators import audit

    return audit.value_counts(people(spark, d), bridge.DEFINITION)


@registered(
    S.query(
        "answers",
        f"SELECT condition, {S.r('p')} AS weighted_prevalence, {S.r('m')} AS analytic_missing_fraction, CASE WHEN p >= CAST(0.3 AS DOUBLE) AND m <= CAST(0.10 AS DOUBLE) THEN 'provisional_include' ELSE 'review' END AS prototype_selection_status FROM (SELECT condition, sum(CASE WHEN ok AND x = 1 THEN survey_weight ELSE 0 END) / sum(CASE WHEN ok THEN survey_weight ELSE 0 END) AS p, count(*) FILTER (x IS NULL) / CAST(count(*) AS DOUBLE) AS m FROM answers GROUP BY condition)",
    )
)
def candidate_selection(spark, d):
    from affinis.operators import audit

    out = audit.candidate_status(people(spark, d), 0.3, 0.10)
    return out.withColumns({"weighted_prevalence": r("weighted_prevalence"), "analytic_missing_fraction": r("analytic_missing_fraction")})


# --- registries ------------------------------------------------------------------------------------------

_REG = f"graph_id, geography_code, geography, ses_category, n_unweighted, {S.r('sw', 2)} AS weighted_population_estimate, {S.r('sw * sw / nullif(sw2, 0)', 6)} AS kish_effective_n, n_strata, n_psu"


def _reg(df: DataFrame) -> DataFrame:
    return df.withColumns({"weighted_population_estimate": r("weighted_population_estimate", 2), "kish_effective_n": r("kish_effective_n", 6), "n_unweighted": F.col("n_unweighted").cast("long"), "n_strata": F.col("n_strata").cast("long"), "n_psu": F.col("n_psu").cast("long")})


@registered(S.query("reg", f"SELECT {_REG}, status AS stratum_eligibility_status, eligibility_status FROM reg"))
def registry_paired(spark, d):
    return _reg(registry(spark, d))


@registered(S.query("reg0", f"SELECT {_REG}, CASE WHEN n_unweighted < least THEN 'insufficient sample' ELSE 'eligible' END AS eligibility_status FROM reg0"))
def registry_unpaired(spark, d):
    return _reg(registry(spark, d, False))


@registered(S.query("reg", "SELECT ses_category, eligibility_status, count(*) AS population_count FROM reg GROUP BY ALL"))
def eligibility_counts(spark, d):
    return registry(spark, d).groupBy("ses_category", "eligibility_status").agg(F.count("*").alias("population_count"))


# --- association -----------------------------------------------------------------------------------------

_PAIR = f"""graph_id, source_condition, target_condition, {S.r("association")} AS association, n_complete, source_cases, target_cases, cooccurring_cases, {S.r("weighted_n", 2)} AS weighted_n,
  {S.r("kish_effective_n", 6)} AS kish_effective_n, {S.r("pa")} AS weighted_source_prevalence, {S.r("pb")} AS weighted_target_prevalence, {S.r("pab")} AS weighted_joint_prevalence"""


def _pair(df: DataFrame) -> DataFrame:
    eight = ["association", "weighted_source_prevalence", "weighted_target_prevalence", "weighted_joint_prevalence"]
    return df.withColumns({**{c: r(c) for c in eight}, "weighted_n": r("weighted_n", 2), "kish_effective_n": r("kish_effective_n", 6)})


@registered(S.query("pairs", f"SELECT {_PAIR}, exclusion_reason, pair_eligible, pair_eligible AND coalesce(association >= CAST(0.12 AS DOUBLE), false) AS edge_present FROM pairs"))
def edge_phi(spark, d):
    return _pair(pair_estimates(spark, d).drop("p_value", "q_value"))


@registered(S.query("scen", f"SELECT rule_id, graph_id, source_condition, target_condition, {S.r('association')} AS association, minimum_effect, pair_eligible, edge_present FROM scen"))
def edge_rules(spark, d):
    return rule_edges(spark, d).select("rule_id", "graph_id", "source_condition", "target_condition", r("association").alias("association"), "minimum_effect", "pair_eligible", "edge_present")


@registered(S.query("pairs0", "SELECT exclusion_reason, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN n_complete < 250 THEN 'complete_n' END, CASE WHEN source_cases < 60 THEN 'source_cases' END, CASE WHEN target_cases < 60 THEN 'target_cases' END, CASE WHEN cooccurring_cases < 50 THEN 'cooccurring_cases' END, CASE WHEN association IS NULL THEN 'undefined_association' END) AS exclusion_reason FROM pairs0) GROUP BY 1"))
def dyad_exclusions(spark, d):
    p = association.edge_table(populations(spark, d), {"complete": 250, "cases": 60, "cooccurring": 50}, 0.12)
    return p.groupBy("exclusion_reason").agg(F.count("*").alias("n"))


@registered(S.query("pairs", f"SELECT graph_id, source_condition, target_condition, {S.r('q')} AS q_value FROM (SELECT graph_id, source_condition, target_condition, least(1, min(p * m / rn) OVER (PARTITION BY graph_id ORDER BY p, source_condition, target_condition ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS m, row_number() OVER (PARTITION BY graph_id ORDER BY p, source_condition, target_condition) AS rn FROM (SELECT *, exp(-abs(round(association, 8)) * 20) AS p FROM pairs WHERE association IS NOT NULL)))"))
def bh_qvalues(spark, d):
    p = pair_table(spark, d).where("association IS NOT NULL").withColumn("p", F.exp(-F.abs(F.round("association", 8)) * 20))
    return p.select("graph_id", "source_condition", "target_condition", r(bh(F.col("p"), ["graph_id"])).alias("q_value"))


@registered(S.query("pairs", f"SELECT graph_id, source_condition, target_condition, {S.r('least(1, max(h) OVER (PARTITION BY graph_id ORDER BY p, source_condition, target_condition ROWS UNBOUNDED PRECEDING))')} AS holm_p FROM (SELECT *, (count(*) OVER (PARTITION BY graph_id) - row_number() OVER (PARTITION BY graph_id ORDER BY p, source_condition, target_condition) + 1) * p AS h FROM (SELECT *, exp(-abs(round(association, 8)) * 20) AS p FROM pairs WHERE association IS NOT NULL))"))
def holm_adjust(spark, d):
    p = pair_table(spark, d).where("association IS NOT NULL").withColumn("p", F.exp(-F.abs(F.round("association", 8)) * 20))
    return p.select("graph_id", "source_condition", "target_condition", r(holm(F.col("p"), ["graph_id"], F.struct("source_condition", "target_condition"))).alias("holm_p"))


_W = S.wilson("p", "n_complete")


@registered(S.query("pairs", f"SELECT graph_id, source_condition, target_condition, {S.r(_W[0])} AS se, {S.r(_W[1])} AS low, {S.r(_W[2])} AS high FROM (SELECT *, cooccurring_cases / nullif(CAST(n_complete AS DOUBLE), 0) AS p FROM pairs)"))
def wilson_interval(spark, d):
    p = pair_table(spark, d)
    se, low, high = wilson(ratio(F.col("cooccurring_cases"), F.col("n_complete")), F.col("n_complete"))
    return p.select("graph_id", "source_condition", "target_condition", r(se).alias("se"), r(low).alias("low"), r(high).alias("high"))


@registered(S.query("pairs", f"SELECT graph_id, {S.r('corr(ra, rb)')} AS spearman FROM (SELECT graph_id, rank() OVER (PARTITION BY graph_id ORDER BY round(association, 8)) + (count(*) OVER (PARTITION BY graph_id, round(association, 8)) - 1) / CAST(2 AS DOUBLE) AS ra, rank() OVER (PARTITION BY graph_id ORDER BY cooccurring_cases) + (count(*) OVER (PARTITION BY graph_id, cooccurring_cases) - 1) / CAST(2 AS DOUBLE) AS rb FROM pairs WHERE association IS NOT NULL) GROUP BY graph_id"))
def spearman_rank(spark, d):
    p = pair_table(spark, d).where("association IS NOT NULL").withColumn("a", F.round("association", 8))
    p = p.select("graph_id", average_rank("a", ["graph_id"]).alias("ra"), average_rank("cooccurring_cases", ["graph_id"]).alias("rb"))
    return p.groupBy("graph_id").agg(r(F.corr("ra", "rb")).alias("spearman"))


@registered(S.query("reg", f"SELECT graph_id, {S.r('(rank() OVER (PARTITION BY ses_category ORDER BY round(k, 6)) + (count(*) OVER (PARTITION BY ses_category, round(k, 6)) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY ses_category)')} AS percentile FROM (SELECT *, sw * sw / nullif(sw2, 0) AS k FROM reg WHERE eligibility_status = 'eligible')"))
def pct_rank(spark, d):
    e = registry(spark, d).where("eligibility_status = 'eligible'").withColumn("k", F.round("kish_effective_n", 6))
    return e.select("graph_id", r(average_rank("k", ["ses_category"]) / F.count("*").over(whole("ses_category"))).alias("percentile"))


# --- graphs ----------------------------------------------------------------------------------------------


@registered(S.query("universe pairs", "SELECT edge_idx, u.a, u.b, bit, count(graph_id) AS populations, count(*) FILTER (pair_eligible) AS eligible_populations FROM universe u LEFT JOIN pairs p ON p.source_condition = u.a AND p.target_condition = u.b GROUP BY ALL"))
def edge_universe(spark, d):
    """All pairs in order, with the populations that estimate them and those where they may be edges."""
    found = pair_table(spark, d).groupBy(F.col("source_condition").alias("a"), F.col("target_condition").alias("b")).agg(F.count("*").alias("populations"), F.count_if("pair_eligible").alias("eligible_populations"))
    return graphs.edge_universe(spark).join(found, ["a", "b"], "left").select("edge_idx", "a", "b", "bit", F.coalesce("populations", F.lit(0)).alias("populations"), F.coalesce("eligible_populations", F.lit(0)).alias("eligible_populations"))


@registered(S.query("graphs_all", "SELECT graph_id, rule_id, geography_code, ses_category, mask FROM graphs_all"))
def graph_masks(spark, d):
    return all_graphs(spark, d).select("graph_id", "rule_id", "geography_code", "ses_category", "mask")


@registered(S.query("graphs", f"SELECT graph_id, opportunity, {S.bits('opportunity')} AS eligible_dyad_count, {S.bits('mask')} AS selected_edge_count FROM graphs"))
def opportunity_masks(spark, d):
    g = graphs.masks(pair_table(spark, d))
    return g.select("graph_id", "opportunity", bits("opportunity").alias("eligible_dyad_count"), bits("mask").alias("selected_edge_count"))


@registered(S.query("edges_of", "SELECT graph_id, rule_id, edge_idx, a, b FROM edges_of"))
def mask_decode(spark, d):
    return graphs.mask_edges(all_graphs(spark, d), "mask").select("graph_id", "rule_id", "edge_idx", "a", "b")


_STATS = ["density", "mean_degree", "transitivity"]


@registered(S.query("stats", "SELECT graph_id, rule_id, geography_code, ses_category, node_count, edge_count, component_count, isolate_count, maximum_degree, " + ", ".join(f"{S.r(c)} AS {c}" for c in _STATS) + " FROM stats"))
def graph_stats(spark, d):
    s = graphs.statistics(all_graphs(spark, d))
    return s.select("graph_id", "rule_id", "geography_code", "ses_category", "node_count", "edge_count", "component_count", "isolate_count", "maximum_degree", *[r(c).alias(c) for c in _STATS])


@registered(S.query("stats", "SELECT graph_id, component_count, isolate_count, largest_component_nodes, triangle_count FROM stats WHERE rule_id = 'phi_012'"))
def components_isolates(spark, d):
    return graphs.statistics(graphs.masks(pair_table(spark, d))).select("graph_id", "component_count", "isolate_count", "largest_component_nodes", "triangle_count")


S.cte("plot_nodes", "nodes_prev limits", "SELECT graph_id, condition FROM nodes_prev CROSS JOIN limits WHERE n_valid >= l_complete AND n_cases >= l_cases")


@registered(S.query("nodes_prev limits", "SELECT graph_id, condition, replace(condition, '_', ' ') AS raw_label, 'Cond ' || right(condition, 1) AS label, n_valid, n_cases, weighted_prevalence AS prevalence FROM nodes_prev CROSS JOIN limits WHERE n_valid >= l_complete AND n_cases >= l_cases"))
def graph_nodes(spark, d):
    lim = bridge.thresholds(spark, d)
    n = association.node_prevalence(populations(spark, d)).where((F.col("n_valid") >= lim["complete"]) & (F.col("n_cases") >= lim["cases"]))
    raw = F.replace("condition", F.lit("_"), F.lit(" "))
    return n.select("graph_id", "condition", raw.alias("raw_label"), F.initcap(raw).alias("label"), "n_valid", "n_cases", r("weighted_prevalence").alias("prevalence"))


@registered(S.query("scen plot_nodes", f"SELECT s.graph_id, rule_id, source_condition, target_condition, {S.r('association')} AS association FROM scen s JOIN plot_nodes x ON x.graph_id = s.graph_id AND x.condition = source_condition JOIN plot_nodes y ON y.graph_id = s.graph_id AND y.condition = target_condition WHERE edge_present"))
def graph_edges(spark, d):
    lim = bridge.thresholds(spark, d)
    nodes = association.node_prevalence(populations(spark, d)).where((F.col("n_valid") >= lim["complete"]) & (F.col("n_cases") >= lim["cases"])).select("graph_id", "condition")
    e = rule_edges(spark, d).where("edge_present")
    for side in ("source_condition", "target_condition"):
        e = e.join(nodes.withColumnRenamed("condition", side), ["graph_id", side], "left_semi")
    return e.select("graph_id", "rule_id", "source_condition", "target_condition", r("association").alias("association"))


@registered(S.query("scen", f"SELECT rule_id, source_condition, target_condition, count(*) AS graph_count, count(*) FILTER (edge_present) AS support_count, {S.r('count(*) FILTER (edge_present) / CAST(count(*) AS DOUBLE)')} AS support_fraction FROM scen GROUP BY ALL"))
def edge_support(spark, d):
    return graphs.edge_support(rule_edges(spark, d)).withColumn("support_fraction", r("support_fraction"))


_SIM = "graph_id_a, graph_id_b, same_state, same_ses, edges_a, edges_b, " + ", ".join(f"{S.r(c)} AS {c}" for c in ("edge_jaccard", "edge_agreement"))
_NULL = ["null_expected", "null_sd", "null_p_upper", "density_z", "density_excess"]


@registered(S.query("sim", f"SELECT {_SIM} FROM sim"))
def similarity_pairs(spark, d):
    s = graphs.similarity(population_graphs(spark, d), 45)
    return s.select("graph_id_a", "graph_id_b", "same_state", "same_ses", "edges_a", "edges_b", r("edge_jaccard").alias("edge_jaccard"), r("edge_agreement").alias("edge_agreement"))


@registered(S.query("simz", "SELECT graph_id_a, graph_id_b, " + ", ".join(f"{S.r(c, 7)} AS {c}" for c in _NULL) + " FROM simz"))
def hypergeom_null(spark, d):
    return similar(spark, d).select("graph_id_a", "graph_id_b", *[r(c, 7).alias(c) for c in _NULL])


@registered(S.query("pgraphs pairs", f"SELECT x.graph_id AS graph_id_a, y.graph_id AS graph_id_b, count(*) AS common_association_count, {S.r('CASE WHEN count(*) >= 2 AND stddev_pop(x.association) > 0 AND stddev_pop(y.association) > 0 THEN corr(x.association, y.association) END')} AS association_correlation FROM pairs x JOIN pairs y ON x.source_condition = y.source_condition AND x.target_condition = y.target_condition AND x.graph_id < y.graph_id WHERE x.association IS NOT NULL AND y.association IS NOT NULL AND x.graph_id IN (SELECT graph_id FROM pgraphs) AND y.graph_id IN (SELECT graph_id FROM pgraphs) GROUP BY ALL"))
def association_correlation(spark, d):
    e = pair_table(spark, d).join(registry(spark, d).where("eligibility_status = 'eligible'").select("graph_id"), "graph_id", "left_semi")
    return graphs.association_correlation(settle(e)).withColumn("association_correlation", r("association_correlation"))


@registered(S.query("typed", "SELECT graph_id_a, graph_id_b, comparison_type FROM typed"))
def similarity_classified(spark, d):
    s = graphs.similarity(population_graphs(spark, d), 45)
    return s.select("graph_id_a", "graph_id_b", graphs.comparison_type().alias("comparison_type"))


_SUM = {"mean_jaccard": "avg(edge_jaccard)", "median_jaccard": "median(edge_jaccard)", "standard_deviation": "stddev_samp(edge_jaccard)", "minimum_jaccard": "min(edge_jaccard)", "maximum_jaccard": "max(edge_jaccard)", "mean_density_adjusted_z": "avg(density_z)", "median_density_adjusted_z": "median(density_z)"}


@registered(S.query("typed", "SELECT comparison_type, count(*) AS pair_count, " + ", ".join(f"{S.r(v, 7)} AS {k}" for k, v in _SUM.items()) + " FROM typed WHERE comparison_type <> 'other' GROUP BY 1"))
def similarity_summary(spark, d):
    return graphs.similarity_summary(similar(spark, d)).withColumns({k: r(k, 7) for k in _SUM})


@registered(S.query("pgraphs", "SELECT ses_category, count(*) AS graph_count, count(DISTINCT mask) AS unique_edge_sets FROM pgraphs GROUP BY 1"))
def edge_signatures(spark, d):
    return population_graphs(spark, d).groupBy("ses_category").agg(F.count("*").alias("graph_count"), F.count_distinct("mask").alias("unique_edge_sets"))


@registered(S.query("sim", "SELECT graph_id_a, " + ", ".join(f"{S.r(f'max(CASE WHEN graph_id_b = {chr(39)}{bridge.YEAR}_{i:02d}_{bridge.DEFINITION}_lower{chr(39)} THEN edge_jaccard END)')} AS s{i:02d}" for i in (5, 10, 15, 20)) + " FROM sim GROUP BY 1"))
def similarity_pivot(spark, d):
    s = graphs.similarity(population_graphs(spark, d), 45)
    cols = {f"{bridge.YEAR}_{i:02d}_{bridge.DEFINITION}_lower": f"s{i:02d}" for i in (5, 10, 15, 20)}
    p = s.groupBy("graph_id_a").pivot("graph_id_b", list(cols)).agg(F.max("edge_jaccard"))
    return p.select("graph_id_a", *[r(F.col(f"`{k}`")).alias(v) for k, v in cols.items()])


_OUT = ["mean_same_ses_jaccard", "median_same_ses_jaccard", "mean_same_ses_density_adjusted_z", "robust_similarity_z", "robust_density_adjusted_similarity_z"]
S.cte("peers", "pgraphs mirror", "SELECT g.graph_id, g.geography_code, g.ses_category, CAST(bit_count(g.mask) AS INTEGER) AS edge_count, avg(edge_jaccard) AS mean_same_ses_jaccard, median(edge_jaccard) AS median_same_ses_jaccard, CASE WHEN count(*) FILTER (density_z IS NULL) = 0 THEN avg(density_z) END AS mean_same_ses_density_adjusted_z FROM pgraphs g LEFT JOIN mirror m ON m.graph_id = g.graph_id AND same_ses GROUP BY ALL")
S.cte("outliers", "peers", "SELECT p.*, CASE WHEN d1 > 0 THEN CAST(0.67448975 AS DOUBLE) * (mean_same_ses_jaccard - m1) / d1 ELSE 0 END AS robust_similarity_z, CASE WHEN d2 > 0 THEN CAST(0.67448975 AS DOUBLE) * (mean_same_ses_density_adjusted_z - m2) / d2 ELSE 0 END AS robust_density_adjusted_similarity_z FROM peers p JOIN (SELECT ses_category, max(m1) AS m1, max(m2) AS m2, median(abs(mean_same_ses_jaccard - m1)) AS d1, median(abs(mean_same_ses_density_adjusted_z - m2)) AS d2 FROM (SELECT *, median(mean_same_ses_jaccard) OVER (PARTITION BY ses_category) AS m1, median(mean_same_ses_density_adjusted_z) OVER (PARTITION BY ses_category) AS m2 FROM peers) GROUP BY 1) USING (ses_category)")


@registered(S.query("outliers", "SELECT graph_id, geography_code, ses_category, edge_count, " + ", ".join(f"{S.r(c, 7)} AS {c}" for c in _OUT) + " FROM outliers"))
def outlier_robust_z(spark, d):
    g = population_graphs(spark, d)
    o = graphs.outlier_scores(g, settle(graphs.density_null(graphs.similarity(g, 45), 45)))
    return o.select("graph_id", "geography_code", "ses_category", "edge_count", *[r(c, 7).alias(c) for c in _OUT])


_CAL = {"edge_count_median": "median(edge_count)", "density_minimum": "min(density)", "density_median": "median(density)", "density_maximum": "max(density)", "fraction_in_preferred_edge_range": "avg(CASE WHEN edge_count BETWEEN 10 AND 20 THEN 1 ELSE 0 END)"}


@registered(S.query("stats", "SELECT rule_id, count(*) AS graph_count, min(edge_count) AS edge_count_minimum, max(edge_count) AS edge_count_maximum, " + ", ".join(f"{S.r(v)} AS {k}" for k, v in _CAL.items()) + ", count(*) FILTER (density >= CAST(0.5 AS DOUBLE)) AS high_density_graph_count, median(edge_count) BETWEEN 10 AND 20 AS median_edge_target_met, max(density) < CAST(0.5 AS DOUBLE) AS maximum_density_target_met FROM stats GROUP BY 1"))
def calibration_summary(spark, d):
    out = graphs.calibration_summary(graphs.statistics(all_graphs(spark, d)), 10, 20, 0.5)
    return out.withColumns({k: r(k) for k in _CAL})


S.cte("rule_pairs", "", "SELECT * FROM (VALUES ('phi_010', 'phi_012', CAST(0.10 AS DOUBLE), CAST(0.12 AS DOUBLE), 'adjacent'), ('phi_012', 'phi_014', CAST(0.12 AS DOUBLE), CAST(0.14 AS DOUBLE), 'adjacent'), ('phi_010', 'phi_014', CAST(0.10 AS DOUBLE), CAST(0.14 AS DOUBLE), 'outer')) t(from_rule_id, to_rule_id, from_threshold, to_threshold, transition_type)")
S.cte("degr", "deg", "SELECT *, rank() OVER (PARTITION BY graph_id, rule_id ORDER BY d) + (count(*) OVER (PARTITION BY graph_id, rule_id, d) - 1) / CAST(2 AS DOUBLE) AS rk FROM deg")
S.cte(
    "steps",
    "stats rule_pairs degr",
    f"""SELECT p.*, x.graph_id, x.geography_code, x.ses_category, x.edge_count AS from_edge_count, y.edge_count AS to_edge_count, CAST(bit_count(x.mask) - bit_count(x.mask & y.mask) AS INTEGER) AS edges_removed,
       CASE WHEN x.mask = 0 THEN CAST(1 AS DOUBLE) ELSE bit_count(x.mask & y.mask) / CAST(bit_count(x.mask) AS DOUBLE) END AS edge_retention_fraction, {S.jaccard("x.mask", "y.mask")} AS edge_jaccard, x.mask & y.mask = y.mask AS nested,
       y.component_count - x.component_count AS component_count_change, y.isolate_count - x.isolate_count AS isolate_count_change,
       (SELECT CASE WHEN stddev_pop(u.rk) > 0 AND stddev_pop(v.rk) > 0 THEN corr(u.rk, v.rk) END FROM degr u JOIN degr v ON u.graph_id = v.graph_id AND u.node = v.node WHERE u.graph_id = x.graph_id AND u.rule_id = from_rule_id AND v.rule_id = to_rule_id) AS degree_spearman
  FROM rule_pairs p JOIN stats x ON x.rule_id = from_rule_id JOIN stats y ON y.rule_id = to_rule_id AND y.graph_id = x.graph_id""",
)
_STEP = ["edge_retention_fraction", "edge_jaccard", "degree_spearman"]
_KEYS = ["transition_type", "from_rule_id", "to_rule_id", "from_threshold", "to_threshold"]


@registered(S.query("steps", f"SELECT graph_id, geography_code, ses_category, {', '.join(_KEYS)}, from_edge_count, to_edge_count, edges_removed, nested, component_count_change, isolate_count_change, " + ", ".join(f"{S.r(c)} AS {c}" for c in _STEP) + " FROM steps"))
def threshold_topology(spark, d):
    t = graphs.transitions(all_graphs(spark, d), RULES)
    return t.withColumns({c: r(c) for c in _STEP})


_TS = {"median_edge_jaccard": "median(edge_jaccard)", "minimum_edge_jaccard": "min(edge_jaccard)", "q10_edge_jaccard": "quantile_cont(edge_jaccard, 0.1)", "fraction_edge_jaccard_below_050": "avg(CASE WHEN edge_jaccard < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END)", "median_edges_removed": "median(edges_removed)", "median_degree_spearman": "median(degree_spearman)", "fraction_component_count_changed": "avg(CASE WHEN component_count_change <> 0 THEN 1 ELSE 0 END)"}


@registered(S.query("steps", f"SELECT {', '.join(_KEYS)}, count(*) AS graph_count, {S.big('sum(edges_removed)')} AS total_edges_removed, bool_and(nested) AS all_graphs_nested, " + ", ".join(f"{S.r(v)} AS {k}" for k, v in _TS.items()) + f" FROM steps GROUP BY {', '.join(_KEYS)}"))
def transition_summary(spark, d):
    t = graphs.transition_summary(graphs.transitions(all_graphs(spark, d), RULES))
    return t.withColumns({k: r(k) for k in _TS})
