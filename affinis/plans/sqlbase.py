"""Building blocks of the DuckDB oracles: named CTEs, composed by what a query needs."""

from __future__ import annotations

from affinis.functions.columns import STATE_NAMES, Z95
from affinis.sources import bridge

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


#: Tables that are made once in a statement, however often it reads them.
KEPT = {"resp", "popd", "answered", "times"}


def query(needs: str, select: str) -> str:
    """select, after the CTEs it needs and those that they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for n in CTES[name][0]:
                add(n)
            done[name] = CTES[name][1]

    for n in needs.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in KEPT else ''}({v})" for k, v in done.items()) + "\n" + select


def r(expr: str, digits: int = 8) -> str:
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


_C, _R = bridge.CONDITIONS, bridge.RAW
VALID = "(survey_weight IS NOT NULL AND NOT isnan(survey_weight) AND survey_weight > 0 AND survey_weight < CAST('Infinity' AS DOUBLE))"

cte("limits", "", "SELECT " + ", ".join(f"greatest(5, {v} * count(*) // {bridge.REFERENCE_ROWS}) AS l_{k}" for k, v in bridge.THRESHOLDS.items()) + " FROM orders")
cte("line_codes", "", "SELECT l_orderkey, " + ", ".join(f"min(CASE WHEN {p} THEN 1 ELSE 2 END) AS {c}" for p, c in zip(bridge.PREDICATES, _R, strict=True)) + " FROM lineitem GROUP BY l_orderkey")
cte(
    "raw",
    "line_codes",
    "SELECT o_orderkey AS respondent_id, c_nationkey AS state_code, substr(o_orderpriority, 1, 1) AS ses_code, c_acctbal AS survey_weight, c_mktsegment AS survey_strata, "
    "o_custkey AS survey_psu, CAST(year(o_orderdate) AS INTEGER) AS age_group, o_orderstatus AS sex, "
    + ", ".join(f"CAST(CASE WHEN o_orderkey % {11 + i} = 0 THEN 9 ELSE {c} END AS DOUBLE) AS {c}" for i, c in enumerate(_R))
    + " FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN line_codes ON l_orderkey = o_orderkey",
)
cte(
    "resp",
    "raw",
    "SELECT respondent_id, state_code, CASE WHEN ses_code IN ('1', '2') THEN 'lower' WHEN ses_code IN ('4', '5') THEN 'higher' END AS ses_category, survey_weight, survey_strata, survey_psu, age_group, sex, "
    + ", ".join(f"CASE {s} WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) END AS {c}" for c, s in zip(_C, _R, strict=True))
    + " FROM raw",
)
cte("popd", "resp", f"SELECT *, '{bridge.YEAR}_' || lpad(CAST(state_code AS VARCHAR), 2, '0') || '_{bridge.DEFINITION}_' || ses_category AS graph_id FROM resp WHERE ses_category IS NOT NULL AND state_code IS NOT NULL")
cte("long", "popd", "SELECT graph_id, respondent_id, survey_weight AS w, c AS cond, x FROM (" + " UNION ALL ".join(f"SELECT graph_id, respondent_id, survey_weight, '{c}' AS c, {c} AS x FROM popd WHERE {VALID}" for c in _C) + ") WHERE x IS NOT NULL")
cte("universe", "", "SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS edge_idx, a, b, CAST(1 AS BIGINT) << CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS bit FROM (SELECT x.c AS a, y.c AS b FROM (VALUES " + ", ".join(f"('{c}')" for c in _C) + ") x(c), (VALUES " + ", ".join(f"('{c}')" for c in _C) + ") y(c) WHERE x.c < y.c)")
cte(
    "moments",
    "long universe popd",
    """SELECT g.graph_id, u.a, u.b, count(m.w) AS n, count(*) FILTER (m.xa = 1) AS n_a, count(*) FILTER (m.xb = 1) AS n_b, count(*) FILTER (m.xa = 1 AND m.xb = 1) AS n_ab,
       coalesce(sum(m.w), 0) AS sw, coalesce(sum(m.w * m.w), 0) AS sw2, coalesce(sum(m.w * m.xa), 0) AS swa, coalesce(sum(m.w * m.xb), 0) AS swb, coalesce(sum(m.w * m.xa * m.xb), 0) AS swab
  FROM (SELECT DISTINCT graph_id FROM popd) g CROSS JOIN universe u LEFT JOIN (
    SELECT p.graph_id, p.cond AS a, q.cond AS b, p.w, p.x AS xa, q.x AS xb FROM long p JOIN long q ON p.respondent_id = q.respondent_id AND p.cond < q.cond
  ) m ON m.graph_id = g.graph_id AND m.a = u.a AND m.b = u.b GROUP BY g.graph_id, u.a, u.b""",
)
cte(
    "pairs0",
    "moments",
    """SELECT graph_id, a AS source_condition, b AS target_condition, CASE WHEN pa * (1 - pa) * pb * (1 - pb) > CAST(1e-15 AS DOUBLE) THEN (pab - pa * pb) / sqrt(pa * (1 - pa) * pb * (1 - pb)) END AS association,
       n AS n_complete, n_a AS source_cases, n_b AS target_cases, n_ab AS cooccurring_cases, sw AS weighted_n, sw * sw / nullif(sw2, 0) AS kish_effective_n, pa, pb, pab
  FROM (SELECT *, swa / nullif(sw, 0) AS pa, swb / nullif(sw, 0) AS pb, swab / nullif(sw, 0) AS pab FROM moments)""",
)
cte(
    "pairs",
    "pairs0 limits",
    """SELECT *, exclusion_reason = '' AS pair_eligible FROM (SELECT *, concat_ws('|', CASE WHEN n_complete < l_complete THEN 'complete_n' END, CASE WHEN source_cases < l_cases THEN 'source_cases' END,
       CASE WHEN target_cases < l_cases THEN 'target_cases' END, CASE WHEN cooccurring_cases < l_cooccurring THEN 'cooccurring_cases' END, CASE WHEN association IS NULL THEN 'undefined_association' END) AS exclusion_reason FROM pairs0 CROSS JOIN limits)""",
)
RULES = {"phi_010": 0.10, "phi_012": 0.12, "phi_014": 0.14}
cte("rules", "", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in RULES.items()) + ") t(rule_id, minimum_effect)")
cte("scen", "pairs rules", "SELECT *, pair_eligible AND coalesce(association >= minimum_effect, false) AS edge_present FROM pairs CROSS JOIN rules")
cte("state_names", "", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in STATE_NAMES.items()) + ") t(code, name)")
cte("states", "", "SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS state_code FROM nation UNION SELECT 99")
cte(
    "reg0",
    "resp states state_names limits",
    f"""SELECT '{bridge.YEAR}_' || lpad(CAST(s.state_code AS VARCHAR), 2, '0') || '_{bridge.DEFINITION}_' || c.ses_category AS graph_id, s.state_code AS geography_code,
       coalesce(max(name), 'Unknown (' || lpad(CAST(s.state_code AS VARCHAR), 2, '0') || ')') AS geography, c.ses_category, count(r.respondent_id) AS n_unweighted,
       coalesce(sum(CASE WHEN {VALID} THEN survey_weight ELSE 0 END), 0) AS sw, coalesce(sum(CASE WHEN {VALID} THEN survey_weight * survey_weight ELSE 0 END), 0) AS sw2,
       count(DISTINCT survey_strata) AS n_strata, count(DISTINCT survey_psu) AS n_psu, bool_or(s.state_code IN (SELECT state_code FROM resp)) AS reports, max(l_population) AS least
  FROM states s CROSS JOIN (VALUES ('lower'), ('higher')) c(ses_category) CROSS JOIN limits LEFT JOIN state_names ON code = s.state_code
  LEFT JOIN resp r ON r.state_code = s.state_code AND r.ses_category = c.ses_category GROUP BY s.state_code, c.ses_category""",
)
cte(
    "reg",
    "reg0",
    """SELECT *, CASE WHEN status = 'eligible' AND NOT bool_and(status = 'eligible') OVER (PARTITION BY geography_code) THEN 'paired SES stratum ineligible' ELSE status END AS eligibility_status
  FROM (SELECT *, CASE WHEN NOT reports THEN 'no reporting data' WHEN n_unweighted < least THEN 'insufficient sample' ELSE 'eligible' END AS status FROM reg0)""",
)
cte(
    "graphs_all",
    "scen universe",
    """SELECT graph_id, CAST(substr(graph_id, 6, 2) AS INTEGER) AS geography_code, split_part(graph_id, '_', 4) AS ses_category, rule_id,
       CAST(sum(CASE WHEN edge_present THEN bit ELSE 0 END) AS BIGINT) AS mask, CAST(sum(CASE WHEN pair_eligible THEN bit ELSE 0 END) AS BIGINT) AS opportunity
  FROM scen JOIN universe ON a = source_condition AND b = target_condition GROUP BY graph_id, rule_id""",
)
cte("graphs", "graphs_all", "SELECT graph_id, geography_code, ses_category, mask, opportunity FROM graphs_all WHERE rule_id = 'phi_012'")
cte("pgraphs", "graphs reg", "SELECT g.* FROM graphs g JOIN reg USING (graph_id) WHERE eligibility_status = 'eligible'")


def bits(expr: str) -> str:
    return f"CAST(bit_count({expr}) AS INTEGER)"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN {a} | {b} = 0 THEN CAST(1 AS DOUBLE) ELSE bit_count({a} & {b}) / CAST(bit_count({a} | {b}) AS DOUBLE) END"


cte("edges_of", "graphs_all universe", "SELECT graph_id, rule_id, geography_code, ses_category, a, b, edge_idx FROM graphs_all JOIN universe ON mask & bit <> 0")
cte("nodes", "", "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _C) + ") t(node)")
cte("deg", "graphs_all nodes edges_of", "SELECT g.graph_id, g.rule_id, node, count(a) AS d FROM graphs_all g CROSS JOIN nodes LEFT JOIN edges_of e ON e.graph_id = g.graph_id AND e.rule_id = g.rule_id AND (a = node OR b = node) GROUP BY g.graph_id, g.rule_id, node")
cte(
    "reach",
    "graphs_all nodes edges_of",
    "SELECT graph_id, rule_id, node AS n0, node AS n1 FROM graphs_all CROSS JOIN nodes UNION SELECT r.graph_id, r.rule_id, r.n0, CASE WHEN e.a = r.n1 THEN e.b ELSE e.a END FROM reach r JOIN edges_of e ON e.graph_id = r.graph_id AND e.rule_id = r.rule_id AND (e.a = r.n1 OR e.b = r.n1)",
)
cte("comps", "reach", "SELECT graph_id, rule_id, count(DISTINCT root) AS components, max(size) AS largest FROM (SELECT graph_id, rule_id, n0, min(n1) AS root, count(*) AS size FROM reach GROUP BY ALL) GROUP BY ALL")
cte(
    "tri",
    "graphs_all edges_of",
    "SELECT g.graph_id, g.rule_id, count(x.a) AS triangles FROM graphs_all g LEFT JOIN (SELECT x.graph_id, x.rule_id, x.a FROM edges_of x JOIN edges_of y ON x.graph_id = y.graph_id AND x.rule_id = y.rule_id AND x.b = y.a JOIN edges_of z ON z.graph_id = x.graph_id AND z.rule_id = x.rule_id AND z.a = x.a AND z.b = y.b) x ON x.graph_id = g.graph_id AND x.rule_id = g.rule_id GROUP BY g.graph_id, g.rule_id",
)
cte(
    "stats",
    "graphs_all deg comps tri",
    """SELECT g.graph_id, g.rule_id, g.geography_code, g.ses_category, g.mask, CAST(10 AS INTEGER) AS node_count, CAST(sum(d) / 2 AS INTEGER) AS edge_count, sum(d) / CAST(90 AS DOUBLE) AS density,
       CAST(max(components) AS INTEGER) AS component_count, CAST(count(*) FILTER (d = 0) AS INTEGER) AS isolate_count, CAST(max(largest) AS INTEGER) AS largest_component_nodes,
       sum(d) / CAST(10 AS DOUBLE) AS mean_degree, CAST(max(d) AS INTEGER) AS maximum_degree, CAST(max(triangles) AS INTEGER) AS triangle_count,
       coalesce(3 * max(triangles) / nullif(CAST(sum(d * (d - 1)) AS DOUBLE) / 2, 0), 0) AS transitivity
  FROM graphs_all g JOIN deg USING (graph_id, rule_id) JOIN comps USING (graph_id, rule_id) JOIN tri USING (graph_id, rule_id) GROUP BY ALL""",
)
cte(
    "sim",
    "pgraphs",
    f"""SELECT x.graph_id AS graph_id_a, y.graph_id AS graph_id_b, x.geography_code = y.geography_code AS same_state, x.ses_category = y.ses_category AS same_ses,
       {bits("x.mask")} AS edges_a, {bits("y.mask")} AS edges_b, {jaccard("x.mask", "y.mask")} AS edge_jaccard, 1 - bit_count(xor(x.mask, y.mask)) / CAST(45 AS DOUBLE) AS edge_agreement
  FROM pgraphs x JOIN pgraphs y ON x.graph_id < y.graph_id""",
)
# binomials by recurrence, in doubles: exact up to 45
cte("comb", "", "SELECT 0 AS n, 0 AS k, CAST(1 AS DOUBLE) AS c UNION ALL SELECT n + 1, j, c * CASE WHEN j = k THEN (n + 1) / CAST(n + 1 - k AS DOUBLE) ELSE (n + 1) / CAST(k + 1 AS DOUBLE) END FROM comb, unnest([k, k + 1]) t(j) WHERE n < 45 AND (j = k OR k = n)")
cte("comb45", "comb", "SELECT n, k, round(c) AS c FROM comb")
cte(
    "nulls",
    "sim comb45",
    """SELECT edges_a, edges_b, edge_jaccard, e AS null_expected, sqrt(CASE WHEN m2 - e * e > CAST(1e-14 AS DOUBLE) THEN m2 - e * e ELSE 0 END) AS null_sd, null_p_upper FROM (
    SELECT edges_a, edges_b, edge_jaccard, sum(p * j) AS e, sum(p * j * j) AS m2, sum(CASE WHEN j >= edge_jaccard - CAST(1e-12 AS DOUBLE) THEN p ELSE 0 END) AS null_p_upper FROM (
      SELECT s.edges_a, s.edges_b, s.edge_jaccard, x.c * y.c / z.c AS p, CASE WHEN s.edges_a + s.edges_b - i > 0 THEN i / CAST(s.edges_a + s.edges_b - i AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS j
      FROM (SELECT edges_a, edges_b, edge_jaccard, unnest(range(greatest(0, edges_a + edges_b - 45), least(edges_a, edges_b) + 1)) AS i FROM (SELECT DISTINCT edges_a, edges_b, edge_jaccard FROM sim)) s
      JOIN comb45 x ON x.n = s.edges_a AND x.k = i JOIN comb45 y ON y.n = 45 - s.edges_a AND y.k = s.edges_b - i JOIN comb45 z ON z.n = 45 AND z.k = s.edges_b) GROUP BY ALL)""",
)
cte("simz", "sim nulls", "SELECT s.*, null_expected, null_sd, null_p_upper, CASE WHEN null_sd > 0 THEN (s.edge_jaccard - null_expected) / null_sd END AS density_z, s.edge_jaccard - null_expected AS density_excess FROM sim s JOIN nulls USING (edges_a, edges_b, edge_jaccard)")
cte("typed", "simz", "SELECT *, CASE WHEN same_state AND NOT same_ses THEN 'within_state_different_ses' WHEN NOT same_state AND same_ses THEN 'same_ses_cross_state' WHEN NOT same_state AND NOT same_ses THEN 'cross_ses_cross_state' ELSE 'other' END AS comparison_type FROM simz")
cte("mirror", "simz", "SELECT graph_id_a AS graph_id, graph_id_b AS peer_id, * FROM simz UNION ALL SELECT graph_id_b, graph_id_a, * FROM simz")


def wilson(p: str, n: str) -> tuple[str, str, str]:
    z, m = f"CAST({Z95!r} AS DOUBLE)", f"nullif(CAST({n} AS DOUBLE), 0)"
    low = f"(1 + {z} * {z} / {m})"
    centre = f"(({p} + {z} * {z} / (2 * {m})) / {low})"
    radius = f"({z} * sqrt({p} * (1 - {p}) / {m} + {z} * {z} / (4 * {m} * {m})) / {low})"
    return f"sqrt({p} * (1 - {p}) / {m})", f"({centre} - {radius})", f"({centre} + {radius})"
