"""The jobs as registered queries, with their DuckDB SQL: each runs twice into one new folder and returns what is there."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from affinis.functions.columns import r
from affinis.operators.tables import shared_folder
from affinis.plans import sqlbase as S
from jobs import incremental_audit, stability_bank


def settings(name: str) -> dict:
    """The job's own settings, beside its code."""
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: r(c, n) for c, n in digits.items()})


def job1_stability_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1-stability-bank")
    for _ in range(2):  # the second run finds every state finished
        out = stability_bank.run(spark, sf_dir, folder, settings("stability_bank"))
    return out


AUDIT_DIGITS = {"weight": 2, "kish_effective_n": 6, "value": 8}


def job2_incremental_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = shared_folder(spark, "job2-incremental-audit"), f"{sf_dir.rstrip('/')}/documents.parquet*"  # a pattern names one file or a folder of them
    for _ in range(2):  # the second run finds nothing new
        out = incremental_audit.run(spark, files, f"{folder}/output", f"{folder}/checkpoint", settings("incremental_audit"))
    return _rounded(out, AUDIT_DIGITS)


_JOINED = "(graph_id, source_condition, target_condition)"
JOB1 = S.query(
    "pairs boot stab",
    f"""SELECT CAST(split_part(p.graph_id, '_', 2) AS INTEGER) AS state_code, graph_id, source_condition, target_condition, {S.r("p.association")} AS association, p.pair_eligible, p.exclusion_reason,
  {S.r("b.p0")} AS p_phi_gt_zero, {S.r("b.p1")} AS p_phi_ge_threshold, {S.r("med")} AS bootstrap_phi_median, {S.r("lo")} AS bootstrap_phi_025, {S.r("hi")} AS bootstrap_phi_975,
  b.valid AS bootstrap_replicates_valid, b.sel AS bootstrap_selection_mask, CASE WHEN b.valid > 0 THEN 'ok' ELSE 'no_valid_replicate' END AS bootstrap_status, s.edge_present
FROM pairs p JOIN boot b USING {_JOINED} JOIN stab s USING {_JOINED}""",
)

#: The conditions of incremental_audit.json.
TESTS = {
    "ADDRESS": "instr(text, '@') > 0", "DIGIT": "regexp_matches(text, '[0-9]')", "LINES": "instr(text, chr(10)) > 0", "LONG": "length(text) > 2000",
    "NOT_ASCII": "strlen(text) > length(text)", "QUESTION": "instr(text, '?') > 0",
}
_OK = "coalesce(n_chars > 0, false)"
_LONG = " UNION ALL ".join(f"SELECT source, CASE WHEN {_OK} THEN CAST(n_chars AS DOUBLE) ELSE 0 END AS w, {_OK} AS ok, '{c}' AS item, {t} AS x FROM documents" for c, t in TESTS.items())
_SHARE = "sum(CASE WHEN ok AND x THEN w ELSE 0 END) / nullif(sum(CASE WHEN ok AND x IS NOT NULL THEN w ELSE 0 END), 0)"
_PREVALENCE = f"""count(*) FILTER (ok AND x IS NOT NULL) AS n, count(*) FILTER (x IS NULL) AS n_missing, count(*) FILTER (ok AND x) AS n_cases, {S.r("sum(CASE WHEN ok AND x IS NOT NULL THEN w ELSE 0 END)", 2)} AS weight,
  {S.r("sum(CASE WHEN ok AND x IS NOT NULL THEN w ELSE 0 END) * sum(CASE WHEN ok AND x IS NOT NULL THEN w ELSE 0 END) / nullif(sum(CASE WHEN ok AND x IS NOT NULL THEN w * w ELSE 0 END), 0)", 6)} AS kish_effective_n, {S.r(_SHARE)} AS value, NULL AS status FROM answers"""
_SIZES = f"count(*) AS n, count(*) FILTER (NOT {_OK}) AS n_missing, CAST(NULL AS BIGINT) AS n_cases, {S.r(f'sum(CASE WHEN {_OK} THEN CAST(n_chars AS DOUBLE) ELSE 0 END)', 2)} AS weight, CAST(NULL AS DOUBLE) AS kish_effective_n, CAST(NULL AS DOUBLE) AS value"
JOB2 = f"""WITH answers AS ({_LONG})
SELECT 'state_sizes' AS report, source AS geography_code, CAST(NULL AS VARCHAR) AS item, {_SIZES}, CAST(NULL AS VARCHAR) AS status FROM documents GROUP BY source
UNION ALL SELECT 'categories', NULL, coalesce(lang, 'missing'), count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM documents GROUP BY 3
""" + "".join(
    f"UNION ALL SELECT 'missingness', NULL, '{c}', count(*), count(*) FILTER ({c} IS NULL), NULL, NULL, NULL, {S.r(f'count(*) FILTER ({c} IS NULL) / nullif(CAST(count(*) AS DOUBLE), 0)')}, NULL FROM documents\n" for c in ("text", "lang", "source", "n_chars")
) + f"""UNION ALL SELECT 'prevalence', source, item, {_PREVALENCE} GROUP BY source, item
UNION ALL SELECT 'prevalence', 'ALL', item, {_PREVALENCE} GROUP BY item
UNION ALL SELECT 'candidates', NULL, item, count(*), count(*) FILTER (x IS NULL), NULL, NULL, NULL, {S.r(_SHARE)},
  CASE WHEN {_SHARE} >= CAST(0.3 AS DOUBLE) AND count(*) FILTER (x IS NULL) / CAST(count(*) AS DOUBLE) <= CAST(0.1 AS DOUBLE) THEN 'provisional_include' ELSE 'review' END FROM answers GROUP BY item"""

QUERIES = {f.__name__: f for f in (job1_stability_bank, job2_incremental_audit)}
ORACLE = {"job1_stability_bank": JOB1, "job2_incremental_audit": JOB2}
