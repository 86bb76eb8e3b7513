"""Covariate-adjusted logistic associations under a stratified cluster design.

Point models: weighted logistic regression of one condition on another, age group and sex as factors, by
iteratively reweighted least squares; the variance is the linearised one, from PSU totals of the slope's influence
within strata over the state's whole design (persons outside the domain have none), a lone PSU being
centred at the mean of all. Bootstrap models refit the point model with replicate weights.

Neither step gathers a state's persons. A model's coefficients depend on its population's answer patterns (3^k times
age groups and sexes at most), which are summed first. For the variance, persons get the influence of their
pattern in a stream sorted by population, stratum and PSU: a task holds one PSU's and one stratum's totals.
Refits get their patterns' sums per replicate from `resample.over_replicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.columns import bh, valid_weight, wilson
from affinis.operators.association import PAIR_KEYS, masked
from affinis.operators.resample import CHUNK, DESIGN, numbered, over_replicates, random_draws
from affinis.operators.tables import settle

ITERATIONS, TOLERANCE = 25, 1e-8


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz: f = 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or tiny)
        c = 1 + even / c or tiny
        f *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or tiny)
        c = 1 + odd / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@lru_cache(4096)
def t_quantile(p: float, df: float) -> float:
    """The t at which the upper tail is 1 - p, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def design_matrix(x: np.ndarray, *factors: tuple[np.ndarray, list[str]]) -> np.ndarray:
    """Intercept, exposure and treatment contrasts of each factor's levels."""
    cols = [np.ones(len(x)), x]
    for values, levels in factors:
        cols += [(values == v).astype(float) for v in levels[1:]]
    return np.column_stack(cols)


def irls(X: np.ndarray, y: np.ndarray, W: np.ndarray, start: np.ndarray | None = None, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, information, converged, solvable) of weighted logistic regressions, one for each column of weights.

    start: coefficients that all of them begin with; counted gets the number of models of each iteration.
    """
    n, k = W.shape[1], X.shape[1]
    beta, info = np.zeros((n, k)), np.zeros((n, k, k))
    if start is not None:
        beta += start
    converged, solvable = np.zeros(n, bool), W.any(axis=0)
    W = (W / np.maximum(W.mean(axis=0), 1e-300)).T
    outer = (X[:, :, None] * X[:, None, :]).reshape(len(X), k * k)
    for _ in range(ITERATIONS):
        at = np.flatnonzero(solvable & ~converged)
        if not len(at):
            break
        if counted is not None:
            counted.append(len(at))
        mu = 1 / (1 + np.exp(-np.clip(beta[at] @ X.T, -30, 30)))
        info[at] = ((W[at] * mu * (1 - mu)) @ outer).reshape(-1, k, k)
        ok = np.linalg.matrix_rank(info[at], tol=1e-12, hermitian=True) == k
        solvable[at[~ok]] = False
        at, mu = at[ok], mu[ok]
        if len(at):
            step = np.linalg.solve(info[at], ((W[at] * (y - mu)) @ X)[:, :, None])[:, :, 0]
            beta[at] += step
            converged[at] = np.abs(step).max(axis=1) < TOLERANCE
    return beta, info, converged, solvable


def refits(X: np.ndarray, y: np.ndarray, W: np.ndarray, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, solvable) of the replicates of one model: all begin where their mean weights lead.

    A replicate that doesn't converge from there, or can't be solved, is fitted from zero.
    """
    mean = irls(X, y, W.mean(axis=1, keepdims=True))
    beta, _, converged, solvable = irls(X, y, W, mean[0][0] if mean[2][0] else None, counted)
    again = np.flatnonzero(W.any(axis=0) & ~(converged & solvable))
    if mean[2][0] and len(again):
        beta[again], _, _, solvable[again] = irls(X, y, W[:, again], None, counted)
    return beta, solvable


class Domain:
    """Answer patterns of a population that count for a pair: complete in both conditions and in the covariates."""

    def __init__(self, columns: list[np.ndarray], exposure: int, outcome: int):
        case, seen, age, sex = columns
        self.inside = ((seen >> exposure) & (seen >> outcome) & 1 == 1) & (age != "") & (sex != "")
        self.x, self.y = ((case >> i & 1).astype(float) for i in (exposure, outcome))
        self.age, self.sex = age, sex

    @cached_property
    def ages(self) -> list[str]:
        return sorted(set(self.age[self.inside]))

    @cached_property
    def sexes(self) -> list[str]:
        return sorted(set(self.sex[self.inside]))

    def design(self, ages: list[str], sexes: list[str]) -> np.ndarray:
        return design_matrix(self.x, (self.age, ages), (self.sex, sexes))


def _fit(columns: list[np.ndarray], w: np.ndarray, exposure: int, outcome: int) -> dict:
    """Status, slope, and what the influence of a pattern follows from: coefficients, a row of the inverse information, scale, levels."""
    d = Domain(columns, exposure, outcome)
    at = np.flatnonzero(d.inside)
    none = {"status": "error", "message": "", "b": None, "ok": False, "beta": None, "row": None, "scale": None, "ages": d.ages, "sexes": d.sexes}
    if not len(at) or len(set(d.y[at])) < 2:
        return none | {"message": "the outcome does not vary"}
    if len(set(d.x[at])) < 2:
        return none | {"status": "coefficient_missing", "message": "the exposure does not vary"}
    beta, info, ok, solvable = irls(d.design(d.ages, d.sexes)[at], d.y[at], w[at, None])
    if not solvable[0]:
        return none | {"message": "Singular matrix"}
    return none | {"status": "ok", "message": "" if ok[0] else "not converged", "b": float(beta[0, 1]), "ok": bool(ok[0]), "beta": beta[0].tolist(), "row": np.linalg.inv(info[0])[1].tolist(), "scale": float(1 / w[at].mean())}


MODEL = "graph_id string, source_condition string, target_condition string, reverse boolean, status string, message string, b double, ok boolean, beta array<double>, row array<double>, scale double, ages array<string>, sexes array<string>"
PATTERN = ["case_mask", "seen_mask", "age", "gender"]
TOTALS = ["spread", "lone_square", "lone", "total", "psus", "strata"]


def cells(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Persons with a valid weight, summed by population, PSU and pattern of answers and covariates ('' for none)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = masked(df.where(valid_weight("survey_weight")), conditions).withColumn("age", text("age_group")).withColumn("gender", text("sex"))
    return df.groupBy("graph_id", *DESIGN, *PATTERN).agg(F.sum("survey_weight").alias("w"))


def _columns(df: pd.DataFrame) -> list[np.ndarray]:
    return [df.case_mask.to_numpy(np.int64), df.seen_mask.to_numpy(np.int64), df.age.to_numpy(object), df.gender.to_numpy(object)]


def _influence(models: list[dict], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(patterns x models of the slope's influence per unit of weight, whether the pattern is in the model's domain)."""
    out, inside = np.zeros((len(columns[0]), len(models))), np.zeros((len(columns[0]), len(models)), bool)
    designs: dict[tuple, np.ndarray] = {}  # models of the same levels differ in the exposure's column only
    for j, m in enumerate(models):
        d = Domain(columns, m["exposure"], m["outcome"])
        levels = (*m["ages"], "", *m["sexes"])
        if levels not in designs:
            designs[levels] = d.design(m["ages"], m["sexes"])
        X = designs[levels]
        X[:, 1] = d.x
        mu = 1 / (1 + np.exp(-np.clip(X @ np.array(m["beta"]), -30, 30)))
        out[:, j], inside[:, j] = np.where(d.inside, m["scale"] * (d.y - mu) * (X @ np.array(m["row"])), 0.0), d.inside
    return out, inside


class _Totals:
    """Totals of a population's models: by PSU, then by stratum, then over all; only the current ones are held."""

    def __init__(self, n_models: int):
        self.sums = np.zeros((len(TOTALS), n_models))
        self.psu = self.stratum = None
        self.n = 0

    def add(self, stratum: object, n: int, psu: object, u: np.ndarray, used: np.ndarray) -> None:
        """Influence of some persons of a PSU, whose stratum has n PSUs in all."""
        if (stratum, psu) != self.psu:
            self.end_psu()
            if stratum != self.stratum:
                self.end_stratum()
                self.stratum, self.n = stratum, n
                self.square, self.of, self.any = np.zeros_like(u), np.zeros_like(u), np.zeros(len(u), bool)
            self.psu, self.u, self.used = (stratum, psu), np.zeros_like(u), np.zeros(len(u), bool)
        self.u += u
        self.used |= used

    def end_psu(self) -> None:
        if self.psu is not None:
            self.square += self.u**2
            self.of += self.u
            self.any |= self.used
            self.sums[4] += self.used
            self.psu = None

    def end_stratum(self) -> None:
        self.end_psu()
        if self.stratum is not None:
            if self.n > 1:
                self.sums[0] += self.n / (self.n - 1) * (self.square - self.of**2 / self.n)
            else:
                self.sums[1] += self.square
                self.sums[2] += self.of
            self.sums[3] += self.of
            self.sums[5] += self.any
            self.stratum = None


def _design_totals(rows: DataFrame, shipped) -> DataFrame:
    """(graph_id, model, TOTALS) from cells with n_psu, sorted by population, stratum and PSU."""
    schema = "graph_id string, model int, " + ", ".join(f"{t} double" for t in TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, totals = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if totals is not None:
                totals.end_stratum()
                n = totals.sums.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([graph] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, totals.sums)], ["graph_id", "model", *TOTALS])

        for batch in batches:
            df = batch.to_pandas()
            for g, part in df.groupby("graph_id", sort=False):
                if g not in shipped.value:
                    continue
                if g != graph:
                    yield from done()
                    graph, totals = g, _Totals(len(shipped.value[g]))
                first_of, at = numbered([pa.array(part[c]) for c in PATTERN])
                one = part.iloc[first_of]
                value, inside = _influence(shipped.value[g], _columns(one))
                psu = pd.factorize(pd.MultiIndex.from_frame(part[["survey_strata", "survey_psu"]]))[0]
                first = np.flatnonzero(np.r_[True, psu[1:] != psu[:-1]])
                u = np.add.reduceat(part.w.to_numpy()[:, None] * value[at], first)
                used = np.add.reduceat(inside[at].astype(int), first) > 0
                head = part.iloc[first]
                for i, (s, n, p) in enumerate(zip(head.survey_strata, head.n_psu, head.survey_psu, strict=True)):
                    totals.add(s, n, p, u[i], used[i])
        yield from done()

    return rows.mapInArrow(run, schema)


def _intervals(level: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            se, low, high, p = [], [], [], []
            for b, var, freedom in zip(df.b, df.variance, df.freedom, strict=True):
                e = math.sqrt(max(var, 0.0)) if b == b and b is not None and var == var else None
                q = t_quantile((1 + level) / 2, float(freedom)) if e is not None else None
                se.append(e)
                low.append(b - q * e if e is not None else None)
                high.append(b + q * e if e is not None else None)
                p.append(t_two_sided(b / e, float(freedom)) if e else None)
            yield df.drop(columns=["variance", "freedom"]).assign(se=se, low=low, high=high, p=p)

    return run


def adjusted_models(df: DataFrame, jobs: DataFrame, conditions: list[str], level: float = 0.95) -> DataFrame:
    """Point models of the jobs (graph_id, pair), both directions; no job gives no row."""
    spark = df.sparkSession
    number = {c: i for i, c in enumerate(conditions)}
    persons = settle(cells(df, conditions))

    def fit(key: tuple, patterns: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        columns, w, out = _columns(patterns), patterns.w.to_numpy(), []
        for a, b in zip(todo.source_condition, todo.target_condition, strict=True):
            for reverse in (False, True):
                x, y = (b, a) if reverse else (a, b)
                out.append((todo.graph_id.iloc[0], a, b, reverse, *_fit(columns, w, number[x], number[y]).values()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MODEL.split(", ")])

    sums = persons.groupBy("graph_id", *PATTERN).agg(F.sum("w").alias("w"))
    models = settle(sums.groupBy("graph_id").cogroup(jobs.select(*PAIR_KEYS).groupBy("graph_id")).applyInPandas(fit, MODEL))
    # models number populations x pairs, a dimension; their coefficients go to every worker
    known: dict[str, list[dict]] = {}
    places = []
    for m in models.where("status = 'ok'").orderBy("graph_id", "source_condition", "target_condition", "reverse").toLocalIterator():
        own = known.setdefault(m.graph_id, [])
        x, y = (m.target_condition, m.source_condition) if m.reverse else (m.source_condition, m.target_condition)
        places.append((m.graph_id, m.source_condition, m.target_condition, m.reverse, len(own)))
        own.append({"exposure": number[x], "outcome": number[y], "beta": m.beta, "row": m.row, "scale": m.scale, "ages": m.ages, "sexes": m.sexes})
    design = df.where(valid_weight("survey_weight")).select(*DESIGN).distinct()
    strata = design.groupBy("state_code", "survey_strata").agg(F.count("*").alias("n_psu"))
    whole = strata.groupBy("state_code").agg(F.sum("n_psu").alias("design_psus"), F.count_if(F.col("n_psu") == 1).alias("lone_strata"))
    order = ["graph_id", "survey_strata", "survey_psu"]
    rows = persons.join(strata, ["state_code", "survey_strata"]).select("graph_id", "survey_strata", "survey_psu", *PATTERN, "w", "n_psu")
    # a stratum's persons of a population stream through one task
    totals = _design_totals(rows.repartition("graph_id", "survey_strata").sortWithinPartitions(*order), spark.sparkContext.broadcast(known))
    totals = totals.groupBy("graph_id", "model").agg(*[F.sum(t).alias(t) for t in TOTALS])
    of = spark.createDataFrame(places, "graph_id string, source_condition string, target_condition string, reverse boolean, model int")
    states = persons.select("graph_id", "state_code").distinct().join(whole, "state_code").drop("state_code")
    found = models.join(F.broadcast(of), [*PAIR_KEYS, "reverse"], "left").join(totals, ["graph_id", "model"], "left").join(states, "graph_id")
    mean = F.col("total") / F.col("design_psus")
    variance = F.col("spread") + F.col("lone_square") - 2 * F.col("lone") * mean + F.col("lone_strata") * mean * mean
    freedom = F.greatest(F.lit(1.0), F.col("psus") - F.col("strata") - F.size("beta") + 1)
    done = found.select(*PAIR_KEYS, "reverse", "status", "message", "b", "ok", variance.alias("variance"), freedom.alias("freedom"))
    kinds = "graph_id string, source_condition string, target_condition string, reverse boolean, status string, message string, b double, ok boolean, se double, low double, high double, p double"
    done = done.mapInPandas(_intervals(level), kinds)
    pick = lambda reverse, c, name: F.first(F.when(F.col("reverse") == reverse, F.col(c)), ignorenulls=True).alias(name)
    forward = {"status": "model_status", "message": "model_message", "b": "log_odds_ratio", "se": "standard_error", "low": "confidence_low_log", "high": "confidence_high_log", "p": "p_value", "ok": "converged"}
    backward = {"status": "reverse_model_status", "b": "reverse_log_odds_ratio", "se": "reverse_standard_error", "p": "reverse_p_value", "ok": "reverse_converged"}
    return done.groupBy(*PAIR_KEYS).agg(*[pick(False, c, n) for c, n in forward.items()], *[pick(True, c, n) for c, n in backward.items()])


def adjusted_edges(models: DataFrame, pairs: DataFrame, maximum_q: float = 0.05) -> DataFrame:
    """models with odds ratios, q, concordance and the edge flag.

    q is taken over all models of a population, whether their pair is eligible or not; pairs (keys, pair_eligible)
    say which of them may be edges.
    """
    out = models.join(pairs.select(*PAIR_KEYS, "pair_eligible"), PAIR_KEYS, "left").withColumn("q_value", bh(F.col("p_value"), ["graph_id"]))
    logs = {"odds_ratio": "log_odds_ratio", "confidence_low": "confidence_low_log", "confidence_high": "confidence_high_log", "reverse_odds_ratio": "reverse_log_odds_ratio"}
    out = out.withColumns({k: F.exp(v) for k, v in logs.items()})
    out = out.withColumn("direction_concordant", F.coalesce(F.signum("log_odds_ratio") == F.signum("reverse_log_odds_ratio"), F.lit(False)))
    edge = F.col("pair_eligible") & (F.col("model_status") == "ok") & F.col("converged") & (F.col("log_odds_ratio") > 0) & (F.col("confidence_low") > 1) & (F.col("q_value") <= maximum_q)
    return out.withColumn("edge_present", F.coalesce(edge, F.lit(False)))


def adjusted_bootstrap(df: DataFrame, jobs: DataFrame, conditions: list[str], replicates: int, seed: int) -> DataFrame:
    """Replicate refits of the jobs' point models: sign stability and percentile interval of the log odds ratio."""
    spark = df.sparkSession
    number = {c: i for i, c in enumerate(conditions)}
    todo: dict[str, list[tuple[str, str]]] = {}
    for j in jobs.select(*PAIR_KEYS).toLocalIterator():  # populations x pairs: a dimension
        todo.setdefault(j.graph_id, []).append((j.source_condition, j.target_condition))
    shipped = spark.sparkContext.broadcast(todo)

    def finish(graph: str, part: int, columns: list[np.ndarray], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [columns[0].astype(np.int64), columns[1].astype(np.int64), *(c.astype(object) for c in columns[2:])]
        sums = sums[:, : 1 if part < 0 else min(CHUNK, replicates - part * CHUNK)]  # part -1 has the weights themselves
        rows = []
        for a, b in shipped.value.get(graph, []):
            d = Domain(columns, number[a], number[b])
            at = np.flatnonzero(d.inside)
            X, y = d.design(d.ages, d.sexes), d.y
            # patterns that agree in outcome, exposure and covariates are one cell
            cell, of = np.unique(np.column_stack([X, y])[at], axis=0, return_inverse=True)
            W = np.zeros((len(cell), sums.shape[1]))
            np.add.at(W, of.ravel(), sums[at])
            beta, solvable = refits(cell[:, :-1], cell[:, -1], W) if len(cell) else (np.zeros((sums.shape[1], 2)), np.zeros(sums.shape[1], bool))
            values = [float(v) if ok and np.isfinite(v) else None for v, ok in zip(beta[:, 1], solvable, strict=True)]
            rows.append((graph, a, b, part, values))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())), strict=True)], [*PAIR_KEYS, "part", "values"])

    persons = settle(cells(df, conditions).join(F.broadcast(jobs.select("graph_id").distinct()), "graph_id", "left_semi"))
    own = df.where(valid_weight("survey_weight")).select(*DESIGN).distinct()
    whole = own.select(*DESIGN, F.lit(-1).alias("chunk"), F.array(F.lit(0).cast("short")).alias("reps"), F.array(F.lit(1).cast("short")).alias("times"))
    draws = random_draws(df, replicates, seed).select(whole.columns).union(whole)
    fits = over_replicates(persons, draws, PATTERN, finish, "graph_id string, source_condition string, target_condition string, part int, values array<double>")
    v = F.col("v")
    long = settle(fits).select(*PAIR_KEYS, "part", F.explode_outer("values").alias("v"))
    drawn = F.when(F.col("part") >= 0, v)
    out = long.groupBy(*PAIR_KEYS).agg(
        F.max(F.when(F.col("part") < 0, v)).alias("bootstrap_log_odds_ratio"), F.count(drawn).cast("int").alias("bootstrap_replicates_valid"),
        F.avg(F.when(drawn.isNotNull(), (drawn > 0).cast("double"))).alias("positive_stability"), F.percentile(drawn, 0.025).alias("bootstrap_low_log"), F.percentile(drawn, 0.975).alias("bootstrap_high_log"),
    )
    status = F.when(F.col("bootstrap_log_odds_ratio").isNotNull(), "ok").otherwise("error")
    return out.select(*PAIR_KEYS, status.alias("bootstrap_status"), "bootstrap_log_odds_ratio", F.lit(replicates).alias("bootstrap_replicates_requested"), "bootstrap_replicates_valid", "positive_stability", "bootstrap_low_log", "bootstrap_high_log")


def stability(boot: DataFrame) -> DataFrame:
    se, low, high = wilson(F.col("positive_stability"), F.col("bootstrap_replicates_valid"))
    return boot.withColumns({"stability_standard_error": se, "stability_wilson_low": low, "stability_wilson_high": high})


def sign_stable(adjusted: DataFrame, boot: DataFrame, threshold: float) -> DataFrame:
    """Adjusted edges whose replicates are complete and positive often enough."""
    df = adjusted.join(boot, PAIR_KEYS, "left")
    ok = F.col("edge_present") & (F.col("bootstrap_status") == "ok") & (F.col("bootstrap_replicates_valid") == F.col("bootstrap_replicates_requested")) & (F.col("positive_stability") >= threshold)
    return df.withColumn("edge_present", F.coalesce(ok, F.lit(False)))


def concordance(edges: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Per rule: selected edges, those with a model, positive in one and in both directions, and FDR-supported ones."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fwd: Column = yes((F.col("model_status") == "ok") & F.col("converged") & (F.col("log_odds_ratio") > 0))
    rev: Column = yes((F.col("reverse_model_status") == "ok") & F.col("reverse_converged") & (F.col("reverse_log_odds_ratio") > 0))
    a = adjusted.select(*PAIR_KEYS, fwd.alias("fwd"), (fwd & rev).alias("both"), F.col("edge_present").alias("fdr"), F.lit(True).alias("matched"))
    df = edges.where("edge_present").select(*PAIR_KEYS, "rule_id").join(a, PAIR_KEYS, "left")
    n = F.count("*")
    share = lambda c: F.count_if(yes(F.col(c))) / n
    return df.groupBy("rule_id").agg(
        n.alias("selected_edge_count"), F.count_if(yes(F.col("matched"))).alias("adjusted_model_match_count"), F.count_if(yes(F.col("fwd"))).alias("adjusted_positive_forward_count"), share("fwd").alias("adjusted_positive_forward_fraction"),
        F.count_if(yes(F.col("both"))).alias("adjusted_positive_both_directions_count"), share("both").alias("adjusted_positive_both_directions_fraction"),
        F.count_if(yes(F.col("fdr"))).alias("adjusted_fdr_supported_count"), share("fdr").alias("adjusted_fdr_supported_fraction"),
    )


def direction_diagnostic(models: DataFrame) -> DataFrame:
    same = F.coalesce(F.signum("log_odds_ratio") == F.signum("reverse_log_odds_ratio"), F.lit(False))
    bad = (F.col("model_status") != "ok") | (F.col("reverse_model_status") != "ok")
    return models.agg(F.count("*").alias("dyads"), F.count_if(same).alias("direction_concordant"), F.count_if(bad).alias("failed_models"), F.count_if(~F.col("converged") | ~F.col("reverse_converged")).alias("not_converged"))
