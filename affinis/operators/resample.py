"""Survey bootstrap of phi, stability rules, label permutation, degree-preserving nulls."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions.columns import hashed, ratio, valid_weight, wilson
from affinis.operators import association
from affinis.operators.graphs import pairs_of
from affinis.operators.tables import settle
from affinis.sources.bridge import CONDITIONS

KEYS = association.PAIR_KEYS
DESIGN = ["state_code", "survey_strata", "survey_psu"]
#: Replicates whose sums a task holds at once.
CHUNK = 250


def psu_draws(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(state_code, survey_strata, survey_psu, replicate, times): PSUs drawn with replacement within strata.

    Draw i of n in a stratum takes PSU 1 + hash mod n; all categories of a state share a replicate's draws.
    """
    psus = df.where(valid_weight("survey_weight")).select("state_code", "survey_strata", "survey_psu").distinct()
    w = Window.partitionBy("state_code", "survey_strata")
    psus = psus.withColumn("nth", F.row_number().over(w.orderBy(F.col("survey_psu").asc_nulls_last()))).withColumn("n", F.count("*").over(w))
    draw = psus.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    pick = 1 + F.pmod(hashed(seed, F.col("state_code"), F.col("survey_strata"), F.col("replicate"), F.col("nth")), F.col("n"))
    times = draw.select("state_code", "survey_strata", "replicate", pick.alias("nth")).groupBy("state_code", "survey_strata", "replicate", "nth").agg(F.count("*").alias("times"))
    return times.join(psus.drop("n"), ["state_code", "survey_strata", "nth"]).select("state_code", "survey_strata", "survey_psu", "replicate", "times")


def hash_picks(seed: int, state: str, stratum: str, n: int) -> Callable[[int], np.ndarray]:
    """The draws of psu_draws() in one stratum of n PSUs: replicate -> the PSU (from 0) that each of its n draws takes."""
    ends = [b"|%d" % i for i in range(1, n + 1)]

    def picks(replicate: int) -> np.ndarray:
        head = f"{seed}|{state}|{stratum}|{replicate}".encode()
        return np.frombuffer(b"".join([hashlib.md5(head + e).digest()[:4] for e in ends]), ">u4") % n

    return picks


def draw_counts(df: DataFrame, replicates: int, seed: int, block: int = 10) -> DataFrame:
    """(state_code, survey_strata, replicate, distinct_psus, draws) of psu_draws(); a task makes a block of a stratum's replicates.

    Only the strata and their numbers of PSUs are shuffled: a draw is made and counted where it is needed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, stratum, n, first = (batch.column(i).to_pylist() for i in range(2, 6))
            at, rep, found = [], [], []
            for i in range(batch.num_rows):
                picks = hash_picks(seed, state[i], stratum[i], n[i])
                for r in range(first[i], min(first[i] + block, replicates + 1)):
                    at.append(i)
                    rep.append(r)
                    found.append(np.count_nonzero(np.bincount(picks(r), minlength=n[i])))
            of = pa.array(at, pa.int64())
            out = [batch.column(0).take(of), batch.column(1).take(of), pa.array(rep, pa.int32()), pa.array(found, pa.int64()), batch.column(4).take(of)]
            yield pa.RecordBatch.from_arrays(out, ["state_code", "survey_strata", "replicate", "distinct_psus", "draws"])

    strata = design_psus(df).where("state_code IS NOT NULL AND survey_strata IS NOT NULL").groupBy("state_code", "survey_strata").agg(F.count("*").alias("n"))
    text = [F.col(c).cast("string").alias(f"{c}_text") for c in DESIGN[:2]]
    jobs = strata.select("state_code", "survey_strata", *text, "n", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(block))).alias("first"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strata.schema if f.name != "n")
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # few rows of much work: not to be coalesced
    return jobs.repartition(tasks, "state_code", "survey_strata", "first").mapInArrow(count, f"{kinds}, replicate int, distinct_psus bigint, draws bigint")


def design_psus(df: DataFrame) -> DataFrame:
    """The PSUs with a valid weight."""
    return df.where(valid_weight("survey_weight")).select(*DESIGN).distinct()


def packed(draws: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """draws by PSU and chunk of replicates: arrays of the replicates (counted from 0 within the chunk) that draw it, and of times."""
    place = F.struct(((F.col("replicate") - 1) % chunk).cast("short").alias("r"), F.col("times").cast("short").alias("t"))
    of = F.floor((F.col("replicate") - 1) / chunk).cast("int").alias("chunk")
    rows = draws.groupBy(*DESIGN, of).agg(F.collect_list(place).alias("d"))
    return rows.select(*DESIGN, "chunk", F.col("d.r").alias("reps"), F.col("d.t").alias("times"))


def random_draws(df: DataFrame, replicates: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """packed() draws of PCG64: n PSUs of n with replacement in each stratum; a task draws a chunk for a stratum."""

    def draw(key: tuple, psus: pd.DataFrame) -> pd.DataFrame:
        psus = psus.sort_values("survey_psu")
        stratum = zlib.crc32(repr(key[1]).encode())
        rng = np.random.Generator(np.random.PCG64([seed, int(key[0]), stratum, int(key[2])]))
        times = draw_times(np.zeros(len(psus), int), min(chunk, replicates - int(key[2]) * chunk), rng)
        reps = [np.flatnonzero(t).astype(np.int16) for t in times]
        return psus.assign(reps=reps, times=[t[r].astype(np.int16) for t, r in zip(times, reps, strict=True)])

    psus = df.where(valid_weight("survey_weight")).select(*DESIGN).distinct()
    jobs = psus.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.groupBy("state_code", "survey_strata", "chunk").applyInPandas(draw, f"{kinds}, reps array<short>, times array<short>")


def numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct pattern, the pattern's number of each row), column by column without a tuple a row."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code, return_inverse=True)[1] * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
    return np.unique(code, return_index=True, return_inverse=True)[1:]


class _Sums:
    """Sums of weights by answer pattern and replicate of one population and chunk of replicates."""

    def __init__(self, chunk: int):
        self.known: dict[tuple, int] = {}
        self.sums = np.zeros((64, chunk))

    def add(self, columns: list[pa.Array], w: np.ndarray, psu: np.ndarray, times: np.ndarray) -> None:
        """Cells of PSU rows of `times` (PSUs x replicates)."""
        first, number = numbered(columns)
        distinct = zip(*(c.take(pa.array(first)).to_pylist() for c in columns), strict=True)
        place = np.array([self.known.setdefault(p, len(self.known)) for p in distinct])
        if len(self.known) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(self.known) - len(self.sums)), self.sums.shape[1]))])
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
        self.sums[place] += np.add.reduceat(w[order, None] * times[psu[order]], starts, axis=0)


def over_replicates(cells: DataFrame, draws: DataFrame, patterns: list[str], finish: Callable[[str, int, list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """finish(graph_id, chunk, columns of its answer patterns, patterns x replicates of weight sums) of each population and chunk.

    cells: graph_id, design, patterns, w; draws: packed(). A PSU's draws are sent once to each of its populations and
    chunks, ahead of the PSU's cells, and the cells go as they are, once a chunk. They stream through a task that
    holds the sums of its answer patterns and no rows, so what it holds doesn't grow with the respondents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, None, np.zeros((1, chunk))  # last: the draws of the PSU that the batch before ended in

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and held.known:
                yield from finish(now[0], now[1], [np.array(c) for c in zip(*held.known, strict=True)], held.sums[: len(held.known)])

        for batch in batches:
            if not batch.num_rows:
                continue
            graph, part = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            codes = np.unique(graph, return_inverse=True)[1]
            edges = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])])
            for first, stop in zip(edges, np.r_[edges[1:], len(part)], strict=True):
                if now != (graph[first], int(part[first])):
                    yield from done()
                    now, held = (graph[first], int(part[first])), _Sums(chunk)
                piece = batch.slice(first, stop - first)
                w, reps, drawn = (piece.column(len(patterns) + i) for i in (2, 3, 4))
                head = w.is_null().to_numpy(zero_copy_only=False)  # a PSU's draws
                times = np.concatenate([last, np.zeros((int(head.sum()), chunk))])
                lists = reps.filter(pa.array(head))
                times[np.repeat(np.arange(1, len(times)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = drawn.filter(pa.array(head)).flatten().to_numpy()
                cell = np.flatnonzero(~head)
                if len(cell):
                    at = pa.array(cell)
                    held.add([piece.column(2 + i).take(at) for i in range(len(patterns))], w.take(at).to_numpy(), np.cumsum(head)[cell], times)
                last = times[-1:]
        yield from done()

    parts = draws.select("chunk").distinct()  # replicates / CHUNK rows
    each = cells.select("graph_id", *DESIGN).distinct().crossJoin(F.broadcast(parts)).join(draws, [*DESIGN, "chunk"], "left")
    none = F.array().cast("array<short>")
    ahead = each.select("graph_id", "chunk", *[F.lit(None).cast(cells.schema[p].dataType).alias(p) for p in patterns], F.lit(None).cast("double").alias("w"), F.coalesce("reps", none).alias("reps"), F.coalesce("times", none).alias("times"), *DESIGN)
    rows = ahead.union(cells.crossJoin(F.broadcast(parts)).select("graph_id", "chunk", *patterns, F.col("w").cast("double"), F.lit(None).cast("array<short>"), F.lit(None).cast("array<short>"), *DESIGN))
    rows = rows.repartition("graph_id", "chunk").sortWithinPartitions("graph_id", "chunk", *DESIGN, F.col("w").isNotNull())
    return rows.drop(*DESIGN).mapInArrow(run, schema)


def pattern_phi(case: np.ndarray, seen: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """phi (pairs x replicates) of answer patterns and their sums of weights: all pairs' moments are matrix products."""
    return moments_phi(pattern_moments(case, seen, sums, k))


def pattern_moments(case: np.ndarray, seen: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """Weights of complete rows, of cases of either condition and of both: 4 x pairs x replicates; they add up over parts of a population."""
    bit = lambda m, i: (m >> i) & 1
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    both = np.array([bit(seen, i) & bit(seen, j) for i, j in pairs], float)
    a = np.array([bit(case, i) for i, _ in pairs], float) * both
    b = np.array([bit(case, j) for _, j in pairs], float) * both
    return np.array([both @ sums, a @ sums, b @ sums, (a * b) @ sums])


def moments_phi(moments: np.ndarray) -> np.ndarray:
    """phi (pairs x replicates) of pattern_moments()."""
    n, sa, sb, sab = moments
    with np.errstate(divide="ignore", invalid="ignore"):
        pa_, pb, pab = sa / n, sb / n, sab / n
        spread = pa_ * (1 - pa_) * pb * (1 - pb)
        return np.where(spread > 1e-15, (pab - pa_ * pb) / np.sqrt(spread), np.nan)


def replicate_phi(df: DataFrame, draws: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_id, pair, replicate, phi) from rows of psu_draws(); null where a condition doesn't vary."""
    return phi_of_draws(df, packed(draws), conditions)


def phi_of_draws(df: DataFrame, draws: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """replicate_phi() of packed draws: weights times multiplicity, summed by answer pattern before the pairs are made."""
    k = len(conditions)
    names = [(a, b) for i, a in enumerate(conditions) for b in conditions[i + 1 :]]

    def finish(graph: str, part: int, columns: list[np.ndarray], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        drawn = np.flatnonzero(sums.any(axis=0))
        phi_ = pattern_phi(columns[0].astype(np.int64), columns[1].astype(np.int64), sums[:, drawn], k)
        n, m = len(names), len(drawn)
        a, b = (np.repeat([x[i] for x in names], m) for i in (0, 1))
        value = pa.array(phi_.ravel(), pa.float64(), from_pandas=True)  # NaN is null
        yield pa.RecordBatch.from_arrays([pa.array([graph] * (n * m), pa.string()), pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(np.tile(part * CHUNK + drawn + 1, n).astype(np.int32)), value], [*KEYS, "replicate", "phi"])

    cells = association.masked(df.where(valid_weight("survey_weight")), conditions).groupBy("graph_id", *DESIGN, "case_mask", "seen_mask").agg(F.sum("survey_weight").alias("w"))
    return over_replicates(cells, draws, ["case_mask", "seen_mask"], finish, "graph_id string, source_condition string, target_condition string, replicate int, phi double")


def hash_phi(df: DataFrame, people: DataFrame, replicates: int, seed: int, conditions: list[str] = CONDITIONS, chunk: int = CHUNK) -> DataFrame:
    """replicate_phi(df, psu_draws(people, replicates, seed)) without a row a draw; replicates that draw nothing of a population have null.

    Persons go once a chunk of replicates to their stratum's task, sorted by PSU. It draws the stratum's PSUs itself (PSUs x
    chunk small integers), sums weights by answer pattern, and sends on the pairs' moments, whose size depends on
    populations, strata and replicates alone. Persons with a part of their design missing are never drawn.
    """
    k = len(conditions)
    names = [(a, b) for i, a in enumerate(conditions) for b in conditions[i + 1 :]]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held = times = None
        psus = 0  # PSUs of the stratum so far

        def done() -> Iterator[pa.RecordBatch]:
            if held is None or not held.known:
                return
            keys = [np.array(c) for c in zip(*held.known, strict=True)]
            for g in np.unique(keys[0]):
                at = np.flatnonzero(keys[0] == g)
                m = pattern_moments(keys[1][at].astype(np.int64), keys[2][at].astype(np.int64), held.sums[at], k)
                yield pa.RecordBatch.from_arrays([pa.array([str(g)]), pa.array([now[2]], pa.int32()), pa.array([f"{now[0]}|{now[1]}"]), pa.array([m.ravel()], pa.list_(pa.float64()))], ["graph_id", "chunk", "stratum", "moments"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, w = batch.column(3), batch.column(7)
            heads = n.is_valid().to_numpy(zero_copy_only=False)  # a stratum's first row
            starts = np.flatnonzero(heads)
            for first, stop in zip(np.r_[0, starts], np.r_[starts, batch.num_rows], strict=True):
                if first < stop and heads[first]:
                    yield from done()
                    now = tuple(batch.column(i)[first].as_py() for i in range(3))
                    size, begin = n[first].as_py(), now[2] * chunk + 1
                    picks = hash_picks(seed, now[0], now[1], size)
                    times = np.zeros((min(chunk, replicates + 1 - begin), size), np.uint16)
                    for r, row in enumerate(times):
                        row += np.bincount(picks(begin + r), minlength=size).astype(np.uint16)
                    held, times, psus = _Sums(len(times)), np.ascontiguousarray(times.T), 0
                    first += 1
                if first >= stop:
                    continue
                piece = batch.slice(first, stop - first)
                person = piece.column(7).is_valid().to_numpy(zero_copy_only=False)  # others are a PSU's first row
                psu = psus + np.cumsum(~person) - 1
                psus = int(psu[-1]) + 1
                if person.any():
                    at = pa.array(np.flatnonzero(person))
                    held.add([piece.column(i).take(at) for i in (4, 5, 6)], piece.column(7).take(at).to_numpy(), psu[person], times)
        yield from done()

    def phis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                m = total.reshape(4, len(names), -1)
                each, begin = m.shape[2], now[1] * chunk + 1
                a, b = (np.repeat([x[i] for x in names], each).tolist() for i in (0, 1))
                rep = np.tile(np.arange(begin, begin + each), len(names)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(rep)), pa.array(a), pa.array(b), pa.array(rep), pa.array(moments_phi(m).ravel(), from_pandas=True)], [*KEYS, "replicate", "phi"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, m = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].values.to_numpy()
                if key != now:
                    yield from done()
                    now, total = key, np.zeros(len(m))
                total = total + m
        yield from done()

    psus = settle(design_psus(people))
    parts = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))).alias("chunk")
    none = lambda kind: F.lit(None).cast(kind)
    known = F.col("state_code").isNotNull() & F.col("survey_strata").isNotNull() & F.col("survey_psu").isNotNull()
    persons = association.masked(df.where(valid_weight("survey_weight")), conditions)
    kind = psus.schema["survey_psu"].dataType
    heads = psus.groupBy("state_code", "survey_strata").agg(F.count("*").alias("n")).select(*DESIGN[:2], none(kind).alias("survey_psu"), "n", none("string").alias("graph_id"), none("int").alias("case_mask"), none("int").alias("seen_mask"), none("double").alias("w"))
    rows = heads.union(psus.select(*DESIGN, none("long"), none("string"), none("int"), none("int"), none("double")))
    rows = rows.union(persons.select(*DESIGN, none("long"), "graph_id", "case_mask", "seen_mask", F.when(known, F.col("survey_weight").cast("double")).otherwise(0.0)))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # the draws are most of the work: not to be coalesced by size
    rows = rows.select("*", parts).repartition(tasks, "state_code", "survey_strata", "chunk")
    rows = rows.sortWithinPartitions("state_code", "survey_strata", "chunk", F.col("n").isNull(), F.col("survey_psu").asc_nulls_last(), F.col("w").isNotNull())
    text = [F.col(c).cast("string").alias(c) for c in DESIGN[:2]]
    moments = rows.select(*text, "chunk", "n", "graph_id", "case_mask", "seen_mask", "w").mapInArrow(sums, "graph_id string, chunk int, stratum string, moments array<double>")
    moments = moments.repartition("graph_id", "chunk").sortWithinPartitions("graph_id", "chunk", "stratum").select("graph_id", "chunk", "moments")
    return moments.mapInArrow(phis, "graph_id string, source_condition string, target_condition string, replicate int, phi double")


def selection_mask(threshold: float) -> Column:
    """b and one character a replicate: 1 selected, 0 not, x undefined."""
    char = F.when(F.col("phi").isNull(), "x").when(F.round("phi", 9) >= threshold, "1").otherwise("0")
    return F.concat(F.lit("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("replicate", char.alias("c")))), lambda x: x["c"]), ""))


def bootstrap_summary(rep: DataFrame, threshold: float, replicates: int) -> DataFrame:
    """Per pair: chances that phi is positive and selected, quantiles, intervals, the mask of replicates."""
    p = lambda test: F.avg(F.when(F.col("phi").isNotNull(), test.cast("int")))
    agg = rep.groupBy(*KEYS).agg(
        p(F.round("phi", 9) > 0).alias("p_phi_gt_zero"), p(F.round("phi", 9) >= threshold).alias("p_phi_ge_threshold"), F.median("phi").alias("bootstrap_phi_median"),
        F.percentile("phi", 0.025).alias("bootstrap_phi_025"), F.percentile("phi", 0.975).alias("bootstrap_phi_975"), F.count("phi").cast("int").alias("bootstrap_replicates_valid"), selection_mask(threshold).alias("bootstrap_selection_mask"),
    )
    se, low, high = wilson(F.col("p_phi_ge_threshold"), F.col("bootstrap_replicates_valid"))
    out = agg.withColumns({"selection_stability_standard_error": se, "selection_stability_wilson_low": low, "selection_stability_wilson_high": high})
    return out.withColumn("bootstrap_replicates_requested", F.lit(replicates)).withColumn("bootstrap_status", F.when(F.col("bootstrap_replicates_valid") > 0, "ok").otherwise("no_valid_replicate"))


def stable(pairs: DataFrame, boot: DataFrame, minimum_effect: float, stability: float) -> DataFrame:
    """Edges whose phi passes, whose replicates are complete, and whose selection is stable."""
    df = pairs.join(boot, KEYS, "left")
    ok = F.col("pair_eligible") & (F.col("association") >= minimum_effect) & (F.col("bootstrap_status") == "ok") & (F.col("bootstrap_replicates_valid") == F.col("bootstrap_replicates_requested")) & (F.col("p_phi_ge_threshold") >= stability)
    return df.withColumn("edge_present", F.coalesce(ok, F.lit(False)))


def agreement_errors(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """How many rows of the one-to-one join differ beyond 1e-12 + 1e-10 |y|, or are doubled."""
    j = a.select(*KEYS, x).join(b.select(*KEYS, y), KEYS)
    off = F.abs(F.col(x) - F.col(y)) > F.lit(1e-12) + F.lit(1e-10) * F.abs(F.col(y))
    return j.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(off).alias("off")).agg(F.sum("off").alias("mismatches"), F.count_if(F.col("n") > 1).alias("doubled"))


def completeness(boot: DataFrame, replicates: int) -> DataFrame:
    ok = (F.col("bootstrap_status") == "ok") & (F.col("bootstrap_replicates_requested") == replicates) & (F.col("bootstrap_replicates_valid") == replicates)
    b = boot.where(F.coalesce("pair_eligible", F.lit(False)))
    return b.groupBy("graph_id").agg(F.count("*").alias("eligible_dyad_count"), F.count_if(ok).alias("complete_bootstrap_dyad_count"), F.bool_and(ok).alias("graph_bootstrap_complete"))


#: Lower bounds and names of the phi bands.
BANDS = [(0.12, "0.12-0.13"), (0.13, "0.13-0.14"), (0.14, "0.14-0.15"), (0.15, "0.15-0.16"), (0.16, "0.16-0.18"), (0.18, "0.18-0.20"), (0.20, "0.20-0.25"), (0.25, "0.25-0.30"), (0.30, "0.30+")]
CUTOFFS = [0.14, 0.15, 0.16, 0.18, 0.20]


def phi_band(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in BANDS:
        out = F.when(x >= low, name).otherwise(out)
    return out


def band_summary(edges: DataFrame) -> DataFrame:
    """edges: raw edges with association, p_phi_ge_threshold, stable."""
    agg = edges.withColumn("point_phi_band", phi_band(F.round("association", 9))).groupBy("point_phi_band").agg(
        F.count("*").alias("raw_edges"), F.count_if("stable").alias("stable_edges"), F.count_if(~F.col("stable")).alias("unstable_edges"), F.avg(F.col("stable").cast("int")).alias("stable_fraction"),
        F.median("association").alias("median_point_phi"), F.median("p_phi_ge_threshold").alias("median_selection_stability"), F.min("p_phi_ge_threshold").alias("minimum_selection_stability"),
    )
    return agg


def cutoff_summary(edges: DataFrame) -> DataFrame:
    cuts = F.broadcast(edges.sparkSession.createDataFrame([(c,) for c in CUTOFFS], "cutoff double"))
    x = F.round("association", 9)
    return edges.crossJoin(cuts).groupBy("cutoff").agg(
        F.count_if(x >= F.col("cutoff")).alias("raw_at_or_above"), F.count_if((x >= F.col("cutoff")) & F.col("stable")).alias("stable_at_or_above"),
        F.count_if((x < F.col("cutoff")) & ~F.col("stable")).alias("unstable_below"), F.try_divide(F.count_if((x < F.col("cutoff")) & ~F.col("stable")).cast("double"), F.count_if(~F.col("stable")).cast("double")).alias("unstable_below_fraction"),
    )


def replicate_masks(boot: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_id, replicate, mask) from selection masks of eligible pairs; graphs without selected pairs have mask 0."""
    from affinis.operators.graphs import edge_bit

    bad = ~F.col("bootstrap_selection_mask").rlike("^b[01x]+$")
    text = F.when(bad, F.raise_error(F.lit("not a selection mask")).cast("string")).otherwise(F.substring("bootstrap_selection_mask", 2, 1 << 20))
    df = boot.where("pair_eligible").select("graph_id", edge_bit(F.col("source_condition"), F.col("target_condition"), conditions).alias("bit"), F.posexplode(F.split(text, "(?<=.)(?=.)")).alias("i", "c"))
    return df.groupBy("graph_id", (F.col("i") + 1).alias("replicate")).agg(F.bit_or(F.when(F.col("c") == "1", F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("mask"))


# --- label permutation of similarities -------------------------------------------------------------------

SWAP_METRICS = ["same_ses_mean", "lower_ses_mean", "higher_ses_mean", "cross_ses_mean", "same_minus_cross", "lower_minus_cross", "higher_minus_cross"]


def state_pair_similarity(pairs: DataFrame, value: str) -> DataFrame:
    """(a, b, ll, lh, hl, hh): the four similarities between the graphs of two states, a < b.

    pairs: unordered pairs of graphs with geography_a, geography_b, ses_a, ses_b and the value.
    """
    flip = F.col("geography_a") > F.col("geography_b")
    df = pairs.where("geography_a <> geography_b").select(
        F.least("geography_a", "geography_b").alias("a"), F.greatest("geography_a", "geography_b").alias("b"),
        F.when(flip, F.col("ses_b")).otherwise(F.col("ses_a")).alias("sa"), F.when(flip, F.col("ses_a")).otherwise(F.col("ses_b")).alias("sb"), F.col(value).alias("v"),
    )
    pick = lambda x, y: F.max(F.when((F.col("sa") == x) & (F.col("sb") == y), F.col("v")))
    return df.groupBy("a", "b").agg(pick("lower", "lower").alias("ll"), pick("lower", "higher").alias("lh"), pick("higher", "lower").alias("hl"), pick("higher", "higher").alias("hh"))


def swap_statistics(four: DataFrame, swaps: DataFrame) -> DataFrame:
    """The metrics of every permutation of swaps (permutation, geography_code, swap); permutation 0 is the observed one."""
    sa = swaps.select("permutation", F.col("geography_code").alias("a"), F.col("swap").alias("x"))
    sb = swaps.select("permutation", F.col("geography_code").alias("b"), F.col("swap").alias("y"))
    df = four.join(sa, "a").join(sb, ["permutation", "b"])
    ll, lh, hl, hh = (F.col(c) for c in ("ll", "lh", "hl", "hh"))
    lower = F.when(~F.col("x"), F.when(~F.col("y"), ll).otherwise(lh)).otherwise(F.when(~F.col("y"), hl).otherwise(hh))
    higher = F.when(~F.col("x"), F.when(~F.col("y"), hh).otherwise(hl)).otherwise(F.when(~F.col("y"), lh).otherwise(ll))
    same = F.when(F.col("x") == F.col("y"), ll + hh).otherwise(lh + hl)
    known = F.count("*") == F.count(ll + lh + hl + hh)
    mean = lambda c: F.when(known, F.round(F.avg(c), 10))  # noqa: E731  one unknown similarity makes the mean unknown
    agg = df.groupBy("permutation").agg(mean(same / 2).alias("same_ses_mean"), mean(lower).alias("lower_ses_mean"), mean(higher).alias("higher_ses_mean"), mean((ll + lh + hl + hh - same) / 2).alias("cross_ses_mean"))
    minus = lambda c: F.round(F.col(c) - F.col("cross_ses_mean"), 9)
    return agg.withColumns({"same_minus_cross": minus("same_ses_mean"), "lower_minus_cross": minus("lower_ses_mean"), "higher_minus_cross": minus("higher_ses_mean")})


def swap_test(stats: DataFrame, permutations: int) -> DataFrame:
    """Observed value, null summary and one-sided p of each metric."""
    long = stats.unpivot(["permutation"], SWAP_METRICS, "metric", "value")
    observed = long.where("permutation = 0").select("metric", F.col("value").alias("observed"))
    null = long.where("permutation > 0").join(F.broadcast(observed), "metric")
    agg = null.groupBy("metric", "observed").agg(
        F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_standard_deviation"), F.percentile("value", 0.025).alias("null_q025"), F.percentile("value", 0.975).alias("null_q975"), F.count_if(F.col("value") >= F.col("observed")).alias("h")
    )
    return agg.withColumn("p_value_one_sided_greater", F.when(F.col("observed").isNotNull(), (F.col("h") + 1) / F.lit(permutations + 1))).drop("h")


def hash_swaps(states: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(permutation, geography_code, swap) with nobody swapped in permutation 0."""
    spark = states.sparkSession
    perms = spark.range(0, permutations + 1).select(F.col("id").cast("int").alias("permutation"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("geography_code").cast("string")))
    return perms.crossJoin(F.broadcast(states.select("geography_code").distinct())).withColumn("swap", (F.col("permutation") > 0) & (F.substring(h, 1, 1) >= "8"))


# --- degree-preserving null ------------------------------------------------------------------------------


def _rewired(edges: list[tuple[int, int]], allowed: set[tuple[int, int]], target: int, rng: np.random.Generator) -> tuple[set[tuple[int, int]], int, int]:
    """Swap ends of random pairs of edges until `target` swaps are done or attempts run out; degrees never change.

    Fixed rules, which define the null: four different ends, new pairs eligible and not there yet, and at most 30
    attempts a swap wanted, 100 at least.
    """
    now, have = list(edges), set(edges)
    done = tried = 0
    limit = max(100, 30 * target)
    drawn: list[list[float]] = []
    while done < target and tried < limit and len(now) > 1:
        if not drawn:
            drawn = rng.random((min(limit - tried, 4096), 3)).tolist()  # one call for many attempts
        x, y, flip = drawn.pop()
        tried += 1
        i, j = int(x * len(now)), int(y * (len(now) - 1))
        j += j >= i
        (a, b), (c, d) = now[i], now[j]
        if flip < 0.5:
            c, d = d, c
        e, f = (a, c) if a < c else (c, a), (b, d) if b < d else (d, b)
        if len({a, b, c, d}) < 4 or e not in allowed or f not in allowed or e in have or f in have:
            continue
        have -= {now[i], now[j]}
        have |= {e, f}
        now[i], now[j] = e, f
        done += 1
    return have, done, tried


def degree_null(graphs: DataFrame, replicates: int, swaps_per_edge: int, seed: int, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_id, replicate, mask and counts of the chain): one seeded chain per (graph, replicate), all independent."""
    names = sorted(conditions)
    ends = [(names.index(a), names.index(b)) for a, b in pairs_of(conditions)]
    at = {e: i for i, e in enumerate(ends)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for g, m, o, rep, stream in zip(df.graph_id, df["mask"], df.opportunity, df.replicate, df.stream, strict=True):
                edges = [e for i, e in enumerate(ends) if m >> i & 1]
                allowed = {e for i, e in enumerate(ends) if o >> i & 1}
                if not set(edges) <= allowed:
                    raise ValueError(f"{g} has an edge that is not eligible")
                target = swaps_per_edge * len(edges)
                new, done, tried = _rewired(edges, allowed, target, np.random.Generator(np.random.PCG64([seed, int(stream), int(rep)])))
                mask = sum(1 << at[e] for e in new)
                out.append((g, rep, mask, target, done, tried, mask != m))
            yield pd.DataFrame(out, columns=["graph_id", "replicate", "mask", "target_swaps", "accepted_swaps", "attempted_swaps", "changed"])

    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    jobs = graphs.select("graph_id", "mask", "opportunity", hashed(seed, F.col("graph_id")).alias("stream"), reps).repartition("graph_id", "replicate")
    return jobs.mapInPandas(run, "graph_id string, replicate int, mask long, target_swaps int, accepted_swaps int, attempted_swaps int, changed boolean")


def chain_diagnostics(chains: DataFrame) -> DataFrame:
    return chains.groupBy("graph_id").agg(
        F.count_distinct("mask").alias("unique_masks"), F.avg(F.col("changed").cast("int")).alias("changed_fraction"),
        F.min(F.when(F.col("target_swaps") > 0, ratio(F.col("accepted_swaps"), F.col("target_swaps"))).otherwise(1.0)).alias("minimum_swap_completion"),
        F.median(ratio(F.col("accepted_swaps"), F.col("attempted_swaps"))).alias("median_acceptance"),
    )


def draw_times(strata: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """PSUs x replicates: how often each PSU is drawn, n of n with replacement in its stratum."""
    out = np.zeros((len(strata), replicates), np.float64)
    for s in np.unique(strata):
        at = np.flatnonzero(strata == s)
        draws = rng.integers(0, len(at), size=(len(at), replicates))
        flat = np.bincount((draws + np.arange(replicates) * len(at)).ravel(), minlength=len(at) * replicates)
        out[at] = flat.reshape(replicates, len(at)).T
    return out


def random_bootstrap(df: DataFrame, replicates: int, seed: int, threshold: float, conditions: list[str] = CONDITIONS) -> DataFrame:
    """bootstrap_summary() of PCG64 draws; all populations of a state share its draws."""
    return bootstrap_summary(phi_of_draws(df, random_draws(df, replicates, seed), conditions), threshold, replicates)
