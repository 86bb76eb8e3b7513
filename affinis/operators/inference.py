"""Density residuals, paired tests, sign flips, vocabulary replication."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import average_rank, bh, bits, contains, correlation, hashed, holm, ratio
from affinis.operators.tables import settle


def occurrence_probability(possible: Column, edges: Column, motif_edges: Column) -> Column:
    """That `edges` of `possible` pairs, drawn at random, hold given `motif_edges`: a falling product, no binomials."""
    product = F.aggregate(
        F.when(motif_edges > 0, F.sequence(F.lit(0), motif_edges - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(1.0),
        lambda acc, i: acc * (edges - i).cast("double") / (possible - i).cast("double"),
    )
    none = (motif_edges > possible) | (edges < motif_edges)
    broken = F.raise_error(F.lit("more edges than possible pairs")).cast("double")
    return F.when(none, 0.0).when(edges > possible, broken).otherwise(product)


def residuals(pairs: DataFrame, motifs: DataFrame) -> DataFrame:
    """(geography_code, motif columns, lower, higher residuals, their difference) where a motif is evaluable.

    pairs: of motifs.state_pairs(). A residual is 1 or 0 for occurrence, less its chance at the graph's density.
    """
    m = motifs.withColumnRenamed("mask", "motif_mask")
    df = pairs.join(F.broadcast(m), contains(F.col("opportunity"), F.col("motif_mask")))

    def residual(mask: str, opportunity: str) -> Column:
        seen = contains(F.col(mask), F.col("motif_mask")).cast("double")
        return seen - occurrence_probability(bits(opportunity), bits(mask), bits("motif_mask"))

    out = df.withColumn("lower_occurs", contains(F.col("lower"), F.col("motif_mask"))).withColumn("higher_occurs", contains(F.col("higher"), F.col("motif_mask")))
    out = out.withColumn("lower_residual", residual("lower", "lower_opportunity")).withColumn("higher_residual", residual("higher", "higher_opportunity"))
    names = [c for c in m.columns]
    return out.select("geography_code", *names, "lower_occurs", "higher_occurs", "lower_residual", "higher_residual", (F.col("lower_residual") - F.col("higher_residual")).alias("difference"))


def t_statistic(n: Column, total: Column, squares: Column) -> Column:
    """Mean over its standard error from count, sum and sum of squares; 0 or an infinity without variance."""
    mean = total / n
    var = (squares - n * mean * mean) / (n - 1)
    se = F.sqrt(F.when((n > 1) & (var > 1e-18), var).otherwise(0.0) / n)
    return F.when(n < 1, None).when(se > 0, F.try_divide(mean, se)).when(F.abs(mean) < 1e-12, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))


def paired_t(res: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("difference")
    agg = res.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.count_if("lower_occurs").alias("lower_support_count"), F.count_if("higher_occurs").alias("higher_support_count"),
        F.avg("lower_residual").alias("density_residual_mean_lower"), F.avg("higher_residual").alias("density_residual_mean_higher"),
    )
    return agg.select(
        *keys, F.col("n").cast("long").alias("state_pair_count"), "lower_support_count", "higher_support_count",
        ((F.col("lower_support_count") - F.col("higher_support_count")) / F.col("n")).alias("raw_support_fraction_difference"),
        "density_residual_mean_lower", "density_residual_mean_higher", (F.col("s") / F.col("n")).alias("paired_density_residual_difference"), t_statistic(F.col("n"), F.col("s"), F.col("ss")).alias("paired_density_residual_t"),
    )


def hash_signs(spark: SparkSession, states: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(permutation, geography_code, sign): signs that any engine draws alike."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("geography_code").cast("string")))
    perms = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("permutation"))
    return perms.crossJoin(F.broadcast(states.select("geography_code").distinct())).withColumn("sign", F.when(F.substring(h, 1, 1) >= "8", 1.0).otherwise(-1.0))


@dataclass(frozen=True)
class PcgSigns:
    """Signs (permutation x state in ascending order) of PCG64: the same bits for the same seed, whatever block is drawn.

    A sign is the top bit of a byte of the generator's stream, so a task can go straight to its own block.
    """

    states: tuple[int, ...]
    permutations: int
    seed: int

    def block(self, first: int, stop: int) -> np.ndarray:
        """int8 signs of permutations first to stop - 1, counted from 0."""
        n = len(self.states)
        before, size = divmod(first * n, 8)[0], (stop - first) * n
        skip = first * n - 8 * before
        words = np.random.PCG64(self.seed).advance(before).random_raw(-(-(skip + size) // 8))
        drawn = np.atleast_1d(words).astype("<u8").view(np.uint8)[skip : skip + size]
        return (drawn >> 7).astype(np.int8).reshape(stop - first, n) * 2 - 1


@dataclass(frozen=True)
class HashSigns:
    """Signs that any engine draws alike: + where the first hex digit of md5(seed|permutation|state) is 8 or more."""

    states: tuple[int, ...]
    permutations: int
    seed: int

    def block(self, first: int, stop: int) -> np.ndarray:
        up = [md5(f"{self.seed}|{p}|{s}".encode()).digest()[0] >= 128 for p in range(first + 1, stop + 1) for s in self.states]
        return np.array(up, np.int8).reshape(stop - first, len(self.states)) * 2 - 1


@dataclass(frozen=True)
class TableSigns:
    """Signs given as a matrix."""

    states: tuple[int, ...]
    matrix: np.ndarray

    @property
    def permutations(self) -> int:
        return len(self.matrix)

    def block(self, first: int, stop: int) -> np.ndarray:
        return self.matrix[first:stop]


Signs = PcgSigns | HashSigns | TableSigns


def state_list(pairs: DataFrame) -> tuple[int, ...]:
    """The states of a table in order: a dimension."""
    return tuple(sorted(r[0] for r in pairs.select("geography_code").distinct().collect()))


def sign_bank(states: list[int], permutations: int, seed: int) -> np.ndarray:
    """The whole bank of PcgSigns."""
    if len(set(states)) != len(states):
        raise ValueError("state codes must be unique")
    return PcgSigns(tuple(sorted(states)), permutations, seed).block(0, permutations)


def bank_frame(spark: SparkSession, states: list[int], permutations: int, seed: int) -> DataFrame:
    """The sign bank as (permutation, geography_code, sign): each task draws its own blocks of the stream."""
    if len(set(states)) != len(states):
        raise ValueError("state codes must be unique")
    signs = PcgSigns(tuple(sorted(states)), permutations, seed)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(signs.states)
        for b in batches:
            for i in b.column(0).to_pylist():
                first, stop = i * FLIPS, min((i + 1) * FLIPS, permutations)
                numbers = np.repeat(np.arange(first + 1, stop + 1, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.tile(np.array(signs.states, np.int32), stop - first)), pa.array(signs.block(first, stop).ravel().astype(float))], ["permutation", "geography_code", "sign"])

    return spark.range(-(-permutations // FLIPS)).mapInArrow(draw, "permutation int, geography_code int, sign double")


#: Rows of differences, and permutations, of one matrix product.
ROWS, FLIPS = 256, 4096
#: Differences (rows x states) that may be broadcast to tasks that share out the permutations; 8 bytes each.
BROADCAST_CELLS = 1 << 22


def _t_rounded(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """t_statistic() to nine places: rows x permutations of totals."""
    n, squares = n[:, None], squares[:, None]
    mean = total / n
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (squares - n * mean * mean) / (n - 1)
        se = np.sqrt(np.where((n > 1) & (var > 1e-18), var, 0.0) / n)
        return np.round(np.where(se > 0, mean / np.where(se > 0, se, 1.0), np.where(np.abs(mean) < 1e-12, 0.0, np.sign(mean) * np.inf)), 9)


def sign_matrix(signs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(states in order, signs as int8 permutations x states): permutations and states are both of configured size."""
    table = signs.select(F.col("permutation").cast("long"), F.col("geography_code").cast("long"), F.col("sign").cast("byte")).toArrow()
    permutation, state, sign = (table.column(i).to_numpy() for i in range(3))
    states, j = np.unique(state, return_inverse=True)
    number, i = np.unique(permutation, return_inverse=True)
    out = np.zeros((len(number), len(states)), np.int8)
    out[i, j] = sign
    return states, out


def as_signs(signs: Signs | DataFrame) -> Signs:
    if not isinstance(signs, DataFrame):
        return signs
    states, matrix = sign_matrix(signs)
    return TableSigns(tuple(states.tolist()), matrix)


def flip_counts(res: DataFrame, signs: Signs | DataFrame, keys: list[str]) -> DataFrame:
    """keys, t0, hits and, on some rows, tops: sign flips of the differences as products of blocks with the sign matrix.

    res: keys, geography_code, difference, side. The statistic is |t| for side 0, else side * t; hits are the
    permutations that reach the observed one, tops the largest statistic of each permutation in a block of rows.
    The sums of squares don't change with signs. Signs are drawn in the task, block by block.
    """
    drawn = as_signs(signs)
    shipped = res.sparkSession.sparkContext.broadcast(drawn) if isinstance(drawn, TableSigns) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value if shipped else drawn
        known, blocks = np.array(own.states), None
        for batch in batches:
            if blocks is None and batch.num_rows:  # int8: permutations x states bytes
                blocks = [own.block(p, min(p + FLIPS, own.permutations)) for p in range(0, own.permutations, FLIPS)]
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                lists = part.column(len(keys) + 1)
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                state, value = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                at = np.minimum(np.searchsorted(known, state), max(len(known) - 1, 0))
                inside = known[at] == state if len(known) else np.zeros(len(state), bool)
                d, n = np.zeros((len(part), len(known))), np.bincount(row[inside], minlength=len(part)).astype(float)
                d[row[inside], at[inside]] = value[inside]
                side, squares = part.column(len(keys)).to_numpy()[:, None], (d * d).sum(axis=1)
                stat = lambda total, side=side, n=n, squares=squares: (lambda t: np.where(side == 0, np.abs(t), side * t))(_t_rounded(np.maximum(n, 1), total, squares))
                t0 = stat(d @ np.ones((len(known), 1)))
                hits, tops = np.zeros(len(part), np.int64), []
                for flips in blocks:
                    t = stat(d @ flips.T.astype(float))
                    hits += (t >= t0).sum(axis=1)
                    tops.append(t.max(axis=0))
                top = [np.concatenate(tops) if tops else np.array([])] + [None] * (len(part) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array(t0[:, 0]), pa.array(hits), pa.array(top, pa.list_(pa.float64()))], [*keys, "t0", "hits", "tops"])

    rows = res.groupBy(*keys, F.col("side").cast("int").alias("side")).agg(F.collect_list(F.struct(F.col("geography_code").cast("long").alias("state"), "difference")).alias("d"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{schema}, t0 double, hits long, tops array<double>")


def mcse(p: Column, permutations: int) -> Column:
    return F.sqrt(p * (1 - p) / (permutations + 1))


def _matrix(res: DataFrame, keys: list[str], states: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(key columns, rows x states of differences, number of each row's states) of a table of at most BROADCAST_CELLS rows."""
    table = res.select(*keys, F.col("geography_code").cast("long"), F.col("difference").cast("double")).toArrow().combine_chunks()
    table = table.sort_by([(k, "ascending") for k in keys])
    codes = [np.unique(table.column(k).to_pylist(), return_inverse=True)[1] for k in keys]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)][: len(table)]
    row = np.cumsum(new) - 1
    d, n = np.zeros((int(new.sum()), len(states))), np.zeros(int(new.sum()))
    state = table.column(len(keys)).to_numpy()
    at = np.minimum(np.searchsorted(states, state), max(len(states) - 1, 0))
    inside = states[at] == state if len(states) else np.zeros(len(state), bool)
    d[row[inside], at[inside]] = table.column(len(keys) + 1).to_numpy()[inside]
    np.add.at(n, row[inside], 1)
    return table.select(keys).filter(pa.array(new)), d, n


def shared_flips(res: DataFrame, signs: Signs, keys: list[str]) -> DataFrame:
    """keys, a, b: permutations whose |t| reaches the observed one, and whose largest |t| of all rows does, in one job.

    Tasks share out the permutations, each with all rows: the largest statistic of a permutation is known where it
    is drawn. res has at most BROADCAST_CELLS rows.
    """
    spark = res.sparkSession
    names, d, n = _matrix(res, keys, np.array(signs.states))
    shipped = spark.sparkContext.broadcast((d, n, signs))
    kinds = res.select(*keys).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, signs = shipped.value
        n, squares = np.maximum(n, 1), (d * d).sum(axis=1)
        stat = lambda total: np.abs(_t_rounded(n, total, squares))
        t0 = stat(d.sum(axis=1, keepdims=True))
        a, b = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                t = stat(d @ signs.block(i * FLIPS, min((i + 1) * FLIPS, signs.permutations)).T.astype(float))
                a += (t >= t0).sum(axis=1)
                top = np.sort(t.max(axis=0)) if len(t) else np.array([])
                b += len(top) - np.searchsorted(top, t0[:, 0], side="left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d))), pa.array(a), pa.array(b)], ["i", "a", "b"])

    found = spark.range(-(-signs.permutations // FLIPS)).mapInArrow(count, "i long, a long, b long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    listed = spark.createDataFrame(names.append_column("i", pa.array(np.arange(len(d)))), kinds.add("i", "long"))
    return found.join(F.broadcast(listed), "i").drop("i")


def block_flips(res: DataFrame, signs: Signs | DataFrame, keys: list[str]) -> DataFrame:
    """shared_flips() of any number of rows: blocks of rows, then their largest statistics once more."""
    flips = settle(flip_counts(res.withColumn("side", F.lit(0)), signs, keys))
    tops = flips.where("tops IS NOT NULL").select(F.posexplode("tops").alias("i", "top")).groupBy("i").agg(F.max("top").alias("top"))
    # one number a permutation
    shipped = res.sparkSession.sparkContext.broadcast(np.sort(tops.select("top").toArrow().column(0).to_numpy()))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(shipped.value) - np.searchsorted(shipped.value, b.column(len(keys)).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), b.column(len(keys) + 1), pa.array(n.astype(np.int64))], [*keys, "a", "b"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flips.select(*keys).schema)
    return flips.select(*keys, "t0", "hits").mapInArrow(reached, f"{schema}, a long, b long")


def permutation_test(res: DataFrame, signs: Signs | DataFrame, permutations: int, keys: list[str]) -> DataFrame:
    """Two-sided p by shared sign flips, and by the largest |t| of each permutation; ties count as exceedances."""
    small = res.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    hits = shared_flips(res, as_signs(signs), keys) if small else block_flips(res, signs, keys)
    p, q = (F.col("a") + 1) / F.lit(permutations + 1), (F.col("b") + 1) / F.lit(permutations + 1)
    out = paired_t(res, keys).join(hits, keys).withColumn("permutation_p_value", p).withColumn("permutation_max_t_p_value", q).drop("a", "b")
    out = out.withColumn("permutation_bh_q_value", bh(F.col("permutation_p_value"), [F.lit(0)]))
    return out.withColumn("permutation_p_value_mcse", mcse(F.col("permutation_p_value"), permutations)).withColumn("permutation_max_t_p_value_mcse", mcse(F.col("permutation_max_t_p_value"), permutations))


def directional_test(res: DataFrame, hypotheses: DataFrame, signs: Signs | DataFrame, permutations: int, minimum_pairs: int, alpha: float, decisive: bool) -> DataFrame:
    """One-sided sign-flip tests of hypotheses (hypothesis_id, family_order, direction_sign), with Holm's adjustment.

    res: hypothesis_id, geography_code, difference. Hypotheses with too few states get p = 1 and no statistic.
    """
    keys = ["hypothesis_id"]
    agg = res.groupBy("hypothesis_id").agg(F.count("*").cast("double").alias("n"), F.sum("difference").alias("s"), F.sum(F.col("difference") * F.col("difference")).alias("ss"))
    obs = hypotheses.join(agg, "hypothesis_id", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    tested = F.col("n") >= minimum_pairs
    obs = obs.withColumn("t0", F.when(tested, F.round(t_statistic(F.col("n"), F.col("s"), F.col("ss")), 9)))
    sided = res.select(*keys, "geography_code", "difference").join(F.broadcast(hypotheses.select("hypothesis_id", F.col("direction_sign").alias("side"))), "hypothesis_id")
    out = obs.join(flip_counts(sided, signs, keys).select("hypothesis_id", F.col("hits").alias("h")), "hypothesis_id", "left")
    out = out.select(
        "family_order", "hypothesis_id", "direction_sign", F.col("n").cast("long").alias("state_pair_count"), F.try_divide(F.col("s"), F.col("n")).alias("effect_lower_minus_higher"),
        F.col("t0").alias("studentized_statistic"), (F.col("direction_sign") * F.col("t0")).alias("oriented_studentized_statistic"),
        F.when(tested, (F.col("h") + 1) / F.lit(permutations + 1)).otherwise(1.0).alias("one_sided_p_value"), F.when(tested, "tested").otherwise("insufficient_opportunity").alias("test_status"),
    )
    out = out.withColumn("holm_adjusted_p_value", holm(F.col("one_sided_p_value"), [F.lit(0)], F.col("family_order")))
    out = out.withColumn("p_value_mcse", mcse(F.col("one_sided_p_value"), permutations)).withColumn("direction_concordant", F.coalesce(F.col("direction_sign") * F.col("effect_lower_minus_higher") > 0, F.lit(False)))
    rule = (F.col("test_status") == "tested") & F.col("direction_concordant") & (F.col("holm_adjusted_p_value") <= alpha)
    return out.withColumn("meets_statistical_rule", rule).withColumn("decision_eligible", F.lit(decisive)).withColumn("replicated", rule & F.lit(decisive))


def vocabulary(found: DataFrame, words: DataFrame, minimum_fraction: float, minimum_states: int) -> DataFrame:
    """words (motif_id, mask, discovery_support_fraction) with their support in new graphs.

    found: of motifs.evaluability() over the new graphs; words that are evaluable nowhere have no fraction.
    """
    new = found.select("mask", F.col("paired_state_count").alias("replication_paired_state_count"), F.col("support_count").alias("replication_support_count"), F.col("distinct_state_support_count").alias("replication_distinct_state_support_count"))
    out = words.join(new, "mask", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = ["replication_paired_state_count", "replication_support_count", "replication_distinct_state_support_count"]
    out = out.withColumns({c: zero(c) for c in counts})
    out = out.withColumn("replication_support_fraction", ratio(F.col("replication_support_count"), F.when(F.col("replication_paired_state_count") > 0, 2 * F.col("replication_paired_state_count"))))
    again = (F.col("replication_paired_state_count") >= minimum_states) & F.coalesce(F.col("replication_support_fraction") >= minimum_fraction, F.lit(False))
    return out.withColumn("replicated", again).withColumn("support_fraction_difference", F.col("replication_support_fraction") - F.col("discovery_support_fraction"))


def vocabulary_summary(rep: DataFrame, minimum_states: int) -> DataFrame:
    ok = rep.withColumn("x", F.when(F.col("replication_paired_state_count") >= minimum_states, F.col("discovery_support_fraction"))).withColumn("y", F.when(F.col("x").isNotNull(), F.col("replication_support_fraction")))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    ok = ok.withColumn("both", both)
    rank = lambda c: F.when(F.col("both"), average_rank(F.round(F.col(c), 9), ["both"]))
    ok = ok.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    return ok.agg(
        F.count("*").alias("frozen_motif_count"), F.count_if("replicated").alias("replicated_motif_count"), F.avg(F.col("replicated").cast("int")).alias("retention_fraction"),
        F.min("replication_paired_state_count").alias("minimum_state_pair_count"), correlation("rx", "ry").alias("support_spearman_correlation"), F.median(F.abs("support_fraction_difference")).alias("median_absolute_support_difference"),
    )


def family_summary(rep: DataFrame, families: DataFrame) -> DataFrame:
    """families (occurrence_class_id, representative_motif_id) with the results of their motifs and of their representative."""
    agg = rep.groupBy("occurrence_class_id").agg(
        F.count("*").alias("replication_member_count"), F.count_if("replicated").alias("replicated_member_count"), F.min("replication_support_fraction").alias("minimum_replication_support"),
        F.median("replication_support_fraction").alias("median_replication_support"), F.max("replication_support_fraction").alias("maximum_replication_support"),
    )
    own = rep.select(F.col("motif_id").alias("representative_motif_id"), F.col("replication_support_fraction").alias("representative_replication_support_fraction"), F.col("replicated").alias("representative_replicated"))
    return families.join(agg, "occurrence_class_id", "left").join(own, "representative_motif_id", "left")


def fixed_edge_null(graphs: DataFrame, replicates: int, seed: int, conditions: int = 45) -> DataFrame:
    """(replicate, graph columns, mask): as many eligible pairs as the graph has edges, those of the smallest hashes."""
    spark = graphs.sparkSession
    reps = F.broadcast(spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate")))
    base = graphs.crossJoin(reps)
    bit_list = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << i).cast("long").alias("bit")) for i in range(conditions)])
    able = F.filter(bit_list, lambda x: F.col("opportunity").bitwiseAND(x["bit"]) != 0)
    drawn = F.array_sort(F.transform(able, lambda x: F.struct(hashed(seed, F.col("replicate"), F.col("graph_id"), x["i"]).alias("h"), x["i"].alias("i"), x["bit"].alias("bit"))))
    chosen = F.slice(drawn, F.lit(1), bits("mask"))
    return base.withColumn("mask", F.when(bits("mask") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x["bit"]))))


def replicate_support(graphs: DataFrame, motifs: DataFrame, replicates: int) -> DataFrame:
    """(motif_id, replicate, support): graphs (replicate, mask, paired opportunity) that have the motif; zeros stay.

    A replicate's graphs, one a population, are tested as an array against the motifs', a bounded catalog that is
    broadcast; nothing is joined, and a replicate without graphs has zeros.
    """
    spark = graphs.sparkSession
    rows = motifs.select("motif_id", "mask").toArrow().combine_chunks()  # a catalog has at most as many motifs as there are patterns
    shipped = spark.sparkContext.broadcast((rows.column(0).combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows.column(1).to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, masks = shipped.value
        now, support = None, np.zeros(len(masks), np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(masks), now, np.int32)), pa.array(support)], ["motif_id", "replicate", "support"])

        for batch in batches:
            replicate, held = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.r_[True, replicate[1:] != replicate[:-1]][: len(replicate)])
            for first, stop in zip(edges, np.r_[edges[1:], len(replicate)], strict=True):
                if replicate[first] != now:
                    yield from done()
                    now, support = replicate[first], np.zeros(len(masks), np.int64)
                for m in held[first:stop]:
                    support += (masks & m) == masks
        yield from done()

    # every replicate has a row, of a graph that holds nothing
    every = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"), F.lit(0).cast("long").alias("mask"))
    held = graphs.select(F.col("replicate").cast("int"), F.col("mask").bitwiseAND(F.col("paired_opportunity")).alias("mask")).where(F.col("replicate").between(1, replicates))
    sorted_ = held.union(every).repartition("replicate").sortWithinPartitions("replicate")
    return sorted_.mapInArrow(count, "motif_id string, replicate int, support long")


def null_summary(rep: DataFrame, motifs: DataFrame, replicates: int) -> DataFrame:
    """Null mean, deviation, quantiles, z and upper p of each motif's support."""
    df = rep.join(F.broadcast(motifs.select("motif_id", F.col("support_count").alias("observed_support"))), "motif_id")
    agg = df.groupBy("motif_id", "observed_support").agg(
        F.avg("support").alias("null_mean"), F.stddev_samp("support").alias("null_sd"), F.percentile("support", 0.025).alias("null_q025"), F.percentile("support", 0.975).alias("null_q975"), F.count_if(F.col("support") >= F.col("observed_support")).alias("h")
    )
    z = F.when(F.col("null_sd") > 0, F.try_divide(F.col("observed_support") - F.col("null_mean"), F.col("null_sd")))
    return agg.withColumn("density_null_z", z).withColumn("p_value_upper", (F.col("h") + 1) / F.lit(replicates + 1)).drop("h")


def support_stability(rep: DataFrame, motifs: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    names = [f"{round(f * 100):02d}pct" for f in fractions]
    df = rep.join(F.broadcast(motifs.select("motif_id", "node_count", "edge_count", "support_count", *[f"support_count_{n}" for n in names], *[f"support_{n}" for n in names])), "motif_id")
    keys = ["motif_id", "node_count", "edge_count", "support_count", *[f"support_count_{n}" for n in names], *[f"support_{n}" for n in names]]
    return df.groupBy(*keys).agg(
        F.avg("support").alias("bootstrap_support_mean"), F.median("support").alias("bootstrap_support_median"), F.percentile("support", 0.025).alias("bootstrap_support_025"), F.percentile("support", 0.975).alias("bootstrap_support_975"),
        *[F.avg((F.col("support") >= F.col(f"support_count_{n}")).cast("int")).alias(f"p_boot_support_{n}") for n in names],
    )


def vocabulary_stability(rep: DataFrame, motifs: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """How much of each fraction's vocabulary every replicate keeps."""
    names = [(f, f"{round(f * 100):02d}pct") for f in fractions]
    levels = F.explode(F.array(*[F.struct(F.lit(f).alias("support_fraction"), F.col(f"support_count_{n}").alias("limit"), F.col(f"support_{n}").alias("base")) for f, n in names])).alias("l")
    df = rep.join(F.broadcast(motifs.select("motif_id", levels)), "motif_id").withColumn("now", F.col("support") >= F.col("l.limit"))
    agg = df.groupBy("replicate", F.col("l.support_fraction").alias("support_fraction")).agg(
        F.count_if("l.base").alias("baseline_motif_count"), F.count_if("now").alias("replicate_vocabulary_count"), F.count_if(F.col("l.base") & F.col("now")).alias("retained_motif_count")
    )
    union = F.col("baseline_motif_count") + F.col("replicate_vocabulary_count") - F.col("retained_motif_count")
    return agg.withColumn("retention", ratio(F.col("retained_motif_count"), F.col("baseline_motif_count"))).withColumn("jaccard", F.when(union > 0, ratio(F.col("retained_motif_count"), union)).otherwise(1.0))


def discovery_stability(mined: DataFrame, baseline: DataFrame, replicates: int) -> DataFrame:
    """Sets of motifs found again by mining each replicate: kept, new, and their Jaccard with the baseline set."""
    spark = mined.sparkSession
    base = baseline.select("mask").withColumn("base", F.lit(True))
    counts = mined.select("replicate", "mask").join(F.broadcast(base), "mask", "left").groupBy("replicate").agg(F.count("*").alias("found"), F.count_if("base").alias("kept"))
    reps = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    out = reps.join(counts, "replicate", "left").crossJoin(F.broadcast(baseline.agg(F.count("*").alias("baseline_motif_count"))))
    found, kept, n = F.coalesce("found", F.lit(0)), F.coalesce("kept", F.lit(0)), F.col("baseline_motif_count")
    union = n + found - kept
    return out.select("replicate", "baseline_motif_count", found.alias("replicate_discovered_motif_count"), kept.alias("retained_baseline_motif_count"), (found - kept).alias("novel_motif_count"), F.when(n > 0, ratio(kept, n)).otherwise(1.0).alias("discovery_set_retention"), F.when(union > 0, ratio(kept, union)).otherwise(1.0).alias("discovery_set_jaccard"))
