"""Mixing sources to target weights by hierarchical budgets (operator 8), in DataFrame functions only.

A tree of domains, languages and sources. The budget (`share` of the tokens at hand) goes down the tree
by weight. A child can't take more than its subtree holds, `epochs` times over; what it can't take goes
to its siblings by weight, level by level, so that it reaches another branch only where all siblings are
full. Per parent that is water filling: with children in order of capacity / weight, the first ones are
full and the rest share what is left, found by sums over a window of the (few) children.

A leaf with budget b and t tokens takes each document b div t times, and a prefix of b mod t tokens in the
order of a hash of (seed, epoch, doc_id) once more. A prefix over a leaf of any size comes from sums of
tokens by the hash's leading byte, then by the next byte where the budget ends (256 rows a leaf each), then
over the documents that share both bytes with the end: one in 65,536. No leaf's documents meet in one task.

Weights: `weights` maps 'domain', 'domain/lang' or 'domain/lang/source' to a weight; others weigh 1.
Tokens are words. Defined results: null text has no tokens and is not chosen (0 copies); null lang or source is '';
an empty table gives no rows; rows of one doc_id in one leaf have one place in its order and are taken together or
not at all, in different leaves they are chosen apart; null doc_ids have one place likewise; `mix` returns doc_id
and its own columns, `sample` the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut, only

SEED, SHARE, EPOCHS = 11, 0.5, 2
#: Leaves that may be broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 20_000
#: Weights of the production mixture.
WEIGHTS = {"d0": 3.0, "d1": 2.0, "d0/de": 2.0, "d0/fr": 2.0, "d1/en": 0.5, "d2/en": 3.0, "d0/en/src0": 0.5}
LEVELS = ("domain", "language", "origin")


def domain(source: Column) -> Column:
    """Sources fall into four domains by their MD5, for want of a column that names them."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order(epoch: Column, doc_id: Column, seed: int) -> Column:
    """40 leading bits of md5(seed:epoch:doc_id)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 10), 16, 10).cast("long")


def _lead(n: int) -> Column:
    """The n leading bytes of a document's place in order."""
    return F.shiftrightunsigned("o", 40 - 8 * n)


def _weight(path: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    w = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    return F.coalesce(F.try_element_at(w, path), F.lit(1.0))


def fill(children: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """children (parent..., name, cap, w, budget) with what each gets, as `got`: whole tokens."""
    w = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("cap") / F.col("w"), name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    # children before the first that isn't full are full; that one sets the level of the rest
    level = (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    out = children.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("first_level", first).withColumn("got", F.when(F.col("first_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("first_level") * F.col("w"))))).drop("level", "first_level")


def budgets(leaves: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """leaves (domain, language, origin, tokens) with the budget of each leaf."""
    weights = WEIGHTS if weights is None else weights
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    d = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("t")).withColumn("w", _weight(F.col("domain"), weights))
    d = fill(d.withColumn("budget", F.floor(F.sum("t").over(Window.partitionBy(F.lit(0))) * F.lit(share))), [], "domain", "budget").select("domain", F.col("got").alias("d_got"))
    lang = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.concat_ws("/", "domain", "language"), weights))
    lang = fill(lang.join(d, "domain"), ["domain"], "language", "d_got").select("domain", "language", F.col("got").alias("l_got"))
    leaf = caps.withColumn("w", _weight(F.concat_ws("/", "domain", "language", "origin"), weights)).join(lang, ["domain", "language"])
    return fill(leaf, ["domain", "language"], "origin", "l_got").select(*LEVELS, "tokens", F.col("got").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row of docs doc_id, mix_domain, mix_tokens and mix_copies: how often the mixture takes it."""
    return chosen(docs, weights, share, epochs, seed).select("doc_id", F.col("domain").alias("mix_domain"), F.col("n").alias("mix_tokens"), F.col("copies").alias("mix_copies"))


def chosen(docs: DataFrame, weights: dict[str, float] | None, share: float, epochs: int, seed: int) -> DataFrame:
    """(doc_id, domain, language, origin, n, copies) of each row of docs."""
    src = F.coalesce(F.col("source"), F.lit(""))
    slim = docs.select("doc_id", domain(src).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"), src.alias("origin"), tokens(F.col("text")).alias("n"))
    none, slim = slim.where("n = 0").select("doc_id", *LEVELS, "n", F.lit(0).cast("long").alias("copies")), cut(slim.where("n > 0"))
    plan = budgets(slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), weights, share, epochs)
    plan = plan.withColumn("times", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("times") * F.col("tokens"))
    plan = cut(plan.select(*LEVELS, "times", "rest"))
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)
    ranked = slim.join(hint(plan), list(LEVELS)).withColumn("o", order(F.col("times") + 1, F.col("doc_id"), seed))
    # the budget's end: among the 256 values of the leading byte, then of the next one within it
    ends = None
    for level in range(2):
        rows = ranked.withColumn("before", F.lit(0).cast("long")) if ends is None else ranked.join(hint(ends), list(LEVELS)).where(_lead(level) == F.col("lead"))
        sums = rows.groupBy(*LEVELS, "rest", "before", _lead(level + 1).alias("lead")).agg(F.sum("n").alias("b"))
        upto = F.col("before") + F.sum("b").over(Window.partitionBy(*LEVELS).orderBy("lead"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = over.groupBy(*LEVELS).agg(F.min(F.struct("lead", (F.col("upto") - F.col("b")).alias("before"))).alias("c"))
        ends = cut(first.select(*LEVELS, F.col("c.lead").alias("lead"), F.col("c.before").alias("before")))
    ranked = ranked.join(hint(ends), list(LEVELS)).withColumn("own", _lead(2))
    edge = ranked.where("own = lead").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("o", "doc_id")))
    taken = lambda df, more: df.select("doc_id", *LEVELS, "n", (F.col("times") + F.when(more, 1).otherwise(0)).alias("copies"))
    out = taken(edge, F.col("upto") <= F.col("rest")).union(taken(ranked.where("own <> lead"), F.col("own") < F.col("lead")))
    return out.union(none)


def sample(docs: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The documents of the mixture, each as often as it is taken, in the columns of docs."""
    taken = chosen(only(docs, "doc_id", "text", "lang", "source"), weights, share, epochs, seed).where("copies > 0")
    # a choice is the same for all rows of a doc_id in a leaf that have a token
    taken = taken.groupBy(F.col("doc_id").alias("mix_id"), F.col("language").alias("mix_lang"), F.col("origin").alias("mix_source")).agg(F.max("copies").cast("int").alias("mix_copies"))
    # the caller's columns by place, so that no name of theirs clashes
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    col = lambda name: F.col(f"in_{docs.columns.index(name)}")
    leaf = (F.coalesce(col("lang"), F.lit("")) == F.col("mix_lang")) & (F.coalesce(col("source"), F.lit("")) == F.col("mix_source"))
    joined = own.where(col("text").rlike(r"[^\x20\x09-\x0D]")).join(taken, col("doc_id").eqNullSafe(F.col("mix_id")) & leaf)
    if epochs > 1:
        joined = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return joined.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
