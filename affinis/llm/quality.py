"""Quality rules with cross-document line frequency (operator 9), in DataFrame functions only.

Base counts are taken per document from its word and line arrays. The cross-document rule hashes
normalised lines (lower case, white space runs as one space), counts each host's distinct documents
per line, calls a line boilerplate where that count is above both `min_docs` and `share` of the host's
documents, and rejects documents of which less than `keep_share` of the words stay once such lines go.

A document is a doc_id; a row without one is a document of its own. Rows per line, at least as many as
documents, are counted first (on the map side, so a hot host or line reaches a reducer as one row a task); only
lines that pass both limits by rows are then counted by distinct documents.

With `by_class` (the pipeline) a line counts once per sketch of its host's texts, the smallest hash of a text's
3-word windows, and a host's size is its number of distinct texts. Copies have one sketch; near copies have that
of the original unless an edit makes a smaller window (about 3 in 100 where one word in 100 differs). So copies
of one document don't make its own lines boilerplate, and near-duplicate removal finds them and keeps one.
Without it (op9) a group of copies above both limits, each with its own doc_id, is rejected whole.

A host has at most (mean lines of a document) / share boilerplate lines, whatever the corpus size, as
each takes up more than `share` of its documents. The lists of all hosts are broadcast only while they hold at
most `broadcast_lines` hashes in at most `broadcast_hosts` hosts (both counted); beyond that hosts are joined by
shuffle, and AQE may split the documents of a hot one.

Defined results: null text is a text without words (base_failed, not kept); null source is the host '';
an empty table gives an empty result; repeated rows are judged one by one, and count once for a line; columns of
the caller pass, but for those named like a result (METRICS and RESULTS), which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut, let, words

SYMBOLS = r"[#*$%&|<>]"
DEFAULTS = {"min_words": 50, "repeat_percent": 50, "min_docs": 20, "share": 0.10, "keep_share": 0.5, "broadcast_hosts": 20_000, "broadcast_lines": 1_000_000, "by_class": False}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = ["base_failed", "kept_words", "kept", "clean_text"]


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hashes(text: Column) -> Column:
    """One hash per line, null for lines without a word."""
    norm = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normal_line)
    return F.transform(norm, lambda x: F.when(x != "", F.xxhash64(x)))


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text; ws is an attribute or a lambda's variable."""
    n = F.size(ws)
    tri = F.transform(F.slice(ws, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_covered(t)))


def _covered(tri: Column) -> Column:
    """Words covered by the windows whose hash occurs again: in sorted order such windows have an equal neighbour."""
    placed = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))))
    spots = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        spots,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def sketch(text: Column) -> Column:
    """The smallest hash of a text's 3-word windows; of a shorter text its own hash."""
    tri = lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.coalesce(F.array_min(let(words(text), tri)), F.xxhash64(F.coalesce(text, F.lit(""))))


def boilerplate(docs: DataFrame, host: str, min_docs: int, share: float, by_class: bool = False, broadcast_lines: int = DEFAULTS["broadcast_lines"]) -> DataFrame:
    """(host, lines): hashes of the lines that more than min_docs and more than share of the host's documents have."""
    if by_class:
        own = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.struct(sketch(F.col("text"))).alias("doc")]
    else:
        row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        own = [F.struct(F.col("doc_id"), row).alias("key"), F.struct(F.col("doc_id"), row).alias("doc")]
    # cut: read by three jobs, and a row's own number must not change between them
    lines = cut(docs.select(F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), *own, F.array_distinct(F.array_compact(line_hashes(F.col("text")))).alias("hs")))
    size = lines.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    over = lambda seen: seen.where(F.col("n") > min_docs).join(size, "host").where(F.col("n") > F.col("n_docs") * F.lit(share)).select("host", "line")
    by_rows = cut(over(lines.select("host", F.explode("hs").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))))
    # few as a rule, and broadcast then: the holders of a common line do not meet in one task
    few = by_rows.limit(broadcast_lines + 1).count() <= broadcast_lines
    by_docs = lines.select("host", "doc", F.explode("hs").alias("line")).join(F.broadcast(by_rows) if few else by_rows, ["host", "line"], "left_semi").distinct()
    return over(by_docs.groupBy("host", "line").agg(F.count("*").alias("n"))).groupBy("host").agg(F.collect_list("line").alias("lines"))


def assess(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """docs with the base counts, base_failed, kept_words, kept and clean_text (the text without boilerplate lines)."""
    o = DEFAULTS | options
    lists = cut(boilerplate(docs, host, o["min_docs"], o["share"], o["by_class"], o["broadcast_lines"]))
    size = lists.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines")).first()
    few = size["hosts"] <= o["broadcast_hosts"] and size["lines"] <= o["broadcast_lines"]
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    # each intermediate array is a column of its own projection: computed once, then read by several counts
    df = docs.select(*own, text.alias("t"), F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"))
    df = df.join(F.broadcast(lists) if few else lists, "host", "left")
    full = lambda ls: F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(F.col("t")),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    df = df.select(
        *[f"in_{i}" for i in range(len(docs.columns))],
        counts.alias("counts"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(full(F.split("t", "\n", -1)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.col("lines").isNull(), F.col("t")).otherwise(
            F.array_join(F.filter(F.split("t", "\n", -1), lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(normal_line(x))) | (normal_line(x) == "")), "\n")
        ).alias("clean_text"),
        F.col("lines").isNotNull().alias("listed"),
    )
    df = df.select("*", "counts.*")
    bad = (F.col("n_words") < o["min_words"]) | (100 * F.col("n_repeat_words") > o["repeat_percent"] * F.col("n_words"))
    left = F.when(F.col("listed"), F.size(words(F.col("clean_text")))).otherwise(F.col("n_words")).cast("long")
    df = df.withColumn("base_failed", bad).withColumn("kept_words", left)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= F.col("n_words") * F.lit(o["keep_share"])))
    return df.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in (*METRICS, *RESULTS)], *METRICS, *RESULTS)


def filter_documents(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The documents that stay, without their boilerplate lines, in the columns of docs."""
    out = assess(docs, host, **options).where("kept")
    return out.select(*[F.col("clean_text").alias("text") if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
