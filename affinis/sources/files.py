"""Readers and writers beside Spark's own: typed CSV, survey transport files, graph files, reports."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.operators.graphs import mask_edges
from affinis.sources.bridge import CONDITIONS


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a schema of its own, plain or gzip; empty, NA and <NA> are missing."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.select(*[F.when(~F.col(c).isin("NA", "<NA>"), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, compress: bool = False, order: list[Column | str] | None = None, single: bool = False) -> None:
    """CSV parts with a header, missing values empty; Spark's commit makes the folder appear whole.

    With `order` rows are sorted over the parts, in the order of their names; with `single` there is one part (for
    reports: one task writes it). Spark's gzip has no time stamp, so equal rows in order make equal bytes.
    """
    if single:
        df = df.coalesce(1).sortWithinPartitions(*order) if order else df.coalesce(1)
    elif order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("compression", "gzip" if compress else "none").csv(path)


def json_safe(value):
    """NaN and infinities to null, rows to dicts: what strict JSON can hold."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def report_json(df: DataFrame) -> str:
    """A one-row report as JSON with sorted keys."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json_safe(rows[0]), sort_keys=True, indent=2, allow_nan=False, default=str)


def write_text(df: DataFrame, path: str, column: str, compress: bool = False) -> None:
    df.select(column).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def digest(payload: dict) -> str:
    """First 12 hex digits of SHA-256 over compact JSON with sorted keys: names a configuration's outputs."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


# --- graphs ----------------------------------------------------------------------------------------------


def node_link(graphs: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_id, json): nodes and links of each graph (graph_id, mask)."""
    edges = mask_edges(graphs, "mask", conditions).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target")))).alias("links"))
    nodes = F.array(*[F.struct(F.lit(c).alias("id")) for c in sorted(conditions)])
    df = graphs.select("graph_id").join(edges, "graph_id", "left")
    links = F.coalesce("links", F.array().cast("array<struct<source:string,target:string>>"))
    return df.select("graph_id", F.to_json(F.struct(F.lit(False).alias("directed"), nodes.alias("nodes"), links.alias("links"))).alias("json"))


def graphml(graphs: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(graph_id, xml): GraphML of each graph (graph_id, mask)."""
    edges = mask_edges(graphs, "mask", conditions).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.concat(F.lit('<edge source="'), F.col("a"), F.lit('" target="'), F.col("b"), F.lit('"/>')))).alias("e"))
    nodes = "".join(f'<node id="{escape(c)}"/>' for c in sorted(conditions))
    df = graphs.select("graph_id").join(edges, "graph_id", "left")
    head: Column = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph id="'), F.col("graph_id"), F.lit(f'" edgedefault="undirected">{nodes}'))
    return df.select("graph_id", F.concat(head, F.coalesce(F.array_join("e", ""), F.lit("")), F.lit("</graph></graphml>")).alias("xml"))


#: Attributes of nodes and edges in graph files; those of the last list are left out where they are null.
NODE_ATTRIBUTES = ["prevalence", "n_valid", "n_cases"]
EDGE_ATTRIBUTES = ["association", "estimator", "n_complete", "cooccurring_cases"]
OPTIONAL_ATTRIBUTES = [
    "odds_ratio", "reverse_odds_ratio", "confidence_low", "confidence_high", "q_value", "positive_stability", "stability_wilson_low", "stability_wilson_high", "p_phi_gt_zero", "p_phi_ge_012",
    "bootstrap_phi_median", "bootstrap_phi_025", "bootstrap_phi_975", "selection_stability_wilson_low", "selection_stability_wilson_high",
]


def attributed(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, graph, nodes, links): each graph's attributes, its nodes and its present edges between them, as structs.

    graphs: graph_id and attributes; nodes: graph_id, condition, NODE_ATTRIBUTES; edges: graph_id, pair, edge_present,
    EDGE_ATTRIBUTES and any of OPTIONAL_ATTRIBUTES. Graphs without nodes or edges have empty lists.
    """
    label = F.initcap(F.replace("condition", F.lit("_"), F.lit(" ")))
    node = F.struct(F.col("condition").alias("id"), label.alias("label"), *NODE_ATTRIBUTES)
    listed = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    e = edges.where("edge_present")
    for side in ("source_condition", "target_condition"):
        e = e.join(nodes.select("graph_id", F.col("condition").alias(side)), ["graph_id", side], "left_semi")
    more = [F.col(c).cast("double").alias(c) for c in OPTIONAL_ATTRIBUTES if c in edges.columns]
    link = F.struct(F.col("source_condition").alias("source"), F.col("target_condition").alias("target"), *EDGE_ATTRIBUTES, *more)
    linked = e.groupBy("graph_id").agg(F.sort_array(F.collect_list(link)).alias("links"))
    own = graphs.select("graph_id", F.struct(*[F.col(c) for c in graphs.columns]).alias("graph"))
    out = own.join(listed, "graph_id", "left").join(linked, "graph_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select("graph_id", "graph", empty("nodes").alias("nodes"), empty("links").alias("links"))


def attributed_json(graphs: DataFrame) -> DataFrame:
    """(graph_id, json) of attributed() graphs as node-link JSON; null attributes are left out."""
    body = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "graph", "nodes", F.col("links").alias("edges"))
    return graphs.select("graph_id", F.to_json(body).alias("json"))


def attributed_graphml(graphs: DataFrame) -> DataFrame:
    """(graph_id, xml) of attributed() graphs as GraphML with typed keys; null attributes are left out."""
    kinds = {"string": "string", "double": "double", "float": "double", "boolean": "boolean"}
    fields = {"graph": graphs.schema["graph"].dataType.fields, "node": graphs.schema["nodes"].dataType.elementType.fields, "edge": graphs.schema["links"].dataType.elementType.fields}
    named = {part: [f for f in fs if f.name not in ("id", "source", "target")] for part, fs in fields.items()}
    keys = "".join(f'<key id="{part}_{f.name}" for="{part}" attr.name="{f.name}" attr.type="{kinds.get(f.dataType.simpleString(), "long")}"/>' for part, fs in named.items() for f in fs)

    def text(c: Column) -> Column:
        out = c.cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    def data(part: str, x: Column) -> Column:
        return F.concat(*[F.when(x[f.name].isNotNull(), F.concat(F.lit(f'<data key="{part}_{f.name}">'), text(x[f.name]), F.lit("</data>"))).otherwise("") for f in named[part]])

    node = lambda x: F.concat(F.lit('<node id="'), text(x["id"]), F.lit('">'), data("node", x), F.lit("</node>"))
    edge = lambda x: F.concat(F.lit('<edge source="'), text(x["source"]), F.lit('" target="'), text(x["target"]), F.lit('">'), data("edge", x), F.lit("</edge>"))
    head = F.lit(f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">')
    body = F.concat(data("graph", F.col("graph")), F.array_join(F.transform("nodes", node), ""), F.array_join(F.transform("links", edge), ""))
    return graphs.select("graph_id", F.concat(head, body, F.lit("</graph></graphml>")).alias("xml"))


def write_graph_files(graphs: DataFrame, path: str, column: str, names: str = "graph_id") -> None:
    """One text file a graph: path/<names>=<id>/part-... of `column`, written by Spark's own commit.

    A graph is one row; rows of one id are an error. Graphs written before are replaced, others stay. A task that
    fails or runs twice leaves nothing behind, as files move to their folder when the job commits.
    """
    n = F.count("*").over(Window.partitionBy(names))
    once = F.when(n > 1, F.raise_error(F.concat(F.lit("two graphs of one id: "), F.col(names))).cast("string")).otherwise(F.col(column))
    graphs.select(names, once.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(names).text(path)


def read_graph_files(spark: SparkSession, path: str, names: str = "graph_id") -> DataFrame:
    """(graph id, text) of write_graph_files()."""
    return spark.read.option("wholetext", True).text(path).select(F.col(names).cast("string").alias(names), F.rtrim("value", F.lit("\n")).alias("value"))


# --- survey transport files (SAS XPORT, version 5) ---------------------------------------------------------


def ibm_double(raw: bytes) -> float | None:
    """An IBM hexadecimal float, shortened or not; None for the missing codes (a letter, _ or . and zeros)."""
    raw = raw.ljust(8, b"\0")
    if raw[0] in b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not any(raw[1:]):
        return None
    mantissa = int.from_bytes(raw[1:8], "big")
    return (-1.0 if raw[0] & 128 else 1.0) * math.ldexp(mantissa, 4 * ((raw[0] & 127) - 64) - 56)


class Transport:
    """Layout of one member of a transport file, from its header records."""

    def __init__(self, head: bytes):
        at = head.index(b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!")
        n = int(head[at + 54 : at + 58])
        size = int(head[head.index(b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!") + 74 :][:4])
        start = at + 80
        self.variables = []
        for i in range(n):
            d = head[start + i * size : start + (i + 1) * size]
            kind, _, width, number = struct.unpack(">hhhh", d[:8])
            self.variables.append({"position": number, "variable": d[8:16].decode("latin-1").strip(), "label": d[16:56].decode("latin-1").strip(), "numeric": kind == 1, "width": width, "offset": struct.unpack(">i", d[84:88])[0]})
        end = start + -(-n * size // 80) * 80
        self.first = end + 80  # after the observation header
        self.width = sum(v["width"] for v in self.variables)

    def rows(self, data: bytes, names: list[str]) -> Iterator[tuple]:
        chosen = [v for n in names for v in self.variables if v["variable"] == n]
        for at in range(0, len(data) - self.width + 1, self.width):
            row = data[at : at + self.width]
            if not row.strip(b" "):
                continue  # padding of the last record
            yield tuple(ibm_double(row[v["offset"] : v["offset"] + v["width"]]) if v["numeric"] else row[v["offset"] : v["offset"] + v["width"]].decode("latin-1").rstrip() or None for v in chosen)


#: A transport file is a whole number of cards of 80 bytes; Spark reads up to MOST_CARDS of them as one record.
CARD, MOST_CARDS = 80, 800


def _record_bytes(spark: SparkSession, path: str) -> int:
    """The largest whole number of cards, MOST_CARDS at most, that divides the file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size % CARD:
        raise ValueError(f"not a transport file: {size} bytes are no whole number of cards")
    return CARD * next(d for d in range(MOST_CARDS, 0, -1) if size // CARD % d == 0)


def _header(records, size: int, most: int = 1 << 23) -> Transport:
    """The layout in the file's leading bytes, read in growing pieces until the observations begin."""
    n = max(1, (1 << 16) // size)
    while True:
        head = b"".join(records.take(n))
        if b"HEADER RECORD*******OBS " in head or len(head) < n * size or len(head) >= most:
            return Transport(head)
        n *= 4


def read_transport(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A transport file, chosen columns only, read through Spark from wherever the file lies.

    Spark splits the file into records of whole cards; an observation belongs to the split where it begins. Of each
    split the length and the first bytes, one observation's, go through the driver, so that every task knows where
    its observations begin and how its last one ends. Convert to Parquet once.
    """
    size = _record_bytes(spark, path)
    records = spark.sparkContext.binaryRecords(path, size)
    layout = _header(records, size)
    names = list(dict.fromkeys(names or [v["variable"] for v in layout.variables]))
    unknown = set(names) - {v["variable"] for v in layout.variables}
    if unknown:
        raise KeyError(f"no such variables: {sorted(unknown)}")
    numeric = {v["variable"]: v["numeric"] for v in layout.variables}
    schema = ", ".join(f"`{n}` {'double' if numeric[n] else 'string'}" for n in names)
    width = layout.width
    splits = sorted(records.mapPartitionsWithIndex(lambda i, rows: [_beginning(i, rows, width)]).collect())
    start, after, at = {}, {}, 0
    for i, n, _ in splits:
        start[i], at = at, at + n
    rest = b""
    for i, _, head in reversed(splits):
        after[i], rest = rest, (head + rest)[:width]
    shipped = spark.sparkContext.broadcast((start, after))

    def rows(i: int, found: Iterator[bytes]) -> Iterator[tuple]:
        base = shipped.value[0][i]  # the file's byte that the buffer begins with
        begin = layout.first + max(0, -(-(base - layout.first) // width)) * width  # of the next observation
        buffer = b""
        for record in found:
            buffer += record
            n = max(0, base + len(buffer) - begin) // width
            if n:
                yield from layout.rows(buffer[begin - base : begin - base + n * width], names)
                begin += n * width
            keep = min(begin - base, len(buffer))
            base, buffer = base + keep, buffer[keep:]
        if buffer:  # an observation that ends in a later split
            yield from layout.rows((buffer + shipped.value[1][i])[:width], names)

    return spark.createDataFrame(records.mapPartitionsWithIndex(rows), schema)


def _beginning(i: int, rows: Iterator[bytes], width: int) -> tuple[int, int, bytes]:
    """(split, its bytes, the first of them)."""
    n, head = 0, b""
    for record in rows:
        n += len(record)
        if len(head) < width:
            head += record
    return i, n, head[:width]
