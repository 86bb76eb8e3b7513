"""Archived results: checksums before anything is read, keyed tables, and tables written piece by piece."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.sources.files import digest

CHECKSUMS = "SHA256SUMS"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, path relative to it. A file is one row of at most 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return files.select(F.substring("path", len(top) + 2, 1 << 20).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, expected, sha256) of the files whose checksum in SHA256SUMS is wrong, or that are missing (sha256 null)."""
    lines = spark.read.text(f"{folder.rstrip('/')}/{CHECKSUMS}").where("value <> ''")
    parts = F.split("value", "  ", 2)
    sums = lines.select(F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).alias("expected"))
    found = sums.join(provenance(spark, folder).select("path", "sha256"), "path", "left")
    return found.where("sha256 IS NULL OR sha256 <> expected")


def load_archive(spark: SparkSession, folder: str, config_digest: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of an archive by file name, once its checksums hold and its manifest names the configuration."""
    from affinis.sources.files import read_csv

    wrong = checksum_violations(spark, folder).orderBy("path").first()
    if wrong:
        raise ValueError(f"checksum mismatch: {wrong.path}")
    manifest = json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest.json", wholetext=True).first()[0])
    if manifest["config_digest"] != config_digest:
        raise ValueError("the archive is of another configuration")
    return {name: read_csv(spark, f"{folder.rstrip('/')}/{name}", schema) for name, schema in schemas.items()}


def cached(spark: SparkSession, root: str, name: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key (settings, data, code: whatever it depends on): read where it was written whole, else built and written."""
    path = f"{root.rstrip('/')}/{name}/key={digest(key)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)  # the commit's marker comes last
    return spark.read.parquet(path)


def resolved(spark: SparkSession, archives: list[str], root: str, name: str, key: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """(table, where it came from): of the first archive that holds it whole, else this run's own cache, else built and cached.

    archives: folders of frozen runs, in order of preference; a table is whole where its _SUCCESS is.
    """
    for folder in archives:
        path = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path), path
    own = f"{root.rstrip('/')}/{name}/key={digest(key)}"
    origin = own if _exists(spark, f"{own}/_SUCCESS") else "built"
    return cached(spark, root, name, key, build), origin


def resumed(spark: SparkSession, root: str, name: str, key: dict, column: str, values: list, build: Callable[[list], DataFrame], group: int = 8) -> DataFrame:
    """A table written by groups of a column's values (states, say): a run that failed goes on after the last group it finished.

    build(values) returns the rows of these values, whose column must hold no other.
    """
    top = f"{root.rstrip('/')}/{name}/key={digest(key)}"
    values = sorted(values)
    parts = []
    for i in range(0, len(values), group):
        own = values[i : i + group]
        path = f"{top}/part={digest({column: own})}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            rows = build(own)
            known = F.col(column).isin(own)
            broken = F.raise_error(F.lit(f"{column} has a value that was not asked for")).cast("boolean")
            rows.where(F.coalesce(known, F.lit(False)) | broken).write.mode("overwrite").parquet(path)
        parts.append(path)
    return spark.read.parquet(*parts)
