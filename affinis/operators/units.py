"""Long runs by units of work: one partitioned table, a unit's rows in a partition of its own.

A run that was stopped goes on where it was: units whose partition holds exactly the keys asked for are left
alone, those that are missing, cut short or of other keys are made (again). Units are written in groups, each group
in one write that replaces its units' partitions and no other, so a failed write leaves the groups before it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger("affinis")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table so far; empty where nothing was written."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def unfinished(done: DataFrame, expected: DataFrame, unit: list[str], keys: list[str]) -> DataFrame:
    """Units of `expected` (unit and key columns, distinct) whose rows in `done` aren't exactly their keys, once each."""
    # keys are counted before they meet, so a key written twice shows
    have = done.groupBy(*unit, *keys).agg(F.count("*").alias("n"))
    joined = expected.withColumn("asked", F.lit(True)).join(have, [*unit, *keys], "full")
    whole = F.bool_and(F.coalesce((F.col("n") == 1) & F.col("asked"), F.lit(False)))
    units = joined.groupBy(*unit).agg(whole.alias("whole"), F.max("asked").alias("asked"))
    return units.where("asked AND NOT whole").select(*unit)


def resume(path: str, expected: DataFrame, unit: list[str], keys: list[str], schema: StructType | str, build: Callable[[DataFrame], DataFrame], group: int = 8) -> DataFrame:
    """The whole table at `path`; build(units) returns the rows of a few units (a small DataFrame of `unit` columns).

    expected: the unit and key columns of every row the table shall have; units are values of a dimension (states,
    chunks of replicates), whose list fits the driver. Columns of `unit` come last in schema, as partitions do.
    """
    spark = expected.sparkSession
    todo = sorted(unfinished(read(spark, path, schema), expected, unit, keys).collect(), key=tuple)
    log.info("%s: %d of %d units to make", path, len(todo), expected.select(*unit).distinct().count())
    names = [f.name for f in read(spark, path, schema).schema]
    kinds = expected.select(*unit).schema
    for i in range(0, len(todo), group):
        own = spark.createDataFrame(todo[i : i + group], kinds)
        rows = build(own).join(F.broadcast(own), unit, "left_semi").select(*names)  # a unit not asked for is not written
        rows = rows.repartition(*unit).sortWithinPartitions(*unit, *keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(path)
        log.info("%s: wrote units %s", path, [tuple(u) for u in todo[i : i + group]])
    table = read(spark, path, schema)
    if wrong := unfinished(table, expected, unit, keys).limit(5).collect():
        raise ValueError(f"units without all of their rows: {[tuple(u) for u in wrong]}")
    return table.join(expected.select(*unit).distinct(), unit, "left_semi").select(*names)
