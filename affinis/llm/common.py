"""What the training-data operators share: tables, checkpoints and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where that is unset, a temporary one on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return _test_dir()


def _test_dir(kept: list[str] = []) -> str:  # noqa: B006  one folder for the process
    if not kept:
        kept.append(f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return kept[0]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder; a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no other: extra columns of the caller can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: as a lambda's variable it can't be inlined into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
