"""Settling small intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the checkpoint folder that all executors see."""
    return f"{_top(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _top(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return path or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregated table to the shared checkpoint folder: read many times, computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_top(df.sparkSession))
    return df.checkpoint()
