"""The audit of a growing table: sizes, missing values, categories, prevalences and candidate conditions.

Files of the input folder are taken as a stream, each once: what a run took is in its checkpoint, and the next run takes
only files that came since. A batch's sums are written as a partition of output/profiles (streaming/audit.py); when all
that is new has been taken, the reports are made from the sums of all batches, not from the rows, and written to
output/audit, partitioned by report. The settings say which columns are state, category and weight, and give each
condition as an SQL test of a row (null where it can't be told). Sums and marks belong to settings: others begin with
sums and a mark of their own.

    python -m jobs.incremental_audit --input DIR --output DIR --checkpoint DIR [--config jobs/incremental_audit.json]
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import units
from affinis.sources.files import digest
from affinis.sources.settings import read_mapping
from affinis.streaming import audit

log = logging.getLogger("affinis.jobs")
NEEDED = {"format", "files_per_batch", "state", "category", "weight", "conditions", "items", "least_prevalence", "most_missing"}


def survey(rows: DataFrame, config: dict) -> DataFrame:
    """Rows as respondents: state, category, weight, one column (1, 0, null) a condition, and the audited variables."""
    tests = [F.expr(test).cast("int").alias(name) for name, test in config["conditions"].items()]
    own = {"state_code": config["state"], "ses_category": config["category"], "survey_weight": config["weight"]}
    clash = (set(own) | set(config["conditions"])) & set(config["items"])
    if clash:
        raise ValueError(f"variables with names of conditions: {sorted(clash)}")
    return rows.select(*[F.col(f"`{c}`").alias(k) for k, c in own.items()], *tests, *[F.col(f"`{c}`") for c in config["items"]])


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new in `source` (a folder, or a pattern of files), bring the reports up to date, and return them."""
    if missing := NEEDED - set(config):
        raise ValueError(f"settings lack {sorted(missing)}")
    output, mark = output.rstrip("/"), digest({k: config[k] for k in sorted(NEEDED - {"files_per_batch"})})
    profiles = f"{output}/profiles/settings={mark}"
    schema = spark.read.format(config["format"]).load(source).schema
    files = spark.readStream.format(config["format"]).schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).load(source)
    conditions, items = list(config["conditions"]), list(config["items"])
    add = audit.adder(conditions, items, profiles, lambda rows: survey(rows, config))
    query = files.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{mark}").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p for p in map(_progress, query.recentProgress) if p.get("numInputRows")]
    log.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in taken), source, len(taken))

    found = audit.reports(audit.total(spark, profiles), conditions, items, config["least_prevalence"], config["most_missing"])
    found = found.repartition("report").sortWithinPartitions("report", "geography_code", "item")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report").parquet(f"{output}/audit")
    out = units.read(spark, f"{output}/audit", audit.REPORTS).select(*audit.REPORT)
    log.info("wrote %d rows of reports to %s/audit", out.count(), output)
    return out


def _progress(p) -> dict:
    return json.loads(p.json) if hasattr(p, "json") else p


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default="jobs/incremental_audit.json")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("incremental audit").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, read_mapping(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
