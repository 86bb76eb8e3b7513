"""Stable association edges of every population: a design bootstrap of phi, state by state.

Reads orders, customer and lineitem as a survey (sources/bridge.py), and writes a table of pairs of conditions
partitioned by state_code: phi, eligibility, the mask of replicates that select the pair, its stability, and whether it
is a stable edge. The run takes as long as its replicates do, so it can be stopped and started again: finished states
are found by their keys and not computed again; a rerun of a finished table writes nothing. Tables of different
settings lie in different folders (run=<digest>).

    python -m jobs.stability_bank --tables DIR --output DIR [--config jobs/stability_bank.json]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import r
from affinis.operators import association, population, recode, resample, units
from affinis.operators.tables import settle
from affinis.sources import bridge
from affinis.sources.files import digest
from affinis.sources.settings import read_mapping

log = logging.getLogger("affinis.jobs")
UNIT, KEYS = ["state_code"], resample.KEYS
VALUES = {
    "association": "double", "pair_eligible": "boolean", "exclusion_reason": "string", "p_phi_gt_zero": "double", "p_phi_ge_threshold": "double", "bootstrap_phi_median": "double",
    "bootstrap_phi_025": "double", "bootstrap_phi_975": "double", "bootstrap_replicates_valid": "int", "bootstrap_selection_mask": "string", "bootstrap_status": "string", "edge_present": "boolean",
}
SCHEMA = ", ".join([*[f"{k} string" for k in KEYS], *[f"{k} {t}" for k, t in VALUES.items()], "state_code int"])


def run(spark: SparkSession, tables: str, output: str, config: dict) -> DataFrame:
    """The table at output/run=<digest of config>, whole."""
    unknown = set(config) - {"minimum_effect", "stability", "replicates", "seed", "states_per_write"}
    if unknown or int(config["replicates"]) < 2 or not 0 < config["stability"] <= 1:
        raise ValueError(f"wrong settings: {sorted(unknown) or config}")
    people = settle(recode.respondents(spark, tables))
    limits = bridge.thresholds(spark, tables)
    log.info("read %d respondents of %s, limits %s", people.count(), tables, limits)
    decides = {k: config[k] for k in ("minimum_effect", "stability", "replicates", "seed")}
    path = f"{output.rstrip('/')}/run={digest(decides | {'limits': limits})}"

    found = population.with_graph_id(people).select("state_code", "graph_id").distinct()
    expected = settle(found.crossJoin(F.broadcast(pairs(spark))))  # conditions x conditions, a fixed list

    def build(states: DataFrame) -> DataFrame:
        own = settle(people.join(F.broadcast(states), "state_code", "left_semi"))
        members = population.with_graph_id(own)
        boot = resample.bootstrap_summary(resample.hash_phi(members, own, config["replicates"], config["seed"]), config["minimum_effect"], config["replicates"])
        phi = association.edge_table(members, limits, config["minimum_effect"])
        out = resample.stable(phi, boot, config["minimum_effect"], config["stability"]).join(F.broadcast(found), "graph_id")
        # sums of weights depend on their order in the last bits: rounded, any grouping of states gives the same bytes
        return out.withColumns({c: r(c) for c, t in VALUES.items() if t == "double"})

    table = units.resume(path, expected, UNIT, KEYS, SCHEMA, build, config["states_per_write"])
    log.info("%s holds %d pairs, %d of them stable edges", path, *table.agg(F.count("*"), F.count_if("edge_present")).first())
    return table


def pairs(spark: SparkSession) -> DataFrame:
    c = bridge.CONDITIONS
    return spark.createDataFrame([(a, b) for i, a in enumerate(c) for b in c[i + 1 :]], "source_condition string, target_condition string")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--output", required=True)
    p.add_argument("--config", default="jobs/stability_bank.json")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("stability bank").getOrCreate()
    try:
        run(spark, args.tables, args.output, read_mapping(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
