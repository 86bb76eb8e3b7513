"""Settings of an analysis: mappings from YAML or JSON, their checks, digest and output paths.

A configuration is three mappings: `analysis` (year, socioeconomic definitions, states, outputs), `conditions`
(the registry of conditions and their codings) and `graph` (estimator, rules, replicates, mining).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from affinis.sources.files import digest

VERSION = "0.3.0"

try:
    import yaml
except ModuleNotFoundError:  # JSON settings need nothing beyond Python
    yaml = None


def read_mapping(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file that holds a mapping, read through Spark, so from wherever tables may lie."""
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    if path.endswith(".json"):
        value = json.loads(text)
    elif yaml is None:
        raise ModuleNotFoundError("YAML settings need PyYAML; JSON ones do not")
    else:
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping: {path}")
    return value


@dataclass(frozen=True)
class Settings:
    analysis: dict
    conditions: dict
    graph: dict

    @property
    def year(self) -> int:
        return int(self.analysis["data"]["year"])

    @property
    def digest(self) -> str:
        return digest({"analysis": self.analysis, "conditions": self.conditions, "graph": self.graph})

    def output_path(self, phase: str) -> str:
        """Outputs of one configuration lie apart from those of any other."""
        return f"{self.analysis['outputs']['root'].rstrip('/')}/{phase}/year={self.year}/run={self.digest}"

    def interim_path(self) -> str:
        return f"{self.analysis['outputs']['interim'].rstrip('/')}/year={self.year}/run={self.digest}"

    def manifest(self, phase: str, **extra) -> dict:
        """What a run's outputs came from."""
        own = {
            "phase": phase, "dataset_year": self.year, "condition_registry_version": self.conditions.get("registry_version"),
            "population_definition": f"state × {self.analysis['socioeconomic']['active_definition']}",
            "edge_estimator": self.graph["estimator"]["name"], "edge_threshold": self.graph.get("edge_criteria", {}).get("minimum_effect"),
            "multiple_testing_rule": self._testing_rule(), "minimum_graph_sample_size": self.analysis["prototype"].get("minimum_population_n"),
            "gspan_support": self._support(), "software_version": VERSION, "random_seed": self.analysis.get("random_seed"),
            "config_digest": self.digest, "timestamp_utc": datetime.now(UTC).isoformat(),
        }
        return own | extra

    def _testing_rule(self) -> str:
        edges = self.graph.get("edge_criteria", {})
        return f"BH FDR q <= {edges['maximum_q_value']}" if edges.get("require_fdr") else "none: edges by effect size alone"

    def _support(self) -> list[float] | None:
        """The support fractions of the part that mines, if one does."""
        return next((p["mining"]["support_fractions"] for p in self.graph.values() if isinstance(p, dict) and "mining" in p), None)


def load(spark: SparkSession, analysis: str, conditions: str, graph: str, year: int | None = None) -> Settings:
    """Settings from three files, for the year given in place of the file's; raises on the first thing that is wrong."""
    found = Settings(*(read_mapping(spark, p) for p in (analysis, conditions, graph)))
    if year is not None:
        found.analysis["data"]["year"] = year
    for wrong in violations(found):
        raise ValueError(wrong)
    return found


def violations(s: Settings) -> Iterator[str]:
    """What is wrong with the settings, one sentence each."""
    yield from _ses(s)
    yield from _conditions(s)
    if not s.analysis["prototype"]["states"]:
        yield "no state is given"
    for name, part in s.graph.items():
        if isinstance(part, dict):
            yield from _rules(name, part)
    yield from _across(s)
    yield from frozen_violations(s)


#: What the settings of each frozen analysis must say, by its estimator.
FROZEN = {
    "phase26_phi_stability": {
        "graph.phase26.thresholds.*.minimum_effect": [0.10, 0.12, 0.14],
        "graph.phase26.bootstrap.type": "bootstrap",
        "graph.phase26.bootstrap.mse": True,
    },
    "phase3_gspan": {
        "graph.phase3.graph_definition.point_phi_threshold": 0.12,
        "graph.phase3.graph_definition.bootstrap_selection_threshold": 0.12,
        "graph.phase3.graph_definition.minimum_selection_stability": 0.90,
        "graph.phase3.mining.support_fractions": [0.10, 0.20, 0.30],
        "graph.phase3.mining.minimum_nodes": 3,
        "graph.phase3.mining.maximum_nodes": 5,
        "graph.phase3.mining.minimum_paired_states": 40,
        "graph.phase3.mining.connected": True,
        "graph.phase3.mining.induced": False,
        "graph.phase3.mining.undirected": True,
        "graph.phase3.bootstrap.replicates": 500,
        "graph.phase3.bootstrap.threshold": 0.12,
        "graph.phase3.bootstrap.discovery_reruns": True,
        "graph.phase3.bootstrap.raw_threshold_sensitivity_reruns": True,
        "graph.phase3.bootstrap.bank_role": "independent_evaluation",
        "graph.phase3.bootstrap.reporting_cutpoints_role": "descriptive_only",
    },
    "phase4_confirmatory_replication": {
        "analysis.data.year": 2023,
        "analysis.socioeconomic.active_definition": "education_binary",
        "graph.phase4.primary_ses_definition": "education_binary",
        "graph.phase4.point_phi_threshold": 0.12,
        "graph.phase4.bootstrap_selection_threshold": 0.12,
        "graph.phase4.minimum_bootstrap_selection_probability": 0.90,
        "graph.phase4.bootstrap.type": "bootstrap",
        "graph.phase4.bootstrap.mse": True,
        "graph.phase4.bootstrap.replicates": 500,
        "graph.phase4.bootstrap.seed": 20230902,
        "graph.phase4.bootstrap.require_all_replicates_valid": True,
        "graph.phase4.motif_discovery.rerun_gspan": False,
        "graph.phase4.motif_discovery.permit_new_motifs": False,
        "graph.phase4.methodological_replication.pooled_support_minimum": 0.20,
        "graph.phase4.methodological_replication.minimum_paired_states": 40,
        "graph.phase4.methodological_replication.frozen_motif_count": 484,
        "graph.phase4.confirmatory_replication.hypothesis_count": 3,
        "graph.phase4.confirmatory_replication.permutations": 99999,
        "graph.phase4.confirmatory_replication.seed": 20230904,
        "graph.phase4.confirmatory_replication.alternative": "one_sided_frozen_direction",
        "graph.phase4.confirmatory_replication.multiplicity": "holm",
        "graph.phase4.confirmatory_replication.alpha": 0.05,
        "graph.phase4.confirmatory_replication.primary_decisions_only": True,
    },
}
#: Estimators there are, and the parts of `analysis` that each needs.
ESTIMATORS = {"weighted_phi": [], "phase25_scenarios": ["phase25"], "phase26_phi_stability": ["phase25"], "phase3_gspan": ["phase25"], "phase4_confirmatory_replication": ["phase4"]}


def at(mapping: dict, path: str):
    """The value at a dotted path, None where there is none; `*` lists the rest of the path over a list."""
    found = mapping
    names = path.split(".")
    for i, name in enumerate(names):
        if name == "*":
            return [at(x, ".".join(names[i + 1 :])) for x in found or []]
        found = found.get(name) if isinstance(found, dict) else None
    return found


def frozen_violations(s: Settings, frozen: dict[str, dict] | None = None) -> Iterator[str]:
    """Settings of a frozen analysis that don't say what it was frozen with."""
    whole = {"analysis": s.analysis, "conditions": s.conditions, "graph": s.graph}
    for path, want in (frozen or FROZEN).get(s.graph["estimator"]["name"], {}).items():
        have = at(whole, path)
        if isinstance(want, bool) or have is None or type(have) is bool:
            same = have is want
        elif isinstance(want, list):
            same = len(have) == len(want) and all(float(a) == b for a, b in zip(have, want, strict=True))
        else:
            same = have == want if isinstance(want, str) else float(have) == want
        if not same:
            yield f"{path} is {have}, frozen as {want}"


def _across(s: Settings) -> Iterator[str]:
    """What parts of the settings must say alike."""
    estimator = s.graph["estimator"]["name"]
    if estimator not in ESTIMATORS:
        yield f"unknown estimator {estimator}"
    for need in ESTIMATORS.get(estimator, []):
        if not s.analysis.get(need):
            yield f"{estimator} needs the settings {need} of the analysis"
    base = at(s.analysis, "phase25.primary_ses_definition")
    for name in ("phase26", "phase3"):
        own = at(s.graph, f"{name}.primary_ses_definition")
        if own is not None and base is not None and own != base:
            yield f"{name}: its primary definition {own} is not that of its populations, {base}"
    boot = at(s.graph, "phase25.bootstrap.ses_definition")
    if boot is not None and boot != base:
        yield f"phase25: the bootstrap's definition {boot} is not the primary one, {base}"
    if estimator == "phase4_confirmatory_replication" and set(s.analysis["socioeconomic"]["definitions"]) != {s.analysis["socioeconomic"]["active_definition"]}:
        yield "a confirmatory replication has one definition"


def _ses(s: Settings) -> Iterator[str]:
    known, active = s.analysis["socioeconomic"]["definitions"], s.analysis["socioeconomic"]["active_definition"]
    if active not in known:
        yield f"the active definition {active} is not defined"
    elif str(s.year) not in known[active]["source_by_year"]:
        yield f"definition {active} has no source for {s.year}"
    for part in (s.analysis, s.graph):
        for name, p in part.items():
            if not isinstance(p, dict) or "primary_ses_definition" not in p:
                continue
            used = set(p.get("ses_definitions", known))
            if used - set(known):
                yield f"{name}: definitions {sorted(used - set(known))} are not defined"
            if p["primary_ses_definition"] not in used:
                yield f"{name}: the primary definition is none of its definitions"
            if any(int(code) >= 60 for code in p.get("geography_codes", [])):
                yield f"{name}: territories are no primary geography"


def _conditions(s: Settings) -> Iterator[str]:
    seen, year = set(), str(s.year)
    always = {str(y) for y in s.conditions.get("selection_policy", {}).get("required_years", [])}
    for c in s.conditions["conditions"]:
        name, sources, coding = c["canonical_name"], set(map(str, c["source_by_year"])), c["coding"]
        if name in seen:
            yield f"condition {name} is given twice"
        seen.add(name)
        needed = always | ({year} if c.get("primary", True) else set())
        if needed - sources:
            yield f"condition {name} has no source for {sorted(needed - sources)}"
        if coding["type"] != "binary":
            yield f"condition {name} has the unknown coding {coding['type']}"
        elif set(coding["positive_values"]) & set(coding["negative_values"]):
            yield f"condition {name} has codes that are both positive and negative"
    if len(seen) < 2:
        yield "fewer than two conditions are given"


def _rules(name: str, part: dict) -> Iterator[str]:
    """Rules, replicates, shares and seeds of one part of the graph settings."""
    listed = [r for key in ("phi_rules", "thresholds") for r in part.get(key, [])]
    ids = [r["rule_id"] for r in listed] + [part[k]["rule_id"] for k in ("adjusted_rule", "bootstrap") if "rule_id" in part.get(k, {})]
    ids += [part["stable_rule_id"]] if "stable_rule_id" in part else []
    if len(set(ids)) < len(ids):
        yield f"{name}: a rule id is used twice"
    if "primary_rule_id" in part and part["primary_rule_id"] not in ids:
        yield f"{name}: the primary rule is none of the rules"
    effects = [float(r["minimum_effect"]) for r in part.get("thresholds", [])]
    if effects != sorted(set(effects)):
        yield f"{name}: thresholds do not rise"
    boot = part.get("bootstrap", {})
    if boot and (int(boot["replicates"]) < 2 or boot.get("type", "bootstrap") != "bootstrap" or boot.get("mse", True) is not True):
        yield f"{name}: a bootstrap needs two replicates or more, of type bootstrap, with mse"
    if "selection_bank_seed" in boot and boot["seed"] == boot["selection_bank_seed"]:
        yield f"{name}: the evaluation bank has the seed of the selection bank"
    for key in ("selection_stability_threshold", "minimum_selection_stability"):
        for p in (boot, part, part.get("graph_definition", {})):
            if key in p and not 0 < float(p[key]) <= 1:
                yield f"{name}: {key} is not in (0, 1]"
    for key, value in [*part.get("density_null", {}).items(), *part.get("ses_permutation", {}).items()]:
        if (key.endswith("replicates") or key == "permutations") and int(value) < 2:
            yield f"{name}: {key} is below two"
    mining = part.get("mining", {})
    if mining:
        shares = [float(f) for f in mining["support_fractions"]]
        if shares != sorted(set(shares)) or not all(0 < f <= 1 for f in shares):
            yield f"{name}: support fractions do not rise within (0, 1]"
        if float(mining.get("primary_support_fraction", shares[0])) not in shares:
            yield f"{name}: the primary support is none of the support fractions"
        if not 2 <= int(mining["minimum_nodes"]) <= int(mining["maximum_nodes"]):
            yield f"{name}: motif sizes are out of order"
