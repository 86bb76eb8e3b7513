import copy
import hashlib
import json
import math
import struct
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from affinis.operators import graphs, protocol
from affinis.sources import archive, files, settings
from affinis.streaming import audit


def test_csv_round_trip_with_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None), (3, "NA", 1.0)], "i int, s string, x double")
    for compress in (False, True):
        path = f"file://{tmp_path}/c{compress}"
        files.write_csv(df, path, compress)
        back = files.read_csv(spark, path, "i int, s string, x double").orderBy("i").collect()
        assert [tuple(r) for r in back] == [(1, "a", 0.5), (2, None, None), (3, None, 1.0)]


def test_reports_are_strict_json(spark):
    df = spark.createDataFrame([(math.nan, math.inf, 1, ["a"])], "x double, y double, n int, l array<string>")
    assert json.loads(files.report_json(df)) == {"x": None, "y": None, "n": 1, "l": ["a"]}
    with pytest.raises(ValueError, match="one row"):
        files.report_json(df.union(df))


def test_config_digest_ignores_key_order():
    assert files.digest({"a": 1, "b": [2]}) == files.digest({"b": [2], "a": 1}) and len(files.digest({})) == 12


def test_graph_files(spark):
    names = ["A", "B", "C"]
    g = spark.createDataFrame([("x", 1), ("y", 0)], "graph_id string, mask long")
    out = {r.graph_id: json.loads(r.json) for r in files.node_link(g, names).collect()}
    assert out["x"]["links"] == [{"source": "A", "target": "B"}] and out["y"]["links"] == [] and len(out["y"]["nodes"]) == 3
    xml = {r.graph_id: r.xml for r in files.graphml(g, names).collect()}
    assert '<edge source="A" target="B"/>' in xml["x"] and "<edge" not in xml["y"] and graphs.pairs_of(names)[0] == ("A", "B")


def ibm(x):
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x, e = (128, -x, 64) if x < 0 else (0, x, 64)
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + int(x * 2**56).to_bytes(7, "big")


def transport(path, rows):
    card = lambda s: s.encode().ljust(80)
    head = card("HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000") + card("SAS") * 2
    head += card("HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140")
    head += card("HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000") + card("SAS") * 2
    head += card("HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000000200000000000000000000")
    spec = [(1, 8, 1, "X", "a number", 0), (2, 3, 2, "S", "a text", 8)]
    names = b"".join(struct.pack(">hhhh", k, 0, w, n) + v.encode().ljust(8) + label.encode().ljust(40) + bytes(28) + struct.pack(">i", at) + bytes(52) for k, w, n, v, label, at in spec)
    head += names.ljust(-(-len(names) // 80) * 80)
    head += card("HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000")
    body = b"".join(ibm(x) + s.encode().ljust(3) for x, s in rows)
    path.write_bytes(head + body.ljust(-(-len(body) // 80) * 80))


def test_transport_file(spark, tmp_path):
    rows = [(1.5, "a"), (None, "bc"), (-0.1, ""), (0.0, "z"), (123456.789, "q")]
    transport(tmp_path / "t.xpt", rows)
    df = files.read_transport(spark, f"file://{tmp_path}/t.xpt")
    got = [(None if r.X is None or math.isnan(r.X) else r.X, r.S) for r in df.collect()]
    assert [g[1] for g in got] == ["a", "bc", None, "z", "q"] and [g[0] for g in got][1] is None
    assert [g[0] for g in got if g[0] is not None] == pytest.approx([1.5, -0.1, 0.0, 123456.789])
    assert files.read_transport(spark, f"{tmp_path}/t.xpt", ["S", "S"]).columns == ["S"]
    with pytest.raises(KeyError, match="no such"):
        files.read_transport(spark, f"{tmp_path}/t.xpt", ["NONE"])


def test_streaming_totals_equal_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i - 2)) for i in range(20)], "state_code int, survey_weight double")
    df.where("survey_weight < 8").write.parquet(f"file://{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in/*")
    audit.start(stream(), "totals", f"file://{tmp_path}/cp").awaitTermination()
    df.where("survey_weight >= 8").write.parquet(f"file://{tmp_path}/in/b")
    audit.start(stream(), "totals", f"file://{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r) for r in spark.table("totals").collect())
    assert got == sorted(tuple(r) for r in audit.running_state_sizes(df).collect())


def test_ordered_and_single_outputs_have_equal_bytes(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 7 AS k").repartition(5)
    read = lambda p: [f.read_bytes() for f in sorted(p.glob("part-*"))]
    for i in range(2):
        files.write_csv(df.repartition(3 + i), f"file://{tmp_path}/s{i}", True, ["k", F.desc("id")], single=True)
        files.write_csv(df, f"file://{tmp_path}/o{i}", False, ["k", F.desc("id")])
    assert read(tmp_path / "s0") == read(tmp_path / "s1") and len(read(tmp_path / "s0")) == 1
    rows = [line for part in read(tmp_path / "o0") for line in part.decode().splitlines()[1:]]
    assert rows == [f"{i},{k}" for k, i in sorted(((i % 7, i) for i in range(50)), key=lambda x: (x[0], -x[1]))]


def test_graph_files_with_attributes(spark):
    g = spark.createDataFrame([("x", 2024, "A & B", 0.5), ("y", 2024, "none", None)], "graph_id string, year int, geography string, kish_effective_n double")
    nodes = spark.createDataFrame([("x", c, 0.25, 100, 25) for c in ("HEART_DISEASE", "STROKE")], "graph_id string, condition string, prevalence double, n_valid long, n_cases long")
    rows = [("x", "HEART_DISEASE", "STROKE", True, 0.2, "weighted_phi", 99, 9, 1.5, None), ("x", "HEART_DISEASE", "OTHER", True, 0.2, "weighted_phi", 99, 9, 1.5, None), ("x", "STROKE", "HEART_DISEASE", False, 0.0, "weighted_phi", 99, 9, 1.0, None)]
    edges = spark.createDataFrame(rows, "graph_id string, source_condition string, target_condition string, edge_present boolean, association double, estimator string, n_complete long, cooccurring_cases long, odds_ratio double, q_value double")
    a = files.attributed(g, nodes, edges)
    x, y = (json.loads(r.json) for r in files.attributed_json(a).orderBy("graph_id").collect())
    assert x["graph"] == {"graph_id": "x", "year": 2024, "geography": "A & B", "kish_effective_n": 0.5}
    assert x["nodes"][0] == {"id": "HEART_DISEASE", "label": "Heart Disease", "prevalence": 0.25, "n_valid": 100, "n_cases": 25}
    assert x["edges"] == [{"source": "HEART_DISEASE", "target": "STROKE", "association": 0.2, "estimator": "weighted_phi", "n_complete": 99, "cooccurring_cases": 9, "odds_ratio": 1.5}]
    assert y["nodes"] == y["edges"] == [] and "kish_effective_n" not in y["graph"]
    xml = ElementTree.fromstring(files.attributed_graphml(a).where("graph_id = 'x'").first().xml.split("?>", 1)[1])
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert {d.get("key"): d.text for d in xml.find(f"{ns}graph/{ns}edge")} == {"edge_association": "0.2", "edge_estimator": "weighted_phi", "edge_n_complete": "99", "edge_cooccurring_cases": "9", "edge_odds_ratio": "1.5"}
    assert len(xml.findall(f"{ns}graph/{ns}node")) == 2 and {k.get("attr.type") for k in xml.findall(f"{ns}key")} == {"string", "double", "long"}


def test_archive_is_read_only_with_good_checksums(spark, tmp_path):
    folder = tmp_path / "archive"
    (folder / "sub").mkdir(parents=True)
    (folder / "manifest.json").write_text(json.dumps({"config_digest": "abc"}))
    (folder / "sub" / "t.csv").write_text("i,s\n1,a\n2,NA\n")
    sums = [f"{hashlib.sha256((folder / p).read_bytes()).hexdigest()}  {p}" for p in ("manifest.json", "sub/t.csv")]
    (folder / "SHA256SUMS").write_text("\n".join(sums) + "\n")
    load = lambda digest: archive.load_archive(spark, f"file://{folder}", digest, {"sub/t.csv": "i int, s string"})
    assert [tuple(r) for r in load("abc")["sub/t.csv"].orderBy("i").collect()] == [(1, "a"), (2, None)]
    assert {r.path for r in archive.provenance(spark, f"file://{folder}").collect()} == {"manifest.json", "sub/t.csv", "SHA256SUMS"}
    with pytest.raises(ValueError, match="another configuration"):
        load("abd")
    (folder / "sub" / "t.csv").write_text("i,s\n1,b\n")
    with pytest.raises(ValueError, match="mismatch: sub/t.csv"):
        load("abc")
    (folder / "sub" / "t.csv").unlink()
    with pytest.raises(ValueError, match="mismatch: sub/t.csv"):
        load("abc")


def test_cached_and_resumed_tables(spark, tmp_path):
    built = []
    make = lambda: built.append(0) or spark.range(3)
    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert archive.cached(spark, f"file://{tmp_path}", "t", key, make).count() == 3
    assert len(built) == 2
    asked = []

    def build(values, fail=()):
        asked.append(values)
        if set(values) & set(fail):
            raise RuntimeError("lost")
        return spark.createDataFrame([(v, v * v) for v in values], "state_code int, x int")

    with pytest.raises(RuntimeError):
        archive.resumed(spark, f"file://{tmp_path}", "r", {}, "state_code", [4, 1, 2, 3], lambda v: build(v, [3]), 2)
    got = archive.resumed(spark, f"file://{tmp_path}", "r", {}, "state_code", [1, 2, 3, 4], build, 2)
    assert asked == [[1, 2], [3, 4], [3, 4]] and sorted(map(tuple, got.collect())) == [(i, i * i) for i in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="not asked for"):
        archive.resumed(spark, f"file://{tmp_path}", "w", {}, "state_code", [1], lambda v: build([9]), 2)


GOOD = {
    "analysis": {"data": {"year": 2024}, "socioeconomic": {"active_definition": "edu", "definitions": {"edu": {"source_by_year": {"2024": "E"}}}}, "prototype": {"states": [1]}, "outputs": {"root": "out/", "interim": "mid"}},
    "conditions": {"registry_version": 1, "conditions": [{"canonical_name": n, "source_by_year": {"2024": n}, "coding": {"type": "binary", "positive_values": [1], "negative_values": [2]}} for n in "ab"]},
    "graph": {
        "estimator": {"name": "weighted_phi"},
        "stability": {"thresholds": [{"rule_id": "p10", "minimum_effect": 0.1}, {"rule_id": "p12", "minimum_effect": 0.12}], "primary_rule_id": "p12", "stable_rule_id": "s", "bootstrap": {"replicates": 500, "type": "bootstrap", "mse": True, "selection_stability_threshold": 0.9}},
        "motifs": {"mining": {"support_fractions": [0.1, 0.2], "primary_support_fraction": 0.2, "minimum_nodes": 3, "maximum_nodes": 5}, "density_null": {"fixed_edge_replicates": 10}},
    },
}


@pytest.mark.parametrize(
    ("path", "value", "wrong"),
    [
        (("analysis", "socioeconomic", "active_definition"), "income", "not defined"),
        (("analysis", "data", "year"), 2023, "no source for 2023"),
        (("analysis", "prototype", "states"), [], "no state"),
        (("conditions", "conditions", 1, "canonical_name"), "a", "given twice"),
        (("conditions", "conditions", 0, "coding", "negative_values"), [1], "both positive and negative"),
        (("conditions", "conditions", 0, "coding", "type"), "ordinal", "unknown coding"),
        (("conditions", "selection_policy"), {"required_years": [2022]}, "no source for ..2022"),
        (("graph", "stability", "thresholds", 1, "rule_id"), "p10", "used twice"),
        (("graph", "stability", "thresholds", 1, "minimum_effect"), 0.05, "do not rise"),
        (("graph", "stability", "primary_rule_id"), "x", "none of the rules"),
        (("graph", "stability", "bootstrap", "replicates"), 1, "two replicates"),
        (("graph", "stability", "bootstrap", "selection_stability_threshold"), 1.5, "not in"),
        (("graph", "motifs", "mining", "primary_support_fraction"), 0.3, "primary support"),
        (("graph", "motifs", "mining", "minimum_nodes"), 6, "out of order"),
        (("graph", "motifs", "density_null", "fixed_edge_replicates"), 1, "below two"),
    ],
)
def test_settings_are_checked(path, value, wrong):
    import re

    assert list(settings.violations(settings.Settings(**GOOD))) == []
    bad = copy.deepcopy(GOOD)
    at = bad
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    assert any(re.search(wrong, v) for v in settings.violations(settings.Settings(**bad)))


def test_settings_from_files(spark, tmp_path):
    for name, part in GOOD.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(part))
    paths = [f"file://{tmp_path}/{n}.json" for n in GOOD]
    s = settings.load(spark, *paths)
    assert s == settings.Settings(**GOOD) and s.output_path("audit") == f"out/audit/year=2024/run={s.digest}" and s.interim_path() == f"mid/year=2024/run={s.digest}"
    assert {k: v for k, v in s.manifest("audit").items() if k in ("population_definition", "edge_threshold", "multiple_testing_rule", "gspan_support", "software_version")} == {"population_definition": "state × edu", "edge_threshold": None, "multiple_testing_rule": "none: edges by effect size alone", "gspan_support": [0.1, 0.2], "software_version": settings.VERSION}
    assert s.manifest("audit", rows=3)["config_digest"] == s.digest and s.manifest("audit", rows=3)["rows"] == 3
    with pytest.raises(ValueError, match="no source for 2023"):
        settings.load(spark, *paths, year=2023)
    (tmp_path / "l.yaml").write_text("a: [1, 2]\n")
    assert settings.read_mapping(spark, f"file://{tmp_path}/l.yaml") == {"a": [1, 2]}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        settings.read_mapping(spark, f"file://{tmp_path}/l.json")


def test_provenance_and_hypotheses(spark):
    frozen = spark.createDataFrame([("m1", 3, 0.5, "[1]"), ("m2", 4, 0.25, "[2]"), ("m3", 1, None, "[3]")], "motif_id string, n long, share double, edges string")
    source = spark.createDataFrame([("m1", 3, 0.5 + 1e-14, "[1]"), ("m2", 4, 0.2500001, "[x]"), ("m2", 4, 0.25, "[2]")], "motif_id string, support long, fraction double, edge_list string")
    out = {r.field: (r.missing, r.doubled, r.mismatches) for r in protocol.provenance_violations(frozen, source, "motif_id", {"support": "n", "fraction": "share", "edge_list": "edges"}).collect()}
    assert out == {"n": (1, 1, 0), "share": (1, 1, 1), "edges": (1, 1, 1)}
    v = spark.createDataFrame([("m1", "[1]"), ("m2", "[2]")], "motif_id string, edge_list string")
    rows = [("H1", 1, 1, "lower", "m1", "[1]"), ("H2", 2, 1, "higher", "m2", "[9]"), ("H2", 4, -1, "higher", "zz", "[1]")]
    h = spark.createDataFrame(rows, "hypothesis_id string, family_order int, direction_sign int, expected_enrichment string, motif_id string, edge_list string")
    assert tuple(protocol.hypothesis_violations(h, v).first()) == (1, True, 1, 1, 1) and tuple(protocol.hypothesis_violations(h.limit(1), v).first()) == (0, False, 0, 0, 0)
    t = spark.createDataFrame([("alpha", "0.05"), ("replicates", "500"), ("ses", "edu")], "field string, value string")
    got = {tuple(r) for r in protocol.target_violations(t, {"alpha": (0, 0.01), "replicates": (2, 1000)}, {"ses": "edu", "year": 2023}).collect()}
    assert got == {("alpha", "beyond its limits"), ("year", "absent")}


@pytest.mark.parametrize("n", [0, 1, 7, 8, 500])
@pytest.mark.parametrize("cards", [1, 800])
def test_transport_rows_that_cross_splits(spark, tmp_path, monkeypatch, n, cards):
    monkeypatch.setattr(files, "MOST_CARDS", cards)
    rows = [(float(i) - 3.5, "abc"[: i % 4]) for i in range(n)]
    transport(tmp_path / "t.xpt", rows)
    got = [(r.X, r.S) for r in files.read_transport(spark, f"file://{tmp_path}/t.xpt").collect()]
    assert got == [(x, s or None) for x, s in rows]
    size = (tmp_path / "t.xpt").stat().st_size
    for splits in (3, 40):  # as many splits as bytes allow, so that some observations span several
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.set("mapreduce.input.fileinputformat.split.maxsize", str(max(80, size // splits)))
        try:
            assert [(r.X, r.S) for r in files.read_transport(spark, f"file://{tmp_path}/t.xpt").collect()] == got
        finally:
            conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    (tmp_path / "u.xpt").write_bytes((tmp_path / "t.xpt").read_bytes() + b"x")
    with pytest.raises(ValueError, match="no whole number of cards"):
        files.read_transport(spark, f"file://{tmp_path}/u.xpt")


def test_one_file_a_graph(spark, tmp_path):
    path = f"file://{tmp_path}/graphs"
    g = spark.createDataFrame([(f"2024_0{i}", json.dumps({"n": i, "text": "a\nb é"})) for i in range(5)], "graph_id string, json string").repartition(3)
    files.write_graph_files(g, path, "json")
    assert {p.name: [f.read_text() for f in p.glob("part-*")] for p in (tmp_path / "graphs").glob("graph_id=*")} == {f"graph_id={r.graph_id}": [r.json + "\n"] for r in g.collect()}
    assert sorted(map(tuple, files.read_graph_files(spark, path).collect())) == sorted(map(tuple, g.collect()))
    files.write_graph_files(spark.createDataFrame([("2024_03", "new")], g.schema), path, "json")
    assert {r.graph_id: r.value for r in files.read_graph_files(spark, path).collect()} == {r.graph_id: r.json for r in g.collect()} | {"2024_03": "new"}
    before = sorted(p.name for p in (tmp_path / "graphs").rglob("*"))
    with pytest.raises(Exception, match="two graphs of one id"):
        files.write_graph_files(spark.createDataFrame([("2024_09", "a"), ("2024_09", "b")], g.schema), path, "json")
    assert [x for x in sorted(p.name for p in (tmp_path / "graphs").rglob("*")) if not x.startswith((".", "_"))] == [x for x in before if not x.startswith((".", "_"))]


def test_caches_are_tried_in_order(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    call = lambda: archive.resolved(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"], f"file://{tmp_path}/own", "people", {"k": 1}, build)
    table, origin = call()
    assert (table.count(), origin, len(made)) == (3, "built", 1)
    table, origin = call()
    assert table.count() == 3 and "/own/people/key=" in origin and len(made) == 1
    spark.range(7).write.parquet(f"file://{tmp_path}/b/people")
    assert call()[0].count() == 7 and call()[1].endswith("/b/people")
    (tmp_path / "a" / "people").mkdir(parents=True)  # without _SUCCESS it isn't whole
    assert call()[1].endswith("/b/people")


def test_frozen_and_shared_settings():
    s = settings.Settings(**copy.deepcopy(GOOD))
    assert list(settings.violations(s)) == []
    paths = settings.FROZEN["phase3_gspan"]
    frozen = copy.deepcopy(GOOD['graph']) | {"estimator": {"name": "phase3_gspan"}, "phase3": {"primary_ses_definition": "other"}}
    for path, value in paths.items():
        node = frozen
        *way, last = path.split(".")[1:]
        for name in way:
            node = node.setdefault(name, {})
        node[last] = value
    analysis = copy.deepcopy(GOOD['analysis'])
    analysis["phase25"] = {"primary_ses_definition": analysis["socioeconomic"]["active_definition"], "geography_codes": [1]}
    made = lambda: settings.Settings(analysis, GOOD['conditions'], frozen)
    assert any("is not that of its populations" in v for v in settings.violations(made()))
    frozen["phase3"]["primary_ses_definition"] = analysis["phase25"]["primary_ses_definition"]
    assert list(settings.frozen_violations(made())) == [] and not any("populations" in v for v in settings._across(made()))
    for path, value in paths.items():
        *way, last = path.split(".")[1:]
        node = frozen
        for name in way:
            node = node[name]
        node[last] = (not value) if isinstance(value, bool) else "x" if isinstance(value, str) else [0.5] if isinstance(value, list) else value + 1
        assert len(list(settings.frozen_violations(made()))) == 1
        del node[last]
        assert len(list(settings.frozen_violations(made()))) == 1
        node[last] = value
    frozen["estimator"]["name"] = "none such"
    assert "unknown estimator none such" in list(settings.violations(made()))
    del analysis["phase25"]
    frozen["estimator"]["name"] = "phase3_gspan"
    assert any("needs the settings phase25" in v for v in settings.violations(made()))
