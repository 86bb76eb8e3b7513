import logging
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinis.operators import association, audit, recode, units
from affinis.plans.graph_queries import populations
from affinis.sources.bridge import CONDITIONS
from affinis.streaming import audit as stream
from jobs import incremental_audit, stability_bank
from jobs.queries import settings

DATA = "/root/testdata/sf0.001"
SMALL = {"minimum_effect": 0.12, "stability": 0.9, "replicates": 12, "seed": 7, "states_per_write": 9}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


# --- units of work -----------------------------------------------------------------------------------------


def table(spark, path, values, build=None, group=2, count=None):
    expected = spark.createDataFrame([(u, k) for u, ks in values.items() for k in ks], "unit int, k string")
    calls = []

    def make(own):
        calls.append(sorted(r.unit for r in own.collect()))
        if count is not None and len(calls) > count:
            raise RuntimeError("stopped")
        return (build or (lambda d: d.join(expected, "unit").withColumn("v", F.col("unit") * 10)))(own)

    return calls, lambda: units.resume(path, expected, ["unit"], ["k"], "k string, v int, unit int", make, group)


VALUES = {1: "ab", 2: "a", 3: "abc", 4: "b", 5: "c"}


def test_a_stopped_run_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    calls, run = table(spark, path, VALUES, count=1)
    with pytest.raises(RuntimeError, match="stopped"):
        run()
    assert calls == [[1, 2], [3, 4]]
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    calls, run = table(spark, path, VALUES)
    out = run()
    assert calls == [[3, 4], [5]] and out.columns == ["k", "v", "unit"]
    assert sorted(map(tuple, out.collect())) == sorted((k, u * 10, u) for u, ks in VALUES.items() for k in ks)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # finished units were left alone
    calls, run = table(spark, path, VALUES)
    assert rows(run()) == rows(out) and calls == []


def test_units_cut_short_doubled_or_of_other_keys_are_made_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    wrong = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("a", 3, 3), ("b", 3, 3), ("z", 3, 3), ("b", 40, 4), ("q", 1, 9)], "k string, v int, unit int")
    wrong.write.partitionBy("unit").parquet(path)
    calls, run = table(spark, path, VALUES, group=9)
    out = run()
    assert calls == [[1, 2, 3, 5]]  # 4 was whole; 9 isn't asked for and not returned
    assert sorted(map(tuple, out.collect())) == sorted((k, u * 10, u) for u, ks in VALUES.items() for k in ks)


def test_rows_not_asked_for_are_not_written_and_missing_ones_are_an_error(spark, tmp_path):
    more = lambda d: spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("x", 1, 77)], "k string, v int, unit int")
    _, run = table(spark, f"file://{tmp_path}/t", {1: "ab"}, more)
    assert [r.unit for r in run().collect()] == [1, 1]
    _, run = table(spark, f"file://{tmp_path}/u", {1: "abc"}, more)
    with pytest.raises(ValueError, match="without all of their rows"):
        run()
    _, run = table(spark, f"file://{tmp_path}/v", {}, more)
    assert run().collect() == []


# --- stability bank ----------------------------------------------------------------------------------------


def test_stability_bank_resumes_and_equals_one_run(spark, tmp_path, monkeypatch, caplog):
    caplog.set_level(logging.INFO, "affinis")
    whole = stability_bank.run(spark, DATA, f"file://{tmp_path}/a", SMALL | {"states_per_write": 25})
    seen = []
    made = stability_bank.resample.stable

    def failing(*args):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return made(*args)

    monkeypatch.setattr(stability_bank.resample, "stable", failing)
    with pytest.raises(RuntimeError, match="lost"):
        stability_bank.run(spark, DATA, f"file://{tmp_path}/b", SMALL)
    caplog.clear()
    got = stability_bank.run(spark, DATA, f"file://{tmp_path}/b", SMALL)
    assert "16 of 25 units to make" in caplog.text
    assert rows(got) == rows(whole) and got.count() == 2250
    files = lambda d: {str(p.relative_to(tmp_path / d).parent): p.read_bytes() for p in (tmp_path / d).rglob("*.parquet")}
    assert files("a") == files("b")  # the same bytes, however it was written


def test_stability_bank_keeps_settings_apart(spark, tmp_path):
    with pytest.raises(ValueError, match="wrong settings"):
        stability_bank.run(spark, DATA, f"file://{tmp_path}", SMALL | {"replicats": 3})
    with pytest.raises(ValueError, match="wrong settings"):
        stability_bank.run(spark, DATA, f"file://{tmp_path}", SMALL | {"replicates": 1})
    a = stability_bank.run(spark, DATA, f"file://{tmp_path}", SMALL | {"states_per_write": 25, "replicates": 2})
    b = stability_bank.run(spark, DATA, f"file://{tmp_path}", SMALL | {"states_per_write": 25, "replicates": 3})
    assert {r.n for r in a.select(F.length("bootstrap_selection_mask").alias("n")).collect()} == {3}
    assert {r.n for r in b.select(F.length("bootstrap_selection_mask").alias("n")).collect()} == {4}


# --- incremental audit -------------------------------------------------------------------------------------


def parts(spark, tmp_path, n=5):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None,) * 5, (None, "a@b", None, None, None), (1, "", "en", "srcX", 0), (2, "ü?\n1", "de", "srcX", -5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs.repartition(n).write.parquet(f"file://{tmp_path}/all")
    return docs, sorted((tmp_path / "all").glob("*.parquet"))


def give(files, folder):
    folder.mkdir(exist_ok=True)
    for f in files:
        shutil.copy(f, folder / f.name)


def batch_reports(docs, config):
    own = incremental_audit.survey(docs, config)
    names, items = list(config["conditions"]), config["items"]
    return stream.reports(stream.profiles(own, names, items), names, items, config["least_prevalence"], config["most_missing"])


def test_incremental_audit_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "affinis")
    docs, files = parts(spark, tmp_path)
    config = settings("incremental_audit") | {"files_per_batch": 1}
    run = lambda: incremental_audit.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", config)
    give(files[:2], tmp_path / "in")
    first = run()
    n = spark.read.parquet(*map(str, files[:2])).count()
    assert f"read {n} new rows" in caplog.text
    assert rows(first) == rows(batch_reports(spark.read.parquet(*map(str, files[:2])), config))
    caplog.clear()
    give(files[2:], tmp_path / "in")
    second = run()
    assert f"read {docs.count() - n} new rows" in caplog.text and "in 3 batches" in caplog.text
    want = rows(batch_reports(docs, config))
    assert rows(second) == want
    caplog.clear()
    assert rows(run()) == want and "read 0 new rows" in caplog.text


def test_a_batch_played_again_does_not_count_twice(spark, tmp_path):
    docs, files = parts(spark, tmp_path, 3)
    config = settings("incremental_audit")
    names, items = list(config["conditions"]), config["items"]
    add = stream.adder(names, items, f"file://{tmp_path}/p", lambda d: incremental_audit.survey(d, config))
    for batch in (0, 1, 1, 2, 0):
        add(spark.read.parquet(str(files[batch])), batch)
    got = stream.reports(stream.total(spark, f"file://{tmp_path}/p"), names, items, 0.3, 0.1)
    assert rows(got) == rows(batch_reports(docs, config))


def test_audit_of_profiles_equals_the_batch_audit(spark):
    people = recode.respondents(spark, DATA)
    profile = stream.profiles(people, CONDITIONS, ["ses_category", *CONDITIONS])
    out = {r: stream.reports(profile, CONDITIONS, ["ses_category", *CONDITIONS], 0.3, 0.1).where(F.col("report") == r) for r in ("state_sizes", "categories", "missingness", "prevalence", "candidates")}
    close = lambda a, b: (a is None and b is None) or abs(a - b) <= 1e-9 * max(1, abs(b))
    got = {r.geography_code: r for r in out["state_sizes"].collect()}
    for r in audit.state_sizes(people).collect():
        g = got.pop(str(r.geography_code))
        assert (g.n, g.n_missing) == (r.n_unweighted, r.n_invalid_weight) and close(g.weight, r.weighted_population_estimate)
    assert not got
    assert {(r.item, r.n) for r in out["categories"].collect()} == {(r.category, r.n) for r in audit.value_counts(people, "x").collect()}
    assert {(r.item, r.n, r.n_missing) for r in out["missingness"].collect()} == {(r["item"], r.n_total, r.n_missing) for r in audit.missingness(people, {"c": ["ses_category", *CONDITIONS]}).collect()}
    got = {(r.geography_code, r.item): r for r in out["prevalence"].collect()}
    for r in association.national_and_state(people).collect():
        g = got.pop((r.geography_code, r.condition))
        assert (g.n, g.n_cases) == (r.n_valid, r.n_cases) and close(g.value, r.weighted_prevalence) and close(g.weight, r.weighted_population_denominator) and close(g.kish_effective_n, r.kish_effective_n)
    assert not got
    got = {r.item: r for r in out["candidates"].collect()}
    for r in audit.candidate_status(people, 0.3, 0.1).collect():
        assert got[r.condition].status == r.prototype_selection_status and close(got[r.condition].value, r.weighted_prevalence)
    assert populations(spark, DATA).count() > 0


def test_incremental_audit_of_nothing_and_wrong_settings(spark, tmp_path):
    config = settings("incremental_audit")
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = incremental_audit.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", config)
    assert {r.report for r in out.collect()} <= {"prevalence", "missingness", "candidates"} and out.columns == stream.REPORT
    with pytest.raises(ValueError, match="settings lack"):
        incremental_audit.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", {})
    with pytest.raises(ValueError, match="names of conditions"):
        incremental_audit.survey(spark.read.parquet(f"{DATA}/documents.parquet"), config | {"items": ["text", "LONG"]})


def test_command_line(tmp_path):
    top = Path(__file__).parent.parent
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell", "PYTHONPATH": str(top)}
    call = [sys.executable, "-m", "jobs.incremental_audit", "--input", f"{DATA}/documents.parquet*", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    for n in (200, 0):
        done = subprocess.run(call, cwd=top, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"read {n} new rows" in done.stderr
    assert sorted(p.name for p in (tmp_path / "out" / "audit").glob("report=*")) == ["report=candidates", "report=categories", "report=missingness", "report=prevalence", "report=state_sizes"]
