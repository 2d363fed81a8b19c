"""Scans of files, the index over them, the command line, and the streaming operators."""

import json

import pytest
from pyspark.sql import functions as F

from logweave import api, cli
from logweave.plans import scan
from logweave.sources import files
from logweave.streaming import tail


def ndjson(path, n, fail=0, start=0, boot=True):
    rows = [{"time": f"2026-05-14T10:{i // 60:02}:{i % 60:02}Z", "level": "INFO", "message": f"handled request {i} for user_{i:08x}"} for i in range(start, start + n)]
    if boot:
        rows.insert(0, {"time": "2026-05-14T10:00:00Z", "level": "INFO", "message": "Starting gunicorn 21.2"})
        rows.insert(1, {"time": "2026-05-14T10:00:01Z", "level": "INFO", "message": "Booting worker with pid: 7"})
    rows += [{"time": "2026-05-14T11:00:00Z", "level": "ERROR", "message": f"KeyError: 'k{i}'\nTraceback (most recent call last):\n  boom"} for i in range(fail)]
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for k, (n, fail) in enumerate([(20, 0), (22, 0), (18, 0), (200, 3)]):
        ndjson(root / f"in{k}.ndjson", n, fail)
        assert cli.main(["scan", "--input", str(root / f"in{k}.ndjson"), "--service", "gw", "--run-id", f"E2E_SOAK_{k}", "--out", str(root / "out" / f"r{k}")]) == 0
    return root


def test_scan_outputs(spark, root):
    meta = json.loads((root / "out" / "r3" / "run.json").read_text())
    assert (meta["event_count"], meta["error_count"], meta["issue_kind_counts"]["code"]) == (205, 1, 3)
    ev = files.read_table(spark, str(root / "out" / "r3" / "events.parquet"))
    assert ev.agg(F.max("service_instance_seq")).first()[0] == 1 and ev.where("classification = 'unclassified'").count() == 0
    assert "KeyError" in (root / "out" / "r3" / "report.md").read_text()


def test_index_diff_and_exports(spark, root):
    out = root / "index"
    assert cli.main(["index", "--runs-root", str(root / "out"), "--out", str(out), "--min-green-runs", "3"]) == 0
    ix = api.Index(spark, str(root / "out"), str(out))
    assert {(r.run_id, r.status) for r in ix.runs().collect()} == {("E2E_SOAK_0", "green"), ("E2E_SOAK_1", "green"), ("E2E_SOAK_2", "green"), ("E2E_SOAK_3", "red")}
    assert ix.runs(status="red").count() == 1 and ix.runs("gw", "soak").count() == 4
    base = {r.mean_count for r in ix.baseline("gw", "soak").collect()}
    assert 20.0 in base
    kinds = {r.kind for r in ix.diff_for("E2E_SOAK_3").collect()}
    assert {"regressed_template", "new_template", "code_error"} <= kinds
    with pytest.raises(KeyError):
        ix.templates("none")
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(root / "none.parquet"))
    assert ix.lineage_for("handled request <NUM> for user", k=1).first().similarity > 0.3
    ix.register_views()
    assert spark.sql("select count(*) from baseline").first()[0] == ix.baseline().count()
    assert cli.main(["diff", "--runs-root", str(root / "out"), "--index", str(out), "--run-id", "E2E_SOAK_3", "--out", str(root / "d")]) == 0
    assert "unsafe" in (root / "d" / "diff.md").read_text()
    assert cli.main(["report-html", "--runs-root", str(root / "out"), "--index", str(out), "--out", str(root / "r.html")]) == 0
    assert cli.main(["compare", "--left", str(root / "out" / "r0"), "--right", str(root / "out" / "r3"), "--out", str(root / "c.md")]) == 0
    assert "new" in (root / "c.md").read_text()
    assert cli.main(["export-dataset", "--input", str(root / "out" / "r0"), "--out", str(root / "ds"), "--include-body"]) == 0
    rows = [json.loads(r.value) for r in spark.read.text(str(root / "ds")).collect()]
    assert len(rows) == 22 and {"body", "classification", "template_id"} <= set(rows[0])


def test_scan_keeps_the_last_restart_and_uses_a_baseline(spark, root):
    base = files.read_table(spark, str(root / "out" / "r0" / "templates.parquet"), "template_id")
    s = scan.scan(spark, [str(root / "in3.ndjson")], "gw", "x", instances="last", baseline_ids=base)
    got = {r.classification for r in s.templates.collect()}
    assert "expected" in got and "unexpected" in got
    with pytest.raises(ValueError, match="instances"):
        scan.scan(spark, [str(root / "in3.ndjson")], instances="some")


def test_stateful_anomalies(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    schema = "template_id string, n_total long"
    for k, ids in enumerate([["new"] * 2 + ["known"] * 8, ["new"] * 2 + ["known"] * 9, ["new"] * 5 + ["known"] * 5 + [None]]):
        spark.createDataFrame([(i, k) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(src))
    base = spark.createDataFrame([("known", 10.0, 1.0, 12.0)], "template_id string, mean_count double, std_count double, p95_count double")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = tail.anomalies(stream, base).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.kind, r.template_id) for r in spark.read.parquet(str(out)).collect()}
    assert got == {("new_template", "new"), ("regression", "known")}
    assert spark.read.parquet(str(out)).count() == 2  # each once


def test_windows_of_streams(spark, tmp_path):
    src = tmp_path / "ev"
    spark.sql("select timestamp'2026-05-14 10:00:00' + make_dt_interval(0, 0, 0, id * 10) ts, 't' template_id, 's' service_name, 2 v, 'Starting gunicorn' body from range(20)").write.parquet(str(src))
    ev = lambda: spark.readStream.schema("ts timestamp, template_id string, service_name string, v int, body string").parquet(str(src))
    for name, df in (("b", tail.bursts(ev(), "ts", 6, "0 seconds")), ("r", tail.rates(ev(), "ts", "v", "30 seconds", "30 seconds", "0 seconds")), ("s", tail.restart_sessions(ev(), "ts", "5 seconds", "0 seconds"))):
        q = df.writeStream.format("memory").queryName(f"w_{name}").option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("w_b").count() == 3 and {r.n for r in spark.table("w_b").collect()} == {6}
    assert {r.total for r in spark.table("w_r").collect()} == {6}
    assert spark.table("w_s").count() >= 18


def test_materialized_folder(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    ndjson(src / "a.ndjson", 10)
    run = lambda: tail.materialize(tail.stream_lines(spark, str(src)), str(out), str(tmp_path / "ck"), "gw", "r").awaitTermination(120)
    run()
    ndjson(src / "b.ndjson", 5, fail=1)
    run()
    t = files.read_table(spark, f"{out}/templates.parquet")
    assert t.agg(F.sum("event_count")).first()[0] == 12 + 8
    assert t.where("severity_text = 'ERROR'").count() == 1
