"""Rules on what is unexpected, comparison by class, gate, orders, decisions, incremental index, tracebacks."""

import json
import os

from pyspark.sql import functions as F

from logweave import api
from logweave.functions import text
from logweave.operators import classify, diff, drain, registry
from logweave.plans import scan


def templates_of(spark, *rows):
    return spark.createDataFrame(list(rows), "template_id string, severity_text string, error_kind string, event_count long, normalized_template string, exception_type string, service_name string, parse_status string, classification string")


def row(tid, level="INFO", kind="none", n=1, classification=None):
    return (tid, level, kind, n, f"text {tid}", None, "s", "ok", classification)


def test_rules_say_what_is_unexpected(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text(json.dumps({"expected": [{"id": "x", "template_contains": "text e"}], "unexpected": {"new_error_severities": ["warning"], "min_count": 9}}))
    rules = classify.load_rules(str(p))
    assert rules["unexpected"] == {"new_error_severities": ["warning"], "frequency_increase_ratio": 2.0, "min_count": 9} and rules["known_noise"] == []
    df = templates_of(spark, row("a", "WARNING"), row("b", "ERROR"), row("e", "WARNING"), row("k", None, "log_error"))
    got = lambda r: {x.template_id: x.classification for x in classify.classify_templates(df, None, r).collect()}
    assert got(rules) == {"a": "unexpected", "b": "observed", "e": "expected", "k": "unexpected"}
    assert got(classify.DEFAULT_RULES)["b"] == "unexpected" and got(classify.DEFAULT_RULES)["a"] == "observed"


def test_comparison_counts_classified_templates(spark):
    left, right = templates_of(spark, row("gone", classification="regression"), row("same")), templates_of(spark, row("new", classification="unexpected"), row("low", "error"), row("same", n=9), row("noise", classification="known-noise"))
    assert {(r.template_id, r.kind) for r in diff.compare_runs(left, right).collect()} == {("gone", "fixed"), ("new", "new"), ("low", "new"), ("same", "frequency")}
    assert {(r.template_id, r.kind) for r in diff.compare_runs(left.drop("classification"), right.drop("classification")).collect()} == {("low", "new"), ("same", "frequency")}


def test_gate_deltas_and_orders(spark):
    s = spark.createDataFrame([("a", "safe", 0, 0), ("b", "safe", 1, 0), ("c", "no-change", 0, 0), ("d", "unsafe", 0, 0), ("e", "safe", 0, 2), ("f", "safe", None, None)], "run_id string, verdict string, new long, code_errors long")
    assert {r.run_id for r in registry.gate(s).collect()} == {"b", "d", "e"}
    runs = spark.createDataFrame([("r1", "s", "1", 10, 2, 1, "x"), ("r2", "s", "2", 9, 2, 3, "x"), ("r3", "t", "1", 1, 1, 1, "x")], "run_id string, service_name string, created_at string, event_count long, error_count long, code_event_count long, container string")
    got = {r.run_id: (r.delta_events, r.delta_code_errors, r.alert) for r in registry.run_deltas(runs).collect()}
    assert got == {"r1": (None, None, False), "r2": (-1, 2, True), "r3": (None, None, False)}
    assert {r.run_id: r.previous_run_id for r in registry.previous_runs(runs, ["container"]).collect()} == {"r1": None, "r3": "r1", "r2": "r3"}
    d = spark.createDataFrame([("s", "b", 1), ("s", "a", 1), ("s", "c", 5), ("r", "z", 0)], "service_name string, dependency string, incidents long")
    assert [(r.service_name, r.dependency) for r in registry.ordered(d, "dependencies").collect()] == [("r", "z"), ("s", "c"), ("s", "a"), ("s", "b")]


def test_drain_changes(spark):
    rows = [("s", "t1", "user <NUM> logged in", 9), ("s", "t2", "user bob logged in", 3), ("s", "t3", "quite another thing here today", 1)]
    df = spark.createDataFrame(rows, "service_name string, template_id string, normalized_template string, event_count long")
    moved = {(r.template_id, r.canonical_template_id) for r in drain.changes(drain.mine(df)).collect()}
    assert moved <= {("t2", "t1")} and drain.changes(drain.mine(df.where("template_id = 't3'"))).count() == 0


def test_prettify_traceback(spark):
    one = 'failed Traceback (most recent call last): File "a.py", line 3, in run   go(x) File "b.py", line 9, in go raise ValueError(x) ValueError: bad'
    df = spark.createDataFrame([(1, one), (2, "two\nlines"), (3, None), (4, "plain")], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.prettify_traceback(F.col("t"))).collect()]
    assert got[0].split("\n") == ["failed ", "Traceback (most recent call last):", ' File "a.py", line 3, in run', ' go(x)', ' File "b.py", line 9, in go', " raise ValueError(x) ValueError: bad"]
    assert got[1:] == ["two\nlines", "", "plain"]


def test_index_of_changed_runs_only(spark, tmp_path):
    root, out = tmp_path / "runs", str(tmp_path / "index")
    for k in range(4):
        p = tmp_path / f"{k}.ndjson"
        p.write_text("".join(json.dumps({"time": f"2026-05-14T10:00:{i:02}Z", "level": "INFO", "message": f"handled {i}"}) + "\n" for i in range(5 + k)))
        scan.write(scan.scan(spark, [str(p)], "gw", f"E2E_A_{k}"), str(root / f"r{k}"))
    ix = api.Index(spark, str(root), out)
    assert ix.build() == 4 and ix.build() == 0
    doc = root / "r2" / "run.json"
    doc.write_text(doc.read_text().replace('"event_count": 7', '"event_count": 70'))
    os.utime(doc, (1_900_000_000, 1_900_000_000))
    assert ix.build() == 1
    assert {r.run_id: r.event_count for r in ix.registry().collect()} == {"E2E_A_0": 5, "E2E_A_1": 6, "E2E_A_2": 70, "E2E_A_3": 8}
    assert ix.template_registry().first().runs_seen_count == 4 and ix.baseline().first().runs_in_baseline == 4
    assert {"input_bytes", "git_commit", "image_fingerprint", "indexed_at", "run_json_mtime_us"} <= set(ix.registry().columns)
    assert {(r.what, r.name, r.runs) for r in ix.services_and_scenarios().collect()} == {("service", "gw", 4), ("scenario", "a", 4)}
    tid = ix.template_registry().first().template_id
    ix.decide("gw", "a", tid, "pinned", "known")
    ix.decide("gw", "b", tid, "banned")
    assert [r.decision for r in ix.overrides_for("gw", "a").collect()] == ["pinned"]
    ix.decide("gw", "b", tid, None)
    assert ix.overrides().count() == 1
