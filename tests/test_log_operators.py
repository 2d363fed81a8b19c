"""Classification, sequences, registry, diffs, graphs and template mining on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import classify, dashboards, diff, drain, graph, registry, sequences, templates
from logweave.operators.combine import combine_batches


def test_issue_kinds(spark):
    rows = [("KafkaError", "x", "none", "INFO", "infra"), ("KeyError", "connection refused", "none", "INFO", "code"), (None, "3/3 brokers are down", "none", "ERROR", "infra"), (None, 'File "x", line 3, in f', "none", "INFO", "code"), (None, "x", "traceback", "INFO", "code"), (None, None, None, "error", "code"), (None, None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "e string, t string, k string, s string, want string")
    assert df.where(classify.issue_kind(F.col("t"), F.col("e"), F.col("k"), F.col("s")) != F.col("want")).count() == 0


def test_classification(spark):
    rows = [("a", "BrokenPipeError seen", "ERROR", "none"), ("b", "LogLevel: x", "INFO", "none"), ("c", "boom", "ERROR", None), ("d", None, None, None), ("e", "boom", "FATAL", "none")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "template_id string, normalized_template string, severity_text string, error_kind string, classification string")
    got = {r.template_id: (r.classification, r.baseline_match) for r in classify.classify_templates(df, spark.createDataFrame([("e",), ("e",), (None,)], "template_id string")).collect()}
    assert got == {"a": ("known-noise", False), "b": ("expected", False), "c": ("unexpected", False), "d": ("observed", False), "e": ("expected", True)}
    rule = {"id": "r", "body_contains": "x"}
    assert df.where(classify.rule_predicate(rule)).count() == 0  # templates carry no body


def test_template_aggregate_of_dirty_rows(spark):
    cols = "event_id string, template_id string, timestamp string, observed_timestamp string, parse_status string, source string, offset long, " + ", ".join(f"{c} string" for c in templates.STATIC)
    rows = [("2", "t", "", "9", "degraded", "s", 2, *["b"] * 7), ("1", "t", None, "5", "ok", "s", 1, *[None] * 7), ("3", None, "1", None, "ok", "s", 3, *["c"] * 7)]
    r = templates.aggregate_templates(spark.createDataFrame(rows, cols)).collect()
    assert [(x.template_id, x.event_count, x.first_seen, x.last_seen, x.example_event_id, x.service_name, x.parse_status) for x in r] == [("t", 2, "5", "9", "1", None, "degraded")]
    assert templates.aggregate_templates(spark.createDataFrame([], cols)).count() == 0


def boots_of(marks):
    out, last = [], None
    for pos, us in marks:
        if last is None or us is None or us - last > 30_000_000:
            out.append((pos, us))
        last = us if us is not None else last
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_restarts(spark, chunk):
    rnd = random.Random(3)
    marks = [(i, rnd.choice([None, rnd.randrange(0, 200) * 1_000_000])) for i in range(0, 60, 3)]
    rows = [("a", i, dict(marks).get(i), "Booting worker with pid: 1" if i % 3 == 0 else "work") for i in range(60)] + [("b", 1, 1, "work")]
    ev = spark.createDataFrame(rows, "source string, offset long, ts_us long, body string")
    boot = sequences.boots(ev, ["source"], "offset", chunk=chunk)
    want = boots_of(marks)
    assert [(r.boot_order, r.started_us) for r in boot.orderBy("seq").collect()] == want
    ann = sequences.with_instances(ev, boot, ["source"], "offset", chunk)
    assert {(r.source, r.offset): r.service_instance_seq for r in ann.collect()} == {(s, o): (sum(p <= o for p, _ in want) if s == "a" else 0) for s, o, _, _ in rows}
    assert sequences.keep_instances(ann, boot, ["source"], "last").where("source = 'a'").agg(F.min("offset")).first()[0] == want[-1][0]
    assert sequences.keep_instances(ann, boot, ["source"], "all").count() == len(rows)
    assert sequences.keep_instances(ann, boot, ["source"], 0).where("source = 'b'").count() == 1
    with pytest.raises(ValueError, match="instances"):
        sequences.keep_instances(ann, boot, ["source"], "some")


@pytest.mark.parametrize("chunk", [1, 2, 1 << 16])
def test_outages(spark, chunk):
    msgs = ["joined group", "x", "_ALL_BROKERS_DOWN", "_TRANSPORT failed", "rejoined group g", "AutoReconnect", "brokers are down"]
    ev = spark.createDataFrame([("s", i, i * 1_000_000, m) for i, m in enumerate(msgs)], "source string, offset long, ts_us long, body string")
    marks = sequences.connectivity_marks(ev, ["source", "offset", "ts_us"])
    got = {tuple(r) for r in sequences.connectivity_incidents(marks, ["source"], "offset", chunk=chunk).select("dependency", "down_us", "up_us", "down_events", "duration_s").collect()}
    assert got == {("kafka", 2_000_000, 4_000_000, 2, 2.0), ("kafka", 6_000_000, None, 1, 0.0), ("mongo", 5_000_000, None, 1, 0.0)}
    assert {(r.dependency, r.state) for r in sequences.connectivity_state(marks, ["source"], "offset").collect()} == {("kafka", "down"), ("mongo", "down")}


def test_baseline_pads_with_zeros(spark):
    runs = spark.createDataFrame([(f"r{i}", "s", "x", f"2025-01-0{i}", "green" if i < 5 else "red") for i in range(1, 6)], "run_id string, service_name string, scenario string, created_at string, status string")
    rows = [("r1", "t", 100), ("r2", "t", 105), ("r3", "t", 95), ("r1", "u", 8), ("r5", "t", 9999)]
    rt = spark.createDataFrame([(a, b, c, "s", "INFO", "n", "code") for a, b, c in rows], "run_id string, template_id string, event_count long, service_name string, severity_text string, normalized_template string, issue_kind string")
    got = {r.template_id: r for r in registry.baseline(rt, runs, 3).collect()}
    assert (got["t"].mean_count, got["t"].p50_count, got["t"].min_count, got["t"].max_count, got["t"].runs_in_baseline) == (75.0, 97.5, 0, 105, 4)
    assert (got["u"].mean_count, got["u"].p95_count) == (2.0, pytest.approx(6.8)) and got["u"].std_count == pytest.approx(4.0)
    assert registry.baseline(rt, runs, 9).count() == 0


def test_registry_helpers(spark):
    runs = spark.createDataFrame([("a", "s", "1", 5, 0), ("b", "s", "2", 8, 2), ("c", "q", "1", 1, 1)], "run_id string, service_name string, created_at string, event_count long, error_count long")
    assert {(r.service_name, r.run_id) for r in registry.latest_runs(runs).collect()} == {("s", "b"), ("q", "c")}
    assert {(r.run_id, r.delta_errors, r.alert) for r in registry.run_deltas(runs).collect()} == {("a", None, False), ("b", 2, True), ("c", None, False)}
    assert registry.history(runs, 1).count() == 2
    assert {(r.run_id, r.event_count) for r in registry.upsert(runs, runs.where("run_id = 'a'").withColumn("event_count", F.lit(7).cast("long"))).collect()} == {("a", 7), ("b", 8), ("c", 1)}
    known = spark.createDataFrame([("s", "c1", "f1")], "service_name string, container string, fingerprint string")
    now = spark.createDataFrame([("s", "c1", "f1"), ("s", "c1", "f2"), ("s", "c2", "f1")], known.schema)
    assert {r.snapshot_status for r in registry.snapshot_status(now, known).collect()} == {"same_snapshot", "same_container_new_logs", "new_container"}


def test_overrides_and_verdicts(spark):
    schema = "run_id string, service_name string, scenario string, template_id string, kind string, severity_text string, base_severity string, observed_count long, mean_count double, delta_factor double, z_score double"
    f = spark.createDataFrame([("r", "s", "x", "new", "new_template", "INFO", None, 3, None, None, None), ("r", "s", "x", "bad", "new_template", "INFO", None, 4, None, None, None), ("r", "s", "x", "gone", "missing_template", None, "INFO", None, 1.0, None, None)], schema)
    o = spark.createDataFrame([("s", "x", "new", "pinned"), ("s", "x", "bad", "banned"), ("s", "x", "else", "pinned"), ("q", "x", "bad", "banned")], "service_name string, scenario string, template_id string, decision string")
    got = {(r.template_id, r.kind) for r in diff.apply_overrides(f, o).collect()}
    assert got == {("gone", "missing_template"), ("bad", "policy_violation"), ("else", "pinned_missing")}
    assert diff.diff_summary(f).first().verdict == "safe" and diff.diff_summary(diff.apply_overrides(f, o)).first().verdict == "unsafe"
    assert diff.set_override(o, "s", "x", "new", None).count() == 3 and diff.set_override(o, "s", "x", "new", "banned").count() == 4
    with pytest.raises(ValueError, match="decision"):
        diff.set_override(o, "s", "x", "new", "maybe")


def test_similar_pairs_against_all_pairs(spark):
    rnd, words = random.Random(5), "alpha beta gamma delta queue lease".split()
    texts = [(f"t{i}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))), rnd.choice(["INFO", "ERROR"])) for i in range(60)]
    df = spark.createDataFrame(texts, "id string, text string, g string")

    def sh(t):
        w = t.split()
        return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}

    want = {(a[0], b[0]) for a in texts for b in texts if a[0] != b[0] and a[2] == b[2] and sh(a[1]) and sh(b[1]) and len(sh(a[1]) & sh(b[1])) / len(sh(a[1]) | sh(b[1])) > 0.5}
    assert {(r.left_id, r.right_id) for r in diff.similar_pairs(df, df, 0.5, ("g",)).collect()} == want


def test_cooccurrence_against_loop(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["w1", None]), rnd.choice("ABC"), rnd.randrange(0, 300) * 1_000_000) for _ in range(150)] + [("w1", None, 5), ("w1", "A", None)]
    df = spark.createDataFrame(rows, "worker_id string, template_id string, ts_us long")
    want = {}
    ok = [r for r in rows if r[1] and r[2] is not None]
    for w in {r[0] or "" for r in ok}:
        xs = sorted((t, i) for v, i, t in ok if (v or "") == w)
        for n, (ta, a) in enumerate(xs):
            for tb, b in xs[n + 1 :]:
                if tb - ta <= 30_000_000 and a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = graph.cooccurrence(df).collect()
    assert {(r.template_a, r.template_b): r.n for r in got} == want
    m = {k: sum(r[1] == k for r in ok) for k in "ABC"}
    assert all(r.lift == pytest.approx(r.n * len(ok) / (m[r.template_a] * m[r.template_b])) for r in got)


def test_flattened_timeline_and_matrix(spark):
    df = spark.sql("select 'r' run_id, 's' service_name, map('kafka', named_struct('incidents', array(named_struct('down_at', 'a', 'up_at', 'b'), named_struct('down_at', 'c', 'up_at', null))), 'mongo', named_struct('incidents', array())) connectivity_timeline")
    assert {tuple(r) for r in dashboards.flatten_timeline(df).collect()} == {("r", "s", "kafka", "a", "b"), ("r", "s", "kafka", "c", None)}
    cells = spark.createDataFrame([("s", "x", "r1", "t", 3), ("s", "x", "r2", "t", 4)], "service_name string, scenario string, run_id string, template_id string, n long")
    assert tuple(dashboards.heatmap_matrix(cells, ["r1", "r2"]).first()) == ("s", "x", "t", 3, 4)


def test_template_mining(spark):
    texts = ["user <NUM> logged in", "user <ID> logged in", "user <NUM> logged out", "disk full", "", None, "disk gone", "user <NUM> logged in"]
    df = spark.createDataFrame([("s", f"t{i}", t, 10 - i, "x") for i, t in enumerate(texts)], "service_name string, template_id string, normalized_template string, event_count long, cluster_no string")
    got = {r.template_id: (r.canonical_template_id, r.drain_template) for r in drain.mine(df).collect()}
    assert got["t0"] == got["t1"] == got["t2"] == got["t7"] == ("t0", "user <NUM> logged <*>")
    assert got["t4"] == got["t5"] == ("t4", "") and got["t3"] == got["t6"] == ("t3", "disk <*>")
    roll = {r.canonical_template_id: (r.event_count, r.n_members) for r in drain.rollup(drain.mine(df)).collect()}
    assert roll["t0"] == (10 + 9 + 8 + 3, 4)
    remapped = templates.remap_templates(df.select("template_id"), drain.mine(df))
    assert remapped.where("template_id = 't0'").count() == 4


def test_every_message_is_in_one_cluster_of_its_length():
    rnd = random.Random(11)
    msgs = [[rnd.choice(["a", "b", "c1", "<NUM>", "d"]) for _ in range(rnd.randint(1, 5))] for _ in range(400)]
    for k in (2, 100):
        trees = {}
        for m in msgs:
            trees.setdefault(len(m), drain.Tree(max_children=k)).add(m)
        clusters = [(n, c) for n, tree in trees.items() for cs in tree.leaves.values() for c in cs]
        assert all(len(t) == n for n, (t, _) in clusters) and sum(s for _, (_, s) in clusters) == len(msgs)
        assert all(len(below - {drain.WILDCARD}) <= k for tree in trees.values() for below in tree.nodes.values())


def test_mining_goes_on_from_a_state(spark):
    first = spark.createDataFrame([("s", "a", "node one up", 5)], "service_name string, template_id string, normalized_template string, event_count long")
    second = spark.createDataFrame([("s", "b", "node one down", 5), ("s", "c", "other", 1)], first.schema)
    state = drain.tree_state(first)
    assert {r.template_id: r.drain_template for r in drain.mine(second, state).collect()} == {"b": "node one <*>", "c": "other"}
    damaged = state.withColumn("state", F.lit("{"))
    assert {r.drain_template for r in drain.mine(second, damaged).collect()} == {"node one down", "other"}
    assert drain.tree_state(second, state).count() == 2


def test_copies_are_combined_where_they_are_read(spark):
    df = spark.createDataFrame([("a", None, 3, "x")] * 500 + [("a", None, 1, "x"), ("b", "k", None, "x"), (None, None, 2, "x")], "k string, l string, v int, other string").coalesce(1)
    got = {tuple(r) for r in combine_batches(df, ["k", "l"], least=["v"], count="n").collect()}
    assert got == {("a", None, 1, 501), ("b", "k", None, 1), (None, None, 2, 1)}
    assert combine_batches(df.limit(0), ["k"]).count() == 0


def test_lineage_and_editor(spark):
    f = spark.createDataFrame([("r", "s", "x", "n1", "new_template", "INFO"), ("r", "s", "x", "n2", "new_template", "ERROR"), ("r", "s", "x", "n1", "code_error", "INFO")], "run_id string, service_name string, scenario string, template_id string, kind string, severity_text string")
    texts = spark.createDataFrame([("r", "n1", "queue closed by peer"), ("r", "n2", "queue closed by peer")], "run_id string, template_id string, normalized_template string")
    base = spark.createDataFrame([("s", "x", "b2", "queue closed by peers", "INFO", 1.0), ("s", "x", "b1", "queue closed by host", "INFO", 1.0), ("q", "x", "b0", "queue closed by peer", "INFO", 1.0)], "service_name string, scenario string, template_id string, normalized_template string, severity_text string, mean_count double")
    got = {(r.template_id, r.kind, r.predecessor_template_id) for r in diff.with_lineage(f, texts, base, 0.4).collect()}
    assert got == {("n1", "evolved_template", "b1"), ("n2", "new_template", None), ("n1", "code_error", None)}
    seen = spark.createDataFrame([("s", "x", "b1", "text", "ERROR", 4)], "service_name string, scenario string, template_id string, normalized_template string, severity_text string, event_count long")
    o = spark.createDataFrame([("s", "x", "o1", "banned"), ("s", "x", "b1", "pinned")], "service_name string, scenario string, template_id string, decision string")
    rows = {r.template_id: (r.severity_text, r.observed_count, r.mean_count, r.decision) for r in diff.editor_universe(seen, base.where("service_name = 's'"), o).collect()}
    assert rows == {"b1": ("ERROR", 4, 1.0, "pinned"), "b2": ("INFO", None, 1.0, None), "o1": (None, None, None, "banned")}


def test_baseline_of_large_counts(spark):
    runs = spark.createDataFrame([(f"r{i}", "s", "x", f"2025-01-0{i}", "green") for i in range(1, 5)], "run_id string, service_name string, scenario string, created_at string, status string")
    counts = [4_000_000_000, 4_000_000_000, 4_000_000_004, 9_000_000_000_000_000_000]
    rows = [(f"r{i + 1}", "t", c) for i, c in enumerate(counts[:3])] + [(f"r{i}", "u", counts[3]) for i in (1, 2)]
    rt = spark.createDataFrame([(a, b, c, "s", "INFO", "n", "code") for a, b, c in rows], "run_id string, template_id string, event_count long, service_name string, severity_text string, normalized_template string, issue_kind string")
    got = {r.template_id: r for r in registry.baseline(rt, runs, 3).collect()}
    import statistics

    for tid, padded in (("t", [0, *counts[:3]]), ("u", [0, 0, counts[3], counts[3]])):
        assert got[tid].mean_count == pytest.approx(statistics.mean(padded)) and got[tid].std_count == pytest.approx(statistics.stdev(padded))
        assert (got[tid].min_count, got[tid].max_count) == (0, padded[-1])
    assert got["t"].p50_count == 4_000_000_000
    # around a large mean: the spread is kept
    only = spark.createDataFrame([(f"r{i}", "t", 4_000_000_000 + i, "s", "INFO", "n", "code") for i in range(1, 5)], rt.schema)
    assert registry.baseline(only, runs, 3).first().std_count == pytest.approx(1.2909944487358056)
