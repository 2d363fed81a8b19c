"""Ranged reads, the last restart found from the end, merged templates, the scheduler and its state."""

import json
import random

from logweave.operators import sequences, templates
from logweave.sources import files
from logweave.streaming import growing, schedule, tail


def test_read_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 16)
    p = tmp_path / "a.log"
    rnd = random.Random(5)
    lines = [("x" * rnd.randint(0, 40)).encode() + rnd.choice([b"", b"\r"]) for _ in range(50)]
    data = b"".join(x + b"\n" for x in lines)
    p.write_bytes(data + b"being writ")
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(51)]
    for start in (0, starts[7], starts[7] + 1, len(data), len(data) + 4):
        df, end = files.read_range(spark, str(p), start)
        want = [(o, x.removesuffix(b"\r").decode()) for o, x in zip(starts, lines) if o >= start]
        assert [(r.offset, r.line) for r in df.orderBy("offset").collect()] == want
        assert end == max(start, len(data))


def test_last_boot(tmp_path):
    p = tmp_path / "a.log"
    find = lambda **kw: growing.last_boot(str(p), sequences.BOOT, sequences.BOOT_HEAD, **kw)
    p.write_text("nothing here\n" * 100)
    assert find() is None
    boot = "Starting gunicorn 21\nlistening\nBooting worker with pid: 1\n"
    p.write_text("old\n" + boot + "work\n" * 3000 + "note\n" + boot + "work\n" * 2000)
    want = p.read_text().rindex("Starting gunicorn")
    for block in (64, 1000, 65536):
        assert find(block=block) == want
    p.write_text("Booting worker with pid: 9\n")
    assert find() == 0


def test_merged_templates_are_those_of_all_events(spark):
    cols = "event_id string, source string, offset long, timestamp string, observed_timestamp string, template_id string, parse_status string, service_name string, severity_text string, severity_number long, normalized_template string, error_kind string, exception_type string, issue_kind string"
    rnd = random.Random(2)
    rows = [(f"e{i}", "s", i, rnd.choice(["", None, f"t{rnd.randint(0, 9)}"]), "o", rnd.choice(["a", "b", None]), rnd.choice(["ok", "degraded", None]), "v", "INFO", 9, f"n{i % 3}", None, None, None) for i in range(60)]
    every = spark.createDataFrame(rows, cols)
    parts = [templates.partial_templates(every.where(f"offset % 3 = {k}")) for k in range(3)]
    merged = templates.finished_templates(templates.merge_templates(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(merged) == key(templates.aggregate_templates(every))


def test_run_until(spark, tmp_path):
    q = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    assert tail.run_until(q, max_runtime_s=2.0, tick_s=0.5) == "max_runtime" and not q.isActive
    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck2")).start()
    assert tail.run_until(q, stop=lambda: True, tick_s=0.5) == "stopped"


def test_scheduler():
    s = schedule.Scheduler(every_ticks=3, most_fragments=5, services_per_cycle=2, registry_every=2, idle_before_backoff=2)
    state = {k: schedule.ServiceState() for k in "abcd"}
    for k, n in zip("abc", (10, 30, 20)):
        state[k].read_to(1, 100, n)
    assert [s.tick(state, True) for _ in range(3)] == [([], False), ([], False), (["b", "c"], False)]
    for k in "bc":
        state[k].materialized()
    for _ in range(5):
        state["d"].read_to(1, state["d"].offset + 10, 1)
    assert s.tick(state, False) == (["a", "d"], True)  # backlog, and the registry after two rounds
    assert s.interval_s == 5.0
    s.tick({}, False)
    assert s.interval_s == 10.0
    for _ in range(9):
        s.tick({}, False)
    assert s.interval_s == 60.0
    s.tick({}, True)
    assert s.interval_s == 5.0


def test_live_state(tmp_path):
    p = tmp_path / "live.json"
    p.write_text(json.dumps({"last_log_size": {"a": 7, "b": "x"}}))
    s = schedule.LiveState(str(p))
    assert s.services == {"a": schedule.ServiceState(offset=7, materialized_offset=7)}
    assert not s.get("a").read_to(3, 20, 4) and s.get("a").pending_events == 4
    assert s.get("a").read_to(4, 5, 1) and s.get("a") == schedule.ServiceState(inode=4, offset=5, sequence=1, pending_fragments=1, pending_events=1)  # rotated
    assert s.get("a").read_to(4, 2, 1)  # truncated
    s.save()
    assert schedule.LiveState(str(p)).services == s.services
    p.write_text("{broken")
    assert schedule.LiveState(str(p)).services == {}
