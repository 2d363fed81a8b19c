"""Snapshots, key counts and intervals against brute force, with the dirt that tables hold."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.operators import intervals, key_counts, snapshots

REG = "service_name string, template_id string, snapshot_no int, delivered_at timestamp, normalized_template string, severity_text string, change_kind string"


def at(h):
    return datetime(2025, 9, 1, h)


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], REG)
    return {tuple(r) for r in snapshots.registry_changes(df).collect()}


def test_snapshot_changes(spark):
    rows = [
        ("A ", "t1", 1, at(1), "Queue <NUM>", "WARN"), ("a", "t2", 1, at(1), "x", None), ("a", "t3", 1, at(1), "x", "INFO"),
        ("a", " T1", 2, at(1), "queue  <NUM>", "warning "), ("a", "t2", 2, at(1), "x", "NOTICE"), ("a", "t4", 2, at(1), "n", "INFO"),
        ("a", "t1", 4, at(1), "old", "INFO"), ("a", "t1", 4, at(2), "Queue <NUM>", "ERROR"), ("a", "t1", 4, None, "none", "INFO"), ("a", "t3", 4, at(1), "x", "INFO"), ("a", "t3", 4, at(1), "x", "INFO"),
        ("a", None, 5, at(1), "x", "INFO"), (None, "t9", 5, at(1), "x", "INFO"), ("b", "t1", 3, at(1), "x", "INFO"), ("a", " ", 5, at(1), "x", "INFO"),
    ]
    assert changes(spark, rows) == {
        ("a", "t3", 2, "removed"), ("a", "t4", 2, "added"), ("a", "t1", 4, "changed"), ("a", "t2", 4, "removed"), ("a", "t4", 4, "removed"), ("a", "t3", 4, "added"),
        ("a", "t1", 5, "removed"), ("a", "t3", 5, "removed"),
    }
    assert changes(spark, []) == set()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(1, 5), st.integers(1, 3), st.sampled_from(["p", "q"]), st.sampled_from(["INFO", "ERROR"])), max_size=40))
def test_snapshot_changes_against_brute_force(spark, rows):
    held, days = {}, {}
    for s, k, n, h, x, lv in sorted(rows, key=lambda r: (r[3], r[4], r[5])):
        held[s, k, n] = (x, lv)
        days.setdefault(s, set()).add(n)
    want = set()
    for s, ns in days.items():
        order = sorted(ns)
        for p, n in zip(order, order[1:]):
            for k in "xyz":
                a, b = held.get((s, k, p)), held.get((s, k, n))
                if a != b:
                    want.add((s, k, n, "added" if a is None else "removed" if b is None else "changed"))
    assert changes(spark, [(s, k, n, at(h), x, lv) for s, k, n, h, x, lv in rows]) == want


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_key_counts(spark, chunk):
    rows = [("S ", "t", f"e{i % 97}") for i in range(400)] + [("s", "t", "e5"), ("s", None, "x"), (None, "t", "y"), ("s", "t", None), ("r", "u", "e1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "service_name string, template_id string, event_id string, n_rows int").repartition(5)
    got = key_counts.distinct_members_by_key(df, {"service_name": F.lower(F.trim("service_name")), "template_id": F.col("template_id")}, F.col("event_id"), chunk)
    assert {tuple(r) for r in got.collect()} == {("s", "t", 401, 97), ("r", "u", 1, 1)}
    assert {tuple(r) for r in key_counts.event_counts(df).collect()} == {("s", "t", 97), ("r", "u", 1)}
    keys = [F.lower(F.trim("service_name")), F.col("template_id")]
    offsets = key_counts.key_pieces(df, keys, F.col("event_id"), chunk).where("k0 = 's'").orderBy("row_offset").collect()
    assert [c.row_offset for c in offsets] == [sum(x.n_rows for x in offsets[:i]) for i in range(len(offsets))] and all(c.n_members <= chunk for c in offsets)
    # chunks: equal but for the last and a piece (copies combined in a batch are rows of one piece), in order, all rows once
    chunks = key_counts.key_chunks(df, keys, F.col("event_id"), chunk, 50).where("k0 = 's'").orderBy("chunk").collect()
    assert sum(c.n_rows for c in chunks) == 401 and [c.first_row for c in chunks] == [sum(x.n_rows for x in chunks[:i]) for i in range(len(chunks))]
    assert all(a.last <= b.first for a, b in zip(chunks, chunks[1:]))
    if chunk == 1:
        assert all(45 <= c.n_rows <= 55 for c in chunks[:-1])


def test_key_counts_of_no_rows(spark):
    assert key_counts.event_counts(spark.createDataFrame([], "service_name string, template_id string, event_id string")).count() == 0


def merged(rows):
    out = {}
    for e in {r[0] for r in rows}:
        xs = sorted((s, z) for k, s, z in rows if k == e and s is not None and z is not None and z > s)
        for s, z in xs:
            if out.get(e) and s <= out[e][-1][1]:
                out[e][-1][1] = max(out[e][-1][1], z)
            else:
                out.setdefault(e, []).append([s, z])
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-30, 120)), st.one_of(st.none(), st.integers(-30, 120))), max_size=25), st.sampled_from([1, 7, 10, 1000]))
def test_intervals_against_brute_force(spark, rows, shard):
    df = spark.createDataFrame(rows, "sh string, s0 long, e0 long")
    down = intervals.merge_intervals(df, ["sh"], "s0", "e0", shard)
    want = merged(rows)
    assert sorted((tuple(r) for r in down.collect()), key=repr) == sorted(((e, *p) for e, ps in want.items() for p in ps), key=repr)
    gaps = intervals.gaps(down, ["sh"], "s0", "e0", shard)
    assert sorted((tuple(r) for r in gaps.collect()), key=repr) == sorted(((e, a[1], b[0]) for e, ps in want.items() for a, b in zip(ps, ps[1:])), key=repr)


def test_downtime(spark):
    inc = [
        ("r1", " Kafka", "2025-10-04T10:00:00Z", "2025-10-04T12:00:01.500+02:00", 1), ("r1", "kafka", "2025-10-04T10:00:01.500Z", "2025-10-04T13:30:00Z", 1), ("r1", "KAFKA", "2025-10-04T15:00:00Z", None, 1),
        ("r1", "kafka", "2025-10-04T12:00:00Z", "2025-10-04T11:00:00Z", 1), ("r2", "kafka", "2025-10-04T15:00:00Z", None, 1), ("r1", "kafka", "broken", None, 1), ("r1", "kafka", None, "2025-10-04T13:30:00Z", 1),
    ]
    runs = spark.createDataFrame([("r1", datetime(2025, 10, 4, 16)), (None, None)], "run_id string, finished_at timestamp")
    df = spark.createDataFrame(inc + inc[:1], "run_id string, dependency string, down_at string, up_at string, e int")
    ms = lambda h, m=0, s=0.0: int(datetime.fromisoformat(f"2025-10-04T{h:02}:{m:02}:00+00:00").timestamp() * 1000 + s * 1000)
    assert {tuple(r) for r in intervals.downtime(df, runs).collect()} == {("r1", "kafka", "down", ms(10), ms(13, 30)), ("r1", "kafka", "gap", ms(13, 30), ms(15)), ("r1", "kafka", "down", ms(15), ms(16))}
    assert intervals.downtime(df.limit(0), runs).count() == 0
