import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logweave.llm import runs

SCHEMA = "event_id string, source string, offset long, service_name string, template_id string, normalized_template string, timestamp string, observed_timestamp string, n_events int"


def near(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    return bool(a) and len(a) == len(b) and sum(x == y for x, y in zip(a, b)) >= 0.8 * len(a)


def brute(rows):
    seen, kept = set(), []
    for r in sorted((r for r in rows if r[4] is not None and None not in r[:4]), key=lambda r: (r[3].strip().lower(), r[1], r[2], r[0], r[6] or "", r[7] or "")):
        k = (r[3].strip().lower(), r[1])
        if (k, r[0]) not in seen:
            seen.add((k, r[0]))
            kept.append((k, r))
    out, cur = set(), []
    for k, r in kept:
        p = cur[-1] if cur else None
        if not (p and p[0] == k and (p[1][4] == r[4] or near(p[1][5], r[5]))):
            cur = []
        cur.append((k, r))
        out.discard(tuple(x[1][0] for x in cur[:-1]))
        out.add(tuple(x[1][0] for x in cur))
    return {(c[0], c[-1], len(c)) for c in out if len(c) >= 3}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_runs_over_chunks(spark, partitions):
    rnd = random.Random(1)
    texts = {"A": "one two three four five", "B": "ONE two three four  six", "C": "other words", "D": None, "E": ""}
    rows = []
    for f in range(3):
        t = "A"
        for i in range(120 if f == 0 else 30):
            t = rnd.choice("ABCDE") if rnd.random() < 0.25 else t
            tpl = rnd.choice([t, t, t + "2", None])
            rows.append((f"e{f}-{i}", f"s{f % 2}", i, rnd.choice(["svc", " SVC"]), tpl, texts[t] if tpl else None, f"2025-01-01T00:{i % 60:02}:00Z" if rnd.random() < 0.8 else "-", "2025-01-01T01:00:00Z", 1))
    rows += rows[::7] + [(None, "s0", 1, "svc", "A", "x", None, None, 1), ("q", None, 1, "svc", "A", "x", None, None, 1)]
    services = spark.createDataFrame([("svc", "UTC", "dmy")], "service_name string, time_zone string, date_order string")
    got = runs.event_runs(spark.createDataFrame(rows, SCHEMA), services, partitions=partitions).collect()
    assert {(r.first_event_id, r.last_event_id, r.n_events) for r in got} == brute(rows)


def test_duration_and_no_rows(spark):
    services = spark.createDataFrame([("svc", "Europe/Madrid", "dmy")], "service_name string, time_zone string, date_order string")
    at = ["2025-01-01T00:00:10.9999Z", "01/01/2025 01:00:00", None, "-"]
    rows = [(f"e{i}", "s", i, "svc", "t", "x", a, None, 1) for i, a in enumerate(at)] + [(f"n{i}", "s2", i, "svc", "t", "x", "", None, 1) for i in range(3)]
    got = {tuple(r) for r in runs.found(runs.event_runs(spark.createDataFrame(rows, SCHEMA), services)).collect()}
    assert got == {("e0", "e3", 4, 10999), ("n0", "n2", 3, 0)}
    assert runs.found(runs.event_runs(spark.createDataFrame([], SCHEMA), services)).count() == 0


BLANKS = st.text(st.sampled_from(" \t\u00a0\u2003\u3000\u1680\x1f\x85\u200b"), min_size=1, max_size=2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(blanks=st.lists(BLANKS, min_size=12, max_size=12), partitions=st.integers(1, 8))
def test_blanks_of_any_kind_and_any_partitions(spark, blanks, partitions):
    rows = [(f"e{i:02}", "s", i, "svc", f"t{i}", f"a{b}b c{b}d {i % 2 if i % 5 else 'x y'}", None, None, 1) for i, b in enumerate(blanks)]
    services = spark.createDataFrame([("svc", "UTC", "dmy")], "service_name string, time_zone string, date_order string")
    got = runs.event_runs(spark.createDataFrame(rows, SCHEMA), services, partitions=partitions).collect()
    assert {(r.first_event_id, r.last_event_id, r.n_events) for r in got} == brute(rows)
