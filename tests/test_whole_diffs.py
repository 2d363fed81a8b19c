"""Anomalies, decisions and comparisons by the whole rule."""

import pandas as pd

from pyspark.sql import functions as F

from logweave.operators import diff
from logweave.plans import log_queries as q
from logweave.streaming import tail


class State:
    exists, get = False, None

    def update(self, v):
        self.exists, self.get = True, v


def test_first_anomalies_are_those_of_the_detector(spark):
    base = [("t0", 10.0, 1.0, 12.0), ("t1", 10.0, 0.0, 10.0), ("t2", 2.0, 0.5, 2.9), ("t3", 10.0, 1.0, 40.0), ("t4", 10.0, 20.0, 12.0), ("t5", 0.3, 0.1, 1.0), ("t6", 7.1, 1.3, 9.0)]
    counts = {"t0": 100, "t1": 100, "t2": 100, "t3": 100, "t4": 50, "t5": 6, "t6": 100, "n3": 3, "n2": 2}
    runs = spark.createDataFrame([("r", "s", "x")], "run_id string, service_name string, scenario string")
    b = spark.createDataFrame([("s", "x", *r) for r in base], "service_name string, scenario string, template_id string, mean_count double, std_count double, p95_count double")
    rt = spark.createDataFrame([("r", k, n) for k, n in counts.items()], "run_id string, template_id string, event_count long")
    got = {(r.kind, r.template_id, r.event_no) for r in diff.first_anomalies(rt, runs, b).collect()}
    want, known = set(), {r[0]: r[1:] for r in base}
    for t, n in counts.items():
        state, run = State(), tail._detect(3.0, 5, 3)
        for _ in range(n):  # one event a batch
            row = pd.DataFrame([(1, *known.get(t, (None, None, None)))], columns=["n", "mean_count", "std_count", "p95_count"])
            for out in run((t,), iter([row]), state):
                want |= {(r.kind, r.template_id, r.observed_count) for r in out.itertuples()}
    assert got == want and ("regression", "t3", 41) in got and not any(t == "t4" for _, t, _ in got)


def test_decisions_do_not_depend_on_ids(spark):
    key = "service_name string, scenario string, template_id string, severity_text string"
    rows = [("s", "x", f"{d}{k}", sev, least) for d in "0369cf" for k, sev, least in (("a", "ERROR", 0), ("b", "INFO", 3), ("c", "INFO", 0), ("d", None, 1))]
    base = spark.createDataFrame(rows, key + ", min_count long")
    found = spark.createDataFrame([("s", "x", f"{d}n", "FATAL", "new_template") for d in "0369cf"] + [("s", "x", "am", "INFO", "new_template")], key + ", kind string")
    got = q._whole_decisions(base, found).groupBy("decision", F.substring("template_id", 2, 1).alias("k")).count().collect()
    assert {(r.decision, r.k): r["count"] for r in got} == {("banned", "a"): 6, ("pinned", "b"): 6, ("pinned", "d"): 6, ("banned", "n"): 6}


def test_a_few_events_more_are_no_increase(spark):
    schema = "template_id string, event_count long, severity_text string, error_kind string"
    side = lambda i: spark.createDataFrame([(t, c[i], "INFO", "none") for t, c in {"a": (4, 8), "b": (3, 6), "c": (4, 9), "d": (5, 10), "e": (20, 39)}.items()], schema)
    assert {r.template_id for r in diff.compare_runs(side(0), side(1)).collect()} == {"c", "d"}
