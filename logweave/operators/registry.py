"""Cross-run registry, template registry and statistical baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99)


def incident_rollup(incidents: DataFrame) -> DataFrame:
    """Incidents and downtime per run."""
    return incidents.groupBy("run_id").agg(F.count(F.lit(1)).alias("incidents"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("downtime_s"))


def template_registry(run_templates: DataFrame, runs: DataFrame) -> DataFrame:
    """Per service and template: runs seen, green runs, events, first and last run by (created_at, run_id), static columns of the first run."""
    r = runs.select("run_id", F.col("service_name").alias("_service"), "created_at", "status")
    j = run_templates.drop("service_name").join(r, "run_id").withColumnRenamed("_service", "service_name")
    at = F.struct("created_at", "run_id")
    static = F.struct("normalized_template", "severity_text", "issue_kind", "error_kind", "exception_type")
    g = j.groupBy("service_name", "template_id").agg(
        F.min_by(static, at).alias("f"), F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("runs_seen_count"),
        F.count_if(F.col("status") == "green").alias("green_runs_seen_count"), F.sum("event_count").alias("total_event_count"),
    )
    return g.select("service_name", "template_id", "f.*", F.col("a.run_id").alias("first_seen_run_id"), F.col("z.run_id").alias("last_seen_run_id"), F.col("a.created_at").alias("first_seen_at"), F.col("z.created_at").alias("last_seen_at"), "runs_seen_count", "green_runs_seen_count", "total_event_count")


def baseline(run_templates: DataFrame, runs: DataFrame, min_green_runs: int = 3) -> DataFrame:
    """Statistics of a template's count over the green runs of its cohort (service, scenario); runs without it count as zero.

    The zeros are one row with their number as frequency, so no product of runs
    and templates is built.
    """
    green = runs.where(F.col("status") == "green").select("run_id", F.col("service_name").alias("_service"), "scenario", "created_at")
    cohort = green.groupBy(F.col("_service").alias("service_name"), "scenario").agg(F.count(F.lit(1)).alias("n_runs")).where(F.col("n_runs") >= min_green_runs)
    key = ["service_name", "scenario", "template_id"]
    seen = run_templates.drop("service_name").join(green, "run_id").withColumnRenamed("_service", "service_name").join(cohort, ["service_name", "scenario"])
    per = seen.groupBy(*key, "n_runs", F.col("event_count").alias("x")).agg(F.count(F.lit(1)).alias("f"), F.max_by(F.struct("normalized_template", "severity_text", "issue_kind"), F.struct("created_at", "run_id")).alias("s"), F.max(F.struct("created_at", "run_id")).alias("at"))
    # a row per different count of a template: places are sums of frequencies behind the zeros, moments are doubles around the mean
    whole = Window.partitionBy(*key)
    n, x, f = F.col("n_runs"), F.col("x").cast("double"), F.col("f").cast("double")
    per = per.withColumn("zeros", n - F.sum("f").over(whole)).withColumn("mean", F.sum(x * f).over(whole) / n).withColumn("upto", F.col("zeros") + F.sum("f").over(whole.orderBy("x")))

    def place(q: float, step) -> Column:
        """The count at the place below or above a quantile of the sorted, padded counts."""
        at = step(F.lit(q) * (n - 1))
        return F.when(F.first(at) >= F.first("zeros"), F.min(F.when(F.col("upto") > at, F.col("x")))).otherwise(0)

    g = per.groupBy(*key, "n_runs").agg(
        F.first("zeros").alias("zeros"), F.first("mean").alias("mean"), F.sum(f * (x - F.col("mean")) * (x - F.col("mean"))).alias("m2"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max_by("s", "at").alias("s"),
        *[place(q, step).alias(f"_{name}{i}") for i, q in enumerate(PERCENTILES) for name, step in (("floor", F.floor), ("ceil", F.ceil))],
    )
    pos = [F.lit(q) * (n - 1) for q in PERCENTILES]
    cols = [(F.col(f"_floor{i}") + (F.col(f"_ceil{i}") - F.col(f"_floor{i}")) * (p - F.floor(p))).alias(f"p{int(q * 100)}_count") for i, (q, p) in enumerate(zip(PERCENTILES, pos))]
    m2 = F.col("m2") + F.col("zeros") * F.col("mean") * F.col("mean")
    std = F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0)
    return g.select(*key, "s.*", F.col("mean").alias("mean_count"), std.alias("std_count"), *cols, F.when(F.col("zeros") > 0, 0).otherwise(F.col("lo")).alias("min_count"), F.col("hi").alias("max_count"), n.alias("runs_in_baseline"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each service by (created_at, run_id)."""
    at = F.struct("created_at", "run_id")
    rest = [c for c in runs.columns if c != "service_name"]
    return runs.groupBy("service_name").agg(F.max_by(F.struct(*rest), at).alias("r")).select("service_name", "r.*")


def run_deltas(runs: DataFrame) -> DataFrame:
    """Each run against the run before of its service: delta_events, delta_errors and, where the runs have them, delta_templates,
    delta_code_errors and delta_log_bytes (null for the first), and whether it alerts: errors or code errors rose."""
    w = Window.partitionBy("service_name").orderBy("created_at", "run_id")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    counts = [c for c in ("template_count", "code_event_count", "input_bytes") if c in runs.columns]
    names = {"template_count": "delta_templates", "code_event_count": "delta_code_errors", "input_bytes": "delta_log_bytes"}
    out = runs.select("run_id", "service_name", "created_at", d("event_count").alias("delta_events"), d("error_count").alias("delta_errors"), *[d(c).alias(names[c]) for c in counts])
    rises = F.col("delta_errors") > 0
    if "code_event_count" in counts:
        rises = rises | (F.col("delta_code_errors") > 0)
    return out.withColumn("alert", F.coalesce(rises, F.lit(False)))


def gate(summary: DataFrame) -> DataFrame:
    """Runs that a pipeline should stop for: whose verdict is not safe, or with new templates or code errors (of ``diff.diff_summary``)."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    passes = (F.col("verdict") != "unsafe") & none("new") & none("code_errors")
    return summary.where(~passes)


def history(runs: DataFrame, keep: int = 200) -> DataFrame:
    """The last ``keep`` runs of each service."""
    w = Window.partitionBy("service_name").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """Existing rows whose key is not among the new ones, and the new ones."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def snapshot_status(current: DataFrame, known: DataFrame) -> DataFrame:
    """Whether a captured source (service_name, container, fingerprint) is known: same_snapshot, same_container_new_logs or new_container."""
    seen = known.groupBy("service_name", "container").agg(F.collect_set("fingerprint").alias("_prints"))
    return current.join(seen, ["service_name", "container"], "left").withColumn("snapshot_status", F.when(F.col("_prints").isNull(), "new_container").when(F.array_contains("_prints", F.col("fingerprint")), "same_snapshot").otherwise("same_container_new_logs")).drop("_prints")


def previous_runs(runs: DataFrame, by: Sequence[str] = ("service_name", "scenario")) -> DataFrame:
    """The run before each run of its service and scenario (or container: ``by``) by (created_at, run_id); null for the first."""
    w = Window.partitionBy(*by).orderBy("created_at", "run_id")
    return runs.select("run_id", F.lag("run_id").over(w).alias("previous_run_id"))


def overview(indexed: DataFrame, streamed: DataFrame) -> DataFrame:
    """Services of the index and of the stream together (service_name, then the columns of either side)."""
    return indexed.join(streamed, "service_name", "full")


def services_and_scenarios(runs: DataFrame) -> DataFrame:
    """The different services and scenarios: (what, name, runs), each in order."""
    each = lambda c, what: runs.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("runs")).select(F.lit(what).alias("what"), "name", "runs")
    return each("service_name", "service").unionByName(each("scenario", "scenario"))


#: Orders in which tables are shown and written.
ORDERS = {
    "registry": (("service_name", "asc"), ("created_at", "asc"), ("run_id", "asc")),
    "template_registry": (("service_name", "asc"), ("total_event_count", "desc"), ("template_id", "asc")),
    "baseline": (("service_name", "asc"), ("scenario", "asc"), ("mean_count", "desc"), ("template_id", "asc")),
    "regressed": (("delta_factor", "desc"), ("template_id", "asc")),
    "code_errors": (("observed_count", "desc"), ("template_id", "asc")),
    "cooccurrence": (("lift", "desc"), ("n", "desc"), ("template_a", "asc"), ("template_b", "asc")),
    "dependencies": (("service_name", "asc"), ("incidents", "desc"), ("dependency", "asc")),
    "replay": (("ts_us", "asc"), ("kind", "asc")),
    "templates": (("event_count", "desc"), ("template_id", "asc")),
}


def ordered(df: DataFrame, name: str) -> DataFrame:
    """A table in its order of :data:`ORDERS`; nulls come first in ascending order."""
    return df.orderBy(*[F.col(c).desc() if how == "desc" else F.col(c).asc() for c, how in ORDERS[name]])
