"""Cross-run views: heatmap, novelty, burn-down, health and connectivity rollups, outage flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.diff import signed_z, z_score

COHORT = ("service_name", "scenario")


def _placed(run_templates: DataFrame, runs: DataFrame) -> DataFrame:
    """Run templates with the number of their run in its cohort (by created_at, run_id)."""
    w = Window.partitionBy(*COHORT).orderBy("created_at", "run_id")
    r = runs.select("run_id", *COHORT, "created_at", F.row_number().over(w).alias("run_no"))
    return run_templates.drop("service_name").join(r, "run_id")


def heatmap(run_templates: DataFrame, runs: DataFrame, baseline: DataFrame, top: int = 50) -> DataFrame:
    """Cells of the ``top`` templates by total count of each cohort and all runs of the cohort: n, z (null for a novel template)."""
    p = _placed(run_templates, runs)
    totals = p.groupBy(*COHORT, "template_id").agg(F.sum("event_count").alias("_total"))
    best = totals.withColumn("_n", F.row_number().over(Window.partitionBy(*COHORT).orderBy(F.desc("_total"), "template_id"))).where(F.col("_n") <= top).drop("_n", "_total")
    cells = best.join(runs.select("run_id", *COHORT), [*COHORT]).join(p.select("run_id", "template_id", "event_count"), ["run_id", "template_id"], "left")
    n = F.coalesce("event_count", F.lit(0))
    out = cells.join(baseline.select(*COHORT, "template_id", "mean_count", "std_count"), [*COHORT, "template_id"], "left")
    return out.select(*COHORT, "run_id", "template_id", n.alias("n"), signed_z(n, F.col("mean_count"), F.col("std_count")).alias("z"), F.col("mean_count").isNull().alias("is_novel"))


def heatmap_matrix(cells: DataFrame, run_ids: list[str]) -> DataFrame:
    """Cells as one row per template with a column per run."""
    return cells.groupBy(*COHORT, "template_id").pivot("run_id", run_ids).agg(F.sum("n"))


def novelty(run_templates: DataFrame, runs: DataFrame, window: int = 5) -> DataFrame:
    """Per run the templates that none of the ``window`` runs before of its cohort had."""
    p = _placed(run_templates, runs).select(*COHORT, "run_id", "template_id", "run_no").distinct()
    before = F.lag("run_no").over(Window.partitionBy(*COHORT, "template_id").orderBy("run_no"))
    novel = before.isNull() | (F.col("run_no") - before > window)
    g = p.withColumn("_novel", novel).groupBy("run_id").agg(F.count(F.lit(1)).alias("templates_in_run"), F.count_if("_novel").alias("novel_count"))
    return g.withColumn("novelty_fraction", F.col("novel_count") / F.col("templates_in_run"))


def burndown(run_templates: DataFrame, runs: DataFrame, baseline: DataFrame, z_threshold: float = 3.0, min_count: int = 5) -> DataFrame:
    """Per run: flagged templates, new ones and fixed ones against the run before of its cohort."""
    p = _placed(run_templates, runs).join(baseline.select(*COHORT, "template_id", "mean_count", "std_count", "p95_count"), [*COHORT, "template_id"], "left")
    n = F.col("event_count")
    flag = F.when(F.col("mean_count").isNull(), n >= min_count).otherwise((n >= min_count) & (n > F.col("p95_count")) & (z_score(n, F.col("mean_count"), F.col("std_count")) > z_threshold))
    flagged = p.where(flag).select(*COHORT, "template_id", "run_no")
    w = Window.partitionBy(*COHORT, "template_id").orderBy("run_no")
    f = flagged.select("*", (~F.lag("run_no").over(w).eqNullSafe(F.col("run_no") - 1)).alias("_new"), (~F.lead("run_no").over(w).eqNullSafe(F.col("run_no") + 1)).alias("_last"))
    now = f.groupBy(*COHORT, "run_no").agg(F.count(F.lit(1)).alias("c"), F.count_if("_new").alias("n"))
    gone = f.where("_last").groupBy(*COHORT, (F.col("run_no") + 1).alias("run_no")).agg(F.count(F.lit(1)).alias("x"))
    order = Window.partitionBy(*COHORT).orderBy("created_at", "run_id")
    r = runs.select("run_id", *COHORT, F.row_number().over(order).alias("run_no"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = r.join(now, [*COHORT, "run_no"], "left").join(gone, [*COHORT, "run_no"], "left")
    return out.select("run_id", z("c").alias("current_flagged_count"), z("n").alias("new_regressions"), z("x").alias("fixed_regressions"), (z("n") - z("x")).alias("net"))


def health(findings: DataFrame) -> DataFrame:
    """Findings per service and in all (service_name null): a rollup."""
    k = lambda x: F.count_if(F.col("kind") == x)
    events = F.coalesce(F.sum(F.when(F.col("kind") == "code_error", F.col("observed_count"))), F.lit(0))
    return findings.rollup("service_name").agg(k("code_error").alias("code_error_templates"), events.alias("code_error_events"), k("new_template").alias("new_templates"), k("regressed_template").alias("regressed_templates"), k("policy_violation").alias("policy_violations"))


def latest_health(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """The same over the latest run of each service only (see ``registry.latest_runs``)."""
    return health(findings.join(latest.select("run_id").distinct(), "run_id", "left_semi"))


def connectivity(incidents: DataFrame) -> DataFrame:
    """Per service: incidents, its dependencies in order, downtime."""
    return incidents.groupBy("service_name").agg(F.count(F.lit(1)).alias("incidents"), F.array_join(F.sort_array(F.collect_set("dependency")), ", ").alias("dependencies"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("downtime_s"))


def flatten_timeline(runs: DataFrame, timeline: str = "connectivity_timeline") -> DataFrame:
    """Incidents nested in run documents (map of dependency to struct with ``incidents``) as rows."""
    deps = runs.select("run_id", "service_name", F.explode(F.map_entries(timeline)).alias("d"))
    return deps.select("run_id", "service_name", F.col("d.key").alias("dependency"), F.explode("d.value.incidents").alias("i")).select("run_id", "service_name", "dependency", "i.*")
