"""Run comparison, diffs against the baseline, overrides, verdicts and template lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text
from logweave.operators.classify import ERROR_LEVELS, error_predicate

SAFE_LEVELS = ("INFO", "DEBUG", "NOTICE")
# Order of severities for shifts.
LEVEL_ORDER = {"DEBUG": 0, "INFO": 1, "NOTICE": 2, "WARN": 3, "WARNING": 3, "ERROR": 4, "CRITICAL": 5, "FATAL": 5}
KEY = ("run_id", "service_name", "scenario", "template_id")
#: Stand-in for infinity in results that are compared between engines.
INFINITE = 1e308


def z_score(count: Column, mean: Column, std: Column) -> Column:
    """Standard score; with no spread infinite above the mean and 0 else."""
    return F.when(std > 1e-9, (count - mean) / std).when(count > mean, INFINITE).otherwise(0.0)


def signed_z(count: Column, mean: Column, std: Column) -> Column:
    """The same with minus infinity below the mean; null without baseline."""
    return F.when(std.isNull(), F.lit(None)).when(std >= 1e-9, (count - mean) / std).when(count == mean, 0.0).when(count > mean, INFINITE).otherwise(-INFINITE)


def delta_factor(count: Column, mean: Column) -> Column:
    return F.when(mean > 0, count / mean).when(count > 0, INFINITE).otherwise(1.0)


def compare_runs(left: DataFrame, right: DataFrame, ratio: float = 2.0, min_count: int = 5, rise: int | None = None) -> DataFrame:
    """Templates of two runs: ``new`` and ``fixed`` ones with errors (a failing severity, an error kind, or classified unexpected or a regression), and common ones whose count grew by ``ratio`` and by ``rise``, if not given ``min_count``, events at least (kind ``frequency``)."""
    rise = min_count if rise is None else rise
    classed = lambda d: d if "classification" in d.columns else d.withColumn("classification", F.lit(None).cast("string"))
    left, right = (classed(d).withColumn("_failing", error_predicate(("unexpected", "regression"), fold=True)) for d in (left, right))
    failing = lambda p: F.col(f"{p}._failing")
    j = left.alias("l").join(right.alias("r"), F.col("l.template_id") == F.col("r.template_id"), "full")
    before, after = F.col("l.event_count"), F.col("r.event_count")
    kind = F.when(before.isNull() & failing("r"), "new").when(after.isNull() & failing("l"), "fixed").when((after >= min_count) & (after >= F.greatest(before * ratio, before + rise)), "frequency")
    return j.select(F.coalesce("r.template_id", "l.template_id").alias("template_id"), kind.alias("kind"), F.coalesce(before, F.lit(0)).alias("left_count"), F.coalesce(after, F.lit(0)).alias("right_count")).where("kind is not null")


def diff_findings(run_templates: DataFrame, runs: DataFrame, baseline: DataFrame, z_threshold: float = 3.0, min_count: int = 5) -> DataFrame:
    """Findings of every run against the baseline of its cohort, one tall table: run_id, service_name, scenario, template_id, kind, ....

    Kinds: new_template, missing_template, regressed_template,
    severity_shifted, code_error.  Columns a kind has not are null.  Joins are
    on (service, scenario, template) or, for what is missing, on the cohort.
    """
    r = runs.select("run_id", F.col("service_name").alias("_service"), "scenario")
    seen = run_templates.drop("service_name").join(r, "run_id").withColumnRenamed("_service", "service_name")
    cohort = ["service_name", "scenario"]
    b = baseline.select(*cohort, "template_id", F.col("severity_text").alias("base_severity"), "mean_count", "std_count", "p95_count", "runs_in_baseline")
    j = seen.join(b, [*cohort, "template_id"], "left")
    count, mean, std = F.col("event_count"), F.col("mean_count"), F.col("std_count")
    known = mean.isNotNull()
    z = z_score(count, mean, std)
    hit = known & (count >= min_count) & (count > F.col("p95_count")) & (z > z_threshold)
    shift = known & (F.col("severity_text") != "") & (F.col("base_severity") != "") & (F.col("severity_text") != F.col("base_severity"))
    code = (F.col("issue_kind") == "code") & F.upper("severity_text").isin(*ERROR_LEVELS) & (count > 0)
    kinds = F.array(F.when(~known, F.lit("new_template")), F.when(hit, F.lit("regressed_template")), F.when(shift, F.lit("severity_shifted")), F.when(code, F.lit("code_error")))
    found = j.select(*KEY, F.explode(kinds).alias("kind"), "severity_text", "base_severity", count.alias("observed_count"), "mean_count", delta_factor(count, mean).alias("delta_factor"), z.alias("z_score")).where("kind is not null")
    regressed = F.col("kind") == "regressed_template"
    found = found.withColumn("delta_factor", F.when(regressed, F.col("delta_factor"))).withColumn("z_score", F.when(regressed, F.col("z_score")))
    expected = r.withColumnRenamed("_service", "service_name").join(b, cohort)
    absent = expected.join(seen.select("run_id", "template_id"), ["run_id", "template_id"], "left_anti")
    missing = absent.select(*KEY, F.lit("missing_template").alias("kind"), F.lit(None).cast("string").alias("severity_text"), "base_severity", F.lit(None).cast("long").alias("observed_count"), "mean_count", F.lit(None).cast("double").alias("delta_factor"), F.lit(None).cast("double").alias("z_score"))
    return found.unionByName(missing)


def first_anomalies(run_templates: DataFrame, runs: DataFrame, baseline: DataFrame, z_threshold: float = 3.0, min_count: int = 5, novelty_min: int = 3) -> DataFrame:
    """The number of the event with which each template of a run first passes the tests of the streaming detector: run_id, service_name, scenario, template_id, kind, event_no, ....

    The tests grow with the running count, so the first event that passes all
    is computed from the baseline, not looked for.  A template that is not in
    the baseline of its cohort, or whose run is not known, is a new one.
    """
    cohort = ["service_name", "scenario"]
    j = run_templates.drop(*cohort).join(runs.select("run_id", *cohort), "run_id", "left").join(baseline.select(*cohort, "template_id", "mean_count", "std_count", "p95_count"), [*cohort, "template_id"], "left")
    mean, std = F.col("mean_count"), F.col("std_count")
    passes = lambda n: z_score(n, mean, std) > z_threshold
    # the test itself decides between the neighbours of its bound, which is rounded
    n = F.floor(F.when(std > 1e-9, mean + std * z_threshold).otherwise(mean))
    over_z = F.when(passes(n), n).when(passes(n + 1), n + 1).otherwise(n + 2)
    at = F.when(mean.isNull(), F.lit(novelty_min)).otherwise(F.greatest(F.lit(min_count).cast("long"), F.floor("p95_count") + 1, over_z)).cast("long")
    hit = j.withColumn("event_no", at).where(F.col("event_count") >= F.col("event_no"))
    kind = F.when(mean.isNull(), "new_template").otherwise("regression")
    z = F.when(mean.isNotNull(), z_score(F.col("event_no"), mean, std))
    return hit.select("run_id", *cohort, "template_id", kind.alias("kind"), "event_no", mean.alias("baseline_mean"), F.col("p95_count").alias("baseline_p95"), z.alias("z_score"))


def apply_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings after decisions (service_name, scenario, template_id, decision): pinned and banned templates are no new ones;
    banned ones that were observed are policy violations, pinned ones that were not are pinned_missing.

    As observed count the templates of a run's findings (a stable one counts as
    not observed).  Of several decisions for a key the smallest holds.
    """
    cohort = ["service_name", "scenario"]
    o = overrides.groupBy(*cohort, "template_id").agg(F.min("decision").alias("_decision"))
    joined = findings.join(o, [*cohort, "template_id"], "left")
    kept = joined.where(~((F.col("kind") == "new_template") & F.coalesce(F.col("_decision").isin("pinned", "banned"), F.lit(False)))).drop("_decision")
    observed = findings.where("kind <> 'missing_template'").groupBy(*KEY).agg(F.max("observed_count").alias("observed_count"), F.min("severity_text").alias("severity_text"))
    none = lambda t: F.lit(None).cast(t)
    fill = {"base_severity": none("string"), "mean_count": none("double"), "delta_factor": none("double"), "z_score": none("double")}
    banned = observed.join(o.where("_decision = 'banned'").drop("_decision"), [*cohort, "template_id"]).withColumn("kind", F.lit("policy_violation")).withColumns(fill)
    runs = findings.select("run_id", *cohort).distinct()
    pinned = runs.join(o.where("_decision = 'pinned'").drop("_decision"), cohort).join(observed.select("run_id", "template_id"), ["run_id", "template_id"], "left_anti")
    pinned = pinned.withColumn("kind", F.lit("pinned_missing")).withColumns({**fill, "observed_count": none("long"), "severity_text": none("string")})
    return kept.unionByName(banned.select(*kept.columns)).unionByName(pinned.select(*kept.columns))


def _level(c: str) -> Column:
    out = F.lit(0)
    for name, n in LEVEL_ORDER.items():
        out = F.when(F.upper(F.col(c)) == name, n).otherwise(out)
    return out


def diff_summary(findings: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Counts of findings and the verdict: ``no-change``, ``unsafe`` or ``safe``."""
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = {"new": "new_template", "missing": "missing_template", "regressed": "regressed_template", "severity_shifted": "severity_shifted", "code_errors": "code_error", "policy_violations": "policy_violation"}
    risky = F.count_if((F.col("kind") == "new_template") & (F.coalesce("severity_text", F.lit("")) != "") & ~F.upper("severity_text").isin(*SAFE_LEVELS))
    up = F.count_if((F.col("kind") == "severity_shifted") & (_level("severity_text") > _level("base_severity")))
    g = findings.groupBy(*by).agg(*[n(k).alias(c) for c, k in counts.items()], F.coalesce(F.sum(F.when(F.col("kind") == "code_error", F.col("observed_count"))), F.lit(0)).alias("code_error_events"), risky.alias("_risky"), up.alias("_up"))
    some = F.greatest(*[F.col(c) for c in counts]) > 0
    unsafe = (F.col("code_errors") > 0) | (F.col("policy_violations") > 0) | (F.col("regressed") > 0) | (F.col("_up") > 0) | (F.col("_risky") > 0)
    return g.withColumn("verdict", F.when(~some, "no-change").when(unsafe, "unsafe").otherwise("safe")).drop("_risky", "_up")


def overrides_for(overrides: DataFrame, service: str, scenario: str) -> DataFrame:
    """Decisions on the templates of one service and scenario."""
    return overrides.where((F.col("service_name") == service) & (F.col("scenario") == scenario))


def set_override(overrides: DataFrame, service: str, scenario: str, template: str, decision: str | None, reason: str = "", set_by: str = "", set_at: str = "") -> DataFrame:
    """Overrides with one key set, or cleared for a null decision."""
    if decision not in (None, "pinned", "banned"):
        raise ValueError(f"decision must be 'pinned', 'banned' or None, not {decision!r}")
    rest = overrides.where(~((F.col("service_name") == service) & (F.col("scenario") == scenario) & (F.col("template_id") == template)))
    if decision is None:
        return rest
    row = overrides.sparkSession.createDataFrame([(service, scenario, template, decision, reason, set_by, set_at)], "service_name string, scenario string, template_id string, decision string, reason string, set_by string, set_at string")
    return rest.unionByName(row, allowMissingColumns=True)


def similar_pairs(left: DataFrame, right: DataFrame, min_similarity: float, group: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, similarity) of texts (id, text, group..) with the same group and a Jaccard similarity of words and word pairs above the bound.

    Candidates share one of the rarest shingles of both sides (prefix
    filtering): two sets as similar as that must, and frequent shingles, which
    would pair everything, are hardly ever among the rarest.
    """
    prep = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), *[F.col(g) for g in group], text.shingles(F.col("text")).alias(f"{p}_sh"))
    a, b = prep(left, "left"), prep(right, "right")
    words = a.select(*group, F.explode("left_sh").alias("w")).unionByName(b.select(*group, F.explode("right_sh").alias("w")))
    freq = words.groupBy(*group, "w").agg(F.count(F.lit(1)).alias("f"))

    def prefixes(d: DataFrame, p: str) -> DataFrame:
        e = d.select(f"{p}_id", *group, F.size(f"{p}_sh").alias("n"), F.explode(f"{p}_sh").alias("w")).join(freq, [*group, "w"])
        rank = F.row_number().over(Window.partitionBy(f"{p}_id", *group).orderBy("f", "w"))
        return e.withColumn("_r", rank).where(F.col("_r") <= F.col("n") - F.ceil(F.lit(min_similarity) * F.col("n")) + 1).select(f"{p}_id", *group, "w")

    cand = prefixes(a, "left").join(prefixes(b, "right"), [*group, "w"]).where("left_id <> right_id").select("left_id", "right_id", *group).distinct()
    full = cand.join(a, ["left_id", *group]).join(b, ["right_id", *group])
    return full.withColumn("similarity", text.jaccard(F.col("left_sh"), F.col("right_sh"))).where(F.col("similarity") > min_similarity).select("left_id", "right_id", *group, "similarity")


def predecessors(new: DataFrame, base: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """Most similar baseline template of the same severity for each new one (template_id, normalized_template, severity_text); of equal ones the smallest id."""
    side = lambda d: d.select(F.col("template_id").alias("id"), F.col("normalized_template").alias("text"), "severity_text").distinct()
    pairs = similar_pairs(side(new), side(base), min_similarity, ("severity_text",))
    w = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("left_id").alias("template_id"), F.col("right_id").alias("predecessor_template_id"), F.col("similarity").alias("similarity_score"))


def most_similar(templates: DataFrame, query: str, k: int = 5, min_similarity: float = 0.0) -> DataFrame:
    """The k templates most like a text."""
    q = text.shingles(F.lit(query))
    return templates.withColumn("similarity", text.jaccard(text.shingles(F.col("normalized_template")), q)).where(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), "template_id").limit(k)


def with_lineage(findings: DataFrame, texts: DataFrame, baseline: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """Findings with predecessor_template_id and similarity_score; a new template with a predecessor is an ``evolved_template``.

    texts: (run_id, template_id, normalized_template).  The predecessor is the
    most similar baseline template of the same cohort and severity, of equal
    ones that with the smallest id.
    """
    group = ("service_name", "scenario", "severity_text")
    new = findings.where("kind = 'new_template'").select("run_id", *group, "template_id").join(texts.select("run_id", "template_id", "normalized_template"), ["run_id", "template_id"])
    side = lambda d: d.select(F.col("template_id").alias("id"), F.col("normalized_template").alias("text"), *group).distinct()
    pairs = similar_pairs(side(new), side(baseline), min_similarity, group)
    w = Window.partitionBy("left_id", *group).orderBy(F.desc("similarity"), "right_id")
    best = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*group, F.col("left_id").alias("template_id"), F.lit("new_template").alias("kind"), F.col("right_id").alias("predecessor_template_id"), F.col("similarity").alias("similarity_score"))
    out = findings.join(best, [*group, "template_id", "kind"], "left")
    return out.withColumn("kind", F.when(F.col("predecessor_template_id").isNotNull(), "evolved_template").otherwise(F.col("kind")))


def connectivity_findings(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """All incidents of a run as findings of kind ``connectivity_regression``."""
    r = runs.select("run_id", F.col("service_name").alias("_service"), "scenario")
    return incidents.drop("service_name").join(r, "run_id").select("run_id", F.col("_service").alias("service_name"), "scenario", F.lit("connectivity_regression").alias("kind"), "dependency", "down_at", "up_at", "duration_seconds")


def editor_universe(templates: DataFrame, baseline: DataFrame, overrides: DataFrame) -> DataFrame:
    """Templates of a run, a baseline and overrides (all with service_name, scenario, template_id): where each is known, and the first text and severity."""
    key = ["service_name", "scenario", "template_id"]
    t = templates.groupBy(*key).agg(F.min(F.struct("normalized_template", "severity_text")).alias("_t"), F.sum("event_count").alias("observed_count"))
    b = baseline.select(*key, F.struct("normalized_template", "severity_text").alias("_b"), "mean_count")
    o = overrides.groupBy(*key).agg(F.min("decision").alias("decision"))
    j = t.join(b, key, "full").join(o, key, "full")
    first = lambda c: F.coalesce(F.col(f"_t.{c}"), F.col(f"_b.{c}")).alias(c)
    return j.select(*key, first("normalized_template"), first("severity_text"), "observed_count", "mean_count", "decision")
