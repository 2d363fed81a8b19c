"""The batch scan: files to events, templates, errors, restarts, outages and a summary."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text
from logweave.operators import classify, drain, ingest, sequences, templates
from logweave.session import materialised
from logweave.sources import files

BY = ["source"]


@dataclass
class Scan:
    """Lazily composed results of a scan."""

    run_id: str
    service: str
    events: DataFrame
    templates: DataFrame
    errors: DataFrame
    instances: DataFrame
    incidents: DataFrame
    clusters: DataFrame | None


def scan_events(events: DataFrame, run_id: str, service: str, rules: dict = classify.DEFAULT_RULES, baseline_ids: DataFrame | None = None, instances: str | int = "all", mine: bool = True, drain_state: DataFrame | None = None) -> Scan:
    """Scan of typed events (in file order by source and offset)."""
    ev = events.withColumn("_us", (text.epoch_seconds(F.col("timestamp")) * 1_000_000).cast("long"))
    boot = sequences.boots(ev, BY, "offset", "_us")
    ev = sequences.with_instances(ev.drop("service_instance_seq"), boot, BY, "offset")
    ev = ev.withColumn("service_instance_started_at", F.date_format(F.timestamp_micros("service_instance_started_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    ev = sequences.keep_instances(ev, boot, BY, instances)
    kind = classify.issue_kind(F.coalesce(templates.filled("normalized_template"), F.col("body")), F.col("exception_type"), F.col("error_kind"), F.col("severity_text"))
    ev = ev.withColumn("issue_kind", kind)
    clusters = None
    if mine:
        clusters = drain.mine(templates.aggregate_templates(ev), drain_state)
        ev = templates.remap_templates(ev, clusters)
    tpl = classify.classify_templates(templates.aggregate_templates(ev), baseline_ids, rules)
    if clusters is not None:
        names = clusters.groupBy(F.col("canonical_template_id").alias("_c")).agg(F.max("drain_template").alias("_t"))
        tpl = tpl.join(names, F.col("template_id") == F.col("_c"), "left").withColumn("normalized_template", F.coalesce("_t", "normalized_template")).drop("_c", "_t")
    full = templates.with_template_attributes(ev, tpl, {"classification": "unclassified", "classification_reason": None, "issue_kind": "unknown"})
    marks = sequences.connectivity_marks(ev.withColumnRenamed("_us", "ts_us"), ["source", "offset", "ts_us"])
    incidents = sequences.connectivity_incidents(marks, BY, "offset")
    return Scan(run_id, service, full.drop("_us", "service_instance_started_us"), tpl, tpl.where(classify.error_predicate()), sequences.instance_counts(ev, BY), incidents, clusters)


def scan(spark: SparkSession, inputs: list[str], service: str = "default", run_id: str | None = None, include_raw: bool = False, strict: bool = False, stage: str | None = None, **options) -> Scan:
    """Scan of log files.

    The decoded events are written once, to ``stage`` or a checkpoint: the many
    results of a scan then read them from there and do not parse the files
    again, and no filter on a derived column is pushed into the parsing.
    """
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    run_id = run_id or f"run_{now.replace(':', '').replace('-', '')}"
    lines = files.read_lines(spark, files.resolve_inputs(inputs))
    events = ingest.decode(ingest.records(lines), service, run_id, now, include_raw, strict)
    if stage:
        files.write_table(events, stage)
        events = spark.read.parquet(stage)
    else:
        events = materialised(events)
    return scan_events(events, run_id, service, **options)


def summary(s: Scan) -> dict:
    """Counts of a scan: one row per count reaches the driver."""
    counts = {f"{c}_counts": {} for c in ("severity_text", "issue_kind", "parse_status", "classification")}
    for r in templates.value_counts(s.events, [c.removesuffix("_counts") for c in counts]).collect():
        counts[f"{r.column_name}_counts"][r.value or ""] = r.n
    row = s.templates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("e"), F.count_if(classify.error_predicate()).alias("x")).first()
    return {"run_id": s.run_id, "service_name": s.service, "event_count": row.e, "template_count": row.n, "error_count": row.x, **counts}


def write(s: Scan, out: str) -> dict:
    """events, templates, errors, instances, incidents as Parquet; run.json and report.md beside them."""
    from logweave.plans import reports

    os.makedirs(out, exist_ok=True)
    for name in ("events", "templates", "errors", "instances", "incidents"):
        files.write_table(getattr(s, name), f"{out}/{name}.parquet")
    spark = s.events.sparkSession
    read = lambda n: spark.read.parquet(f"{out}/{n}.parquet")
    done = Scan(s.run_id, s.service, *(read(n) for n in ("events", "templates", "errors", "instances", "incidents")), None)
    meta = summary(done) | {"created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "engine": "spark", "scenario_source": s.run_id}
    with open(f"{out}/run.json", "w") as f:
        json.dump(meta, f, indent=2, sort_keys=True)
    with open(f"{out}/report.md", "w") as f:
        f.write(reports.scan_report(meta, done))
    return meta
