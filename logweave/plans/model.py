"""Frames that several queries start from, each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators.instants import clean_name
from logweave.sources.tables import table

# ---- log lines derived from the `events` table: what restarts, outages and co-occurrence need (the typed log events hold none)
#: Messages by event type and number; the order is the precedence.
_MESSAGES = (
    ("event_type = 'signup' and event_id % 40 = 0", "'Starting gunicorn 21.2 for tenant ' || cast(user_id as {s})"),
    ("event_type = 'view' and event_id % 30 = 0", "'Booting worker with pid: ' || cast(1000 + event_id % 9000 as {s})"),
    ("event_type = 'error' and event_id % 9 = 0", "'kafka: 3/3 brokers are down, retry ' || cast(event_id % 7 as {s})"),
    ("event_type = 'error' and event_id % 11 = 0", "'ServerSelectionTimeoutError on mongo replica ' || substr(md5(cast(event_id as {s})), 1, 24)"),
    ("event_type = 'error' and event_id % 13 = 0", "'elasticsearch node unreachable at 10.2.' || cast(event_id % 250 as {s}) || '.7:9200'"),
    ("event_type = 'error'", "'ValueError: bad account ' || substr(md5(cast(event_id as {s})), 1, 24)"),
    ("event_type = 'purchase' and event_id % 5 = 0", "'rejoined group orders generation ' || cast(event_id % 50 as {s})"),
    ("event_type = 'purchase' and event_id % 7 = 0", "'Connected to mongo primary after ' || cast(event_id % 90 as {s}) || ' ms'"),
    ("event_type = 'purchase' and event_id % 8 = 0", "'elasticsearch cluster ready with ' || cast(event_id % 9 as {s}) || ' nodes'"),
    ("event_type = 'purchase'", "'order ' || md5(cast(event_id as {s})) || ' paid by user_' || substr(md5(cast(user_id as {s})), 1, 12) || ' amount=' || cast(cast(round(value * 100) as bigint) as {s})"),
    ("event_type = 'click'", "'GET https://shop.example/item/' || cast(event_id % 97 as {s}) || ' from 10.0.' || cast(user_id % 250 as {s}) || '.4:8080 slow'"),
)


def _line_columns(s: str, micros: str, day: str) -> dict[str, str]:
    """The derived columns as SQL expressions both engines know; ``s`` is the name of the string type."""
    cases = " ".join(f"when {c} then {m.format(s=s)}" for c, m in _MESSAGES)
    return {
        "event_id": "event_id", "service_name": f"'svc-' || cast(user_id % 5 as {s})", "worker_id": f"'w' || cast(user_id % 8 as {s})",
        "severity_text": "case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' when 'view' then 'DEBUG' else 'INFO' end",
        "ts_us": micros, "run_id": f"'E2E_' || case user_id % 2 when 0 then 'checkout' else 'browse' end || '_' || {day}", "source": "'events'", "line_offset": "event_id",
        "body": f"case {cases} else 'viewed /srv/pages/' || cast(event_id % 31 as {s}) || '/index in ' || cast(event_id % 400 as {s}) || ' ms' end",
    }


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log events derived from ``events``: event_id (also the offset), service, worker, severity, ts_us, run_id, body."""
    exprs = _line_columns("string", "unix_micros(cast(ts as timestamp))", "date_format(ts, 'yyyyMMdd')")
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value").selectExpr(*[f"{e} as {n}" for n, e in exprs.items()])


LINES_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _line_columns("varchar", "epoch_us(ts)", "strftime(ts, '%Y%m%d')").items()) + " from events"


# ---- typed log events
def log_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """log_events with the service name trimmed and in lower case."""
    df = table(spark, folder, "log_events", *columns)
    return df.withColumn("service_name", clean_name("service_name")) if "service_name" in df.columns else df


EVENTS_SQL = "select * replace (lower(trim(service_name)) as service_name) from log_events"


def run_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of each run: counts and the static columns of the first event in file order."""
    df = log_events(spark, folder, "run_id", "service_name", "template_id", "severity_text", "normalized_template", "issue_kind", "error_kind", "exception_type", "source", "offset")
    first = F.min_by(F.struct("service_name", "severity_text", "normalized_template", "issue_kind", "error_kind", "exception_type"), F.struct("source", "offset"))
    g = df.where("template_id is not null and run_id is not null").groupBy("run_id", "template_id").agg(F.count(F.lit(1)).alias("event_count"), first.alias("f"))
    return g.select("run_id", "template_id", "event_count", "f.*")


RUN_TEMPLATES_SQL = f"""select run_id, template_id, event_count, f.* from (
  select run_id, template_id, count(*) event_count, arg_min(struct_pack(service_name := service_name, severity_text := severity_text, normalized_template := normalized_template,
    issue_kind := issue_kind, error_kind := error_kind, exception_type := exception_type), struct_pack(a := source, b := "offset")) f
  from ({EVENTS_SQL}) where template_id is not null and run_id is not null group by run_id, template_id)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with scenario and status; a null status is that of the counts (no events: unknown; errors or outages: red)."""
    df = table(spark, folder, "runs", "run_id", "service_name", "created_at", "status", "event_count", "error_count", "connectivity_incident_count", "connectivity_total_downtime_s")
    derived = F.when(F.col("event_count") == 0, "unknown").when((F.col("error_count") == 0) & (F.col("connectivity_incident_count") == 0), "green").otherwise("red")
    return df.withColumn("service_name", clean_name("service_name")).withColumn("scenario", T.scenario(F.col("run_id"))).withColumn("status", F.coalesce("status", derived))


_SCENARIO = "case when lower(regexp_extract(run_id, '(?i)^E2E_([A-Za-z0-9]+)', 1)) <> '' then lower(regexp_extract(run_id, '(?i)^E2E_([A-Za-z0-9]+)', 1)) when regexp_matches(run_id, '(?i)^BENCH[_-]') then 'bench' else 'default' end"
RUNS_SQL = f"""select run_id, lower(trim(service_name)) service_name, created_at, event_count, error_count, connectivity_incident_count, connectivity_total_downtime_s, {_SCENARIO} scenario,
  coalesce(status, case when event_count = 0 then 'unknown' when error_count = 0 and connectivity_incident_count = 0 then 'green' else 'red' end) status from runs"""
