"""Queries of the log-analytics operators over whole tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import ids, text, text_sql
from logweave.operators import classify, dashboards, diff, drain, graph, registry, sequences, templates
from logweave.operators.instants import clean_name
from logweave.plans import model
from logweave.session import materialised
from logweave.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

MIN_GREEN = 1
BY = ["service_name"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ------------------------------------------------------------------ text


@query(f"""select event_id, "offset" line_offset, t normalized from ({text_sql.normalized("log_events", "body", 'event_id, "offset"')})""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of all bodies."""
    df = text.with_normalized(spread(table(spark, folder, "log_events", "event_id", "offset", "body")), "body", "normalized")
    return df.select("event_id", F.col("offset").alias("line_offset"), "normalized")


_IDENT = f"""with n as ({text_sql.normalized(f"({model.EVENTS_SQL})", "body", 'event_id, "offset", service_name, severity_text, body')}),
f as (select event_id, t first_t from ({text_sql.normalized(f"(select event_id, {text_sql.first_line('body')} line from log_events where contains(body, chr(10)))", "line", "event_id")}) group by all),
h as (select n.*, {text_sql.cut_headline("coalesce(f.first_t, n.t)")} headline, {text_sql.exception_type("body")} exc from n left join f using (event_id))"""


@query(f"""{_IDENT} select event_id, "offset" line_offset, headline, md5(coalesce(service_name, '') || chr(31) || coalesce(severity_text, '') || chr(31) || coalesce(headline, '') || chr(31)) template_id,
  exc exception_type, {text_sql.error_kind("body", "severity_text", "exc")} error_kind from h""")
def template_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Headline, stable template id, exception class and error kind of every event."""
    df = templates.identify(spread(model.log_events(spark, folder, "event_id", "offset", "service_name", "severity_text", "body")))
    return df.select("event_id", F.col("offset").alias("line_offset"), "headline", "template_id", "exception_type", "error_kind")


@query("""select event_id, "offset" line_offset, case when s = 'WARN' then 'WARNING' when s in ('TRACE','DEBUG','INFO','WARNING','ERROR','CRITICAL','FATAL') then s else 'INFO' end severity,
  cast(case s when 'TRACE' then 1 when 'DEBUG' then 5 when 'WARNING' then 13 when 'ERROR' then 17 when 'CRITICAL' then 21 when 'FATAL' then 21 else 9 end as bigint) severity_no,
  case when contains(x, 'gunicorn') then 'gunicorn' when contains(x, 'granian') then 'granian' when contains(x, 'kafka') then 'kafka' when contains(x, 'mongo') then 'mongo' when contains(x, 'chroot') then 'chroot' end kind,
  lower(regexp_replace(regexp_replace(source, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) slug,
  case when length(o) > 140 then substring(o, 1, 139) || '…' else o end sample,
  md5(coalesce(run_id, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(cast("offset" as varchar), '') || chr(31) || md5(regexp_replace(body, chr(27) || '\\[[0-9;]*m', '', 'g'))) stable_event_id
from (select *, severity_text s, lower(concat_ws(' ', body, server_kind, service_name)) x, trim(regexp_replace(body, '\\s+', ' ', 'g')) o from log_events)""")
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical severity and its number, server kind, slug, sample, stable event id."""
    df = table(spark, folder, "log_events", "event_id", "run_id", "offset", "severity_text", "body", "server_kind", "service_name", "source")
    sev = text.canonical_severity(F.col("severity_text"))
    return df.select(
        "event_id", F.col("offset").alias("line_offset"), sev.alias("severity"), text.severity_number(F.col("severity_text")).alias("severity_no"),
        text.server_kind(F.concat_ws(" ", "body", "server_kind"), F.col("service_name")).alias("kind"), text.slug(F.col("source")).alias("slug"), text.trim_sample(F.col("body")).alias("sample"),
        ids.event_id(F.col("run_id"), F.col("source"), F.col("offset"), ids.stable_id(text.strip_ansi(F.col("body")))).alias("stable_event_id"),
    )


@query(f"""select event_id, "offset" line_offset, {text_sql.epoch_seconds("timestamp")} epoch_s, strftime(date_trunc('minute', make_timestamp(cast(floor(({text_sql.epoch_seconds("timestamp")}) * 1000000) as bigint))), '%Y-%m-%dT%H:%M') as minute,
  greatest(({text_sql.epoch_seconds("observed_timestamp")}) - ({text_sql.epoch_seconds("timestamp")}), 0.0) lag_s from log_events""")
def time_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Epoch seconds, minute and delivery lag of ISO timestamps."""
    df = table(spark, folder, "log_events", "event_id", "offset", "timestamp", "observed_timestamp")
    ts = text.epoch_seconds(F.col("timestamp"))
    lag = text.epoch_seconds(F.col("observed_timestamp")) - ts
    minute = F.date_format(F.date_trunc("minute", F.timestamp_micros(F.floor(ts * 1_000_000).cast("long"))), "yyyy-MM-dd'T'HH:mm")
    return df.select("event_id", F.col("offset").alias("line_offset"), ts.alias("epoch_s"), minute.alias("minute"), F.when(lag.isNotNull(), F.greatest(lag, F.lit(0.0))).alias("lag_s"))


SQL["time_functions"] = SQL["time_functions"].replace("greatest((", "case when (" + text_sql.epoch_seconds("observed_timestamp") + ") is not null and (" + text_sql.epoch_seconds("timestamp") + ") is not null then greatest((").replace(", 0.0) lag_s", ", 0.0) end lag_s")


@query("""select event_id, "offset" line_offset, json_extract_string(attributes_json, '$."code.location"') code_location, json_extract_string(attributes_json, '$."code.function"') code_function, coalesce(resource_json, '{}') resource from log_events""")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON texts by literal key."""
    df = table(spark, folder, "log_events", "event_id", "offset", "attributes_json", "resource_json")
    get = lambda k: F.when(F.get_json_object("attributes_json", f"$['{k}']") != "", F.get_json_object("attributes_json", f"$['{k}']"))
    return df.select("event_id", F.col("offset").alias("line_offset"), get("code.location").alias("code_location"), get("code.function").alias("code_function"), F.coalesce("resource_json", F.lit("{}")).alias("resource"))


# ------------------------------------------------------------------ templates and counts

_TEMPLATES = f"""select template_id, count(*) event_count, min(seen) first_seen, max(seen) last_seen, arg_min(f, k) f,
  case max(case parse_status when 'ok' then 1 when 'degraded' then 2 when 'failed' then 3 else 0 end) when 2 then 'degraded' when 3 then 'failed' else 'ok' end parse_status
from (select template_id, coalesce(nullif(timestamp, ''), nullif(observed_timestamp, '')) seen, parse_status, struct_pack(a := source, b := "offset") k,
  struct_pack(example_event_id := event_id, service_name := service_name, severity_text := severity_text, severity_number := severity_number, normalized_template := normalized_template, error_kind := error_kind, exception_type := exception_type, issue_kind := issue_kind) f
  from ({model.EVENTS_SQL}) where template_id is not null) group by template_id"""
TEMPLATES_SQL = f"select template_id, event_count, first_seen, last_seen, f.*, parse_status from ({_TEMPLATES})"


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    cols = ("event_id", "template_id", "timestamp", "observed_timestamp", "parse_status", "source", "offset", *templates.STATIC)
    return templates.aggregate_templates(model.log_events(spark, folder, *cols))


@query(TEMPLATES_SQL)
def template_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return _templates(spark, folder)


@query(f"select template_id, event_count, normalized_template from ({TEMPLATES_SQL}) order by event_count desc, template_id limit 20")
def top_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.top_templates(_templates(spark, folder)).select("template_id", "event_count", "normalized_template")


_COUNTED = ("severity_text", "issue_kind", "parse_status", "parse_format", "error_kind")


@query(" union all ".join(f"select '{c}' column_name, {c} as value, count(*) n from log_events group by {c}" for c in _COUNTED))
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return templates.value_counts(table(spark, folder, "log_events", *_COUNTED), _COUNTED)


_RUNTIME = {"pids": "process_pid", "processes": "process_name", "threads": "thread_name", "workers": "worker_id", "containers": "container_id", "pods": "k8s_pod_name", "server_kinds": "server_kind", "instances": "service_instance_id"}


@query("select " + ", ".join(f"count(distinct case when trim(cast({c} as varchar)) not in ('', '-') then {c} end) {n}" for n, c in _RUNTIME.items()) + " from log_events")
def runtime_counts(spark: SparkSession, folder: str) -> DataFrame:
    return templates.runtime_counts(table(spark, folder, "log_events", *_RUNTIME.values()), _RUNTIME)


# ------------------------------------------------------------------ classification

_ANY = lambda c, ps: "(" + " or ".join(f"regexp_matches({c}, {text_sql.quoted(p)})" for p in ps) + ")"
_IN = lambda xs: "(" + ", ".join(map(text_sql.quoted, xs)) + ")"
_ISSUE = f"""case when exception_type in {_IN(classify.INFRA_EXCEPTIONS)} then 'infra' when exception_type in {_IN(classify.CODE_EXCEPTIONS)} then 'code'
  when {_ANY("coalesce(msg, '')", classify.INFRA_PATTERNS)} then 'infra' when {_ANY("coalesce(msg, '')", classify.CODE_PATTERNS)} then 'code'
  when error_kind = 'traceback' then 'code' when upper(severity_text) in ('ERROR','CRITICAL','FATAL') then 'code' else 'unknown' end"""


@query(f"""select event_id, "offset" line_offset, {_ISSUE} computed_kind from (select *, coalesce(nullif(normalized_template, ''), body) msg from log_events)""")
def issue_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Issue kind of every event from exception, message and severity."""
    df = table(spark, folder, "log_events", "event_id", "offset", "normalized_template", "body", "exception_type", "error_kind", "severity_text")
    msg = F.coalesce(templates.filled("normalized_template"), F.col("body"))
    return df.select("event_id", F.col("offset").alias("line_offset"), classify.issue_kind(msg, F.col("exception_type"), F.col("error_kind"), F.col("severity_text")).alias("computed_kind"))


_FIRST_RULES = lambda rules: "case " + " ".join(
    f"when upper(severity_text) in {_IN(r['severity'])} and "
    + (f"regexp_matches(coalesce(normalized_template, ''), {text_sql.quoted(r['template_regex'])})" if "template_regex" in r else f"contains(coalesce(normalized_template, ''), {text_sql.quoted(r['template_contains'])})")
    + f" then {text_sql.quoted(r['reason'])}"
    for r in rules
) + " end"
#: As baseline the templates of the latest snapshot of the registry.
_BASE_IDS = "select distinct lower(trim(template_id)) template_id from template_registry where template_id is not null and snapshot_no = (select max(snapshot_no) from template_registry)"
CLASSIFIED_SQL = f"""select t.*, m baseline_match,
  case when noise is not null then 'known-noise' when exp is not null or m then 'expected' when failing then 'unexpected' else 'observed' end classification,
  coalesce(noise, exp, case when m then '{classify.REASONS["baseline"]}' when failing then '{classify.REASONS["unexpected"]}' else '{classify.REASONS["observed"]}' end) classification_reason
from (select t.*, {_FIRST_RULES(classify.DEFAULT_RULES["known_noise"])} noise, {_FIRST_RULES(classify.DEFAULT_RULES["expected"])} exp, template_id in ({_BASE_IDS}) m,
  upper(severity_text) in ('ERROR','CRITICAL','FATAL') or coalesce(error_kind, '') not in ('', 'none') failing from ({TEMPLATES_SQL}) t) t"""


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    reg = table(spark, folder, "template_registry", "template_id", "snapshot_no")
    last = reg.agg(F.max("snapshot_no").alias("m"))
    base = reg.join(F.broadcast(last), F.col("snapshot_no") == F.col("m")).where("template_id is not null").select(clean_name("template_id").alias("template_id")).distinct()  # `last` is one row
    return classify.classify_templates(_templates(spark, folder), base)


@query(f"select template_id, event_count, baseline_match, classification, classification_reason from ({CLASSIFIED_SQL})")
def classified_templates(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("template_id", "event_count", "baseline_match", "classification", "classification_reason")


@query(f"""select template_id, event_count, severity_text, error_kind, classification from ({CLASSIFIED_SQL})
  where severity_text in ('ERROR','CRITICAL','FATAL') or coalesce(error_kind, 'none') not in ('', 'none') or classification in ('unexpected', 'known-noise')""")
def error_view(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).where(classify.error_predicate()).select("template_id", "event_count", "severity_text", "error_kind", "classification")


@query(f"select template_id, event_count from ({TEMPLATES_SQL}) where lower(coalesce(exception_type, '')) like '%failure%' or lower(coalesce(error_kind, '')) like '%failure%' or lower(coalesce(normalized_template, '')) like '%failure%' or template_id like '%failure%'")
def free_text_search(spark: SparkSession, folder: str) -> DataFrame:
    return classify.matching(_templates(spark, folder), "Failure").select("template_id", "event_count")


@query(f"select classification, issue_kind, count(*) n, cast(sum(event_count) as bigint) events from ({CLASSIFIED_SQL}) group by all")
def template_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).groupBy("classification", "issue_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("events"))


@query(f"""select e.event_id, e."offset" line_offset, coalesce(t.classification, 'unclassified') classification, t.classification_reason, coalesce(t.issue_kind, 'unknown') issue_kind
  from log_events e left join ({CLASSIFIED_SQL}) t on e.template_id = t.template_id""")
def event_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Template attributes joined to every event."""
    ev = table(spark, folder, "log_events", "event_id", "offset", "template_id", "classification", "classification_reason", "issue_kind")
    out = templates.with_template_attributes(ev, _classified(spark, folder), {"classification": "unclassified", "classification_reason": None, "issue_kind": "unknown"})
    return out.select("event_id", F.col("offset").alias("line_offset"), "classification", "classification_reason", "issue_kind")


@query(f"select t.template_id, t.example_event_id, min(e.body) body from ({TEMPLATES_SQL}) t left join log_events e on e.event_id = t.example_event_id group by all")
def example_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each template's example event."""
    t = _templates(spark, folder).select("template_id", "example_event_id")
    e = table(spark, folder, "log_events", "event_id", "body").groupBy("event_id").agg(F.min("body").alias("body"))
    return t.join(e, t.example_event_id == e.event_id, "left").select("template_id", "example_event_id", "body")


# ------------------------------------------------------------------ sequences

_L = f"({model.LINES_SQL})"
_BOOTS = f"""(select *, row_number() over (partition by service_name order by boot_order) seq from (
  select service_name, line_offset boot_order, ts_us started_us, last_value(ts_us ignore nulls) over (partition by service_name order by line_offset rows between unbounded preceding and 1 preceding) prior
  from {_L} where regexp_matches(body, {text_sql.quoted(sequences.BOOT)})) where prior is null or started_us is null or started_us - prior > 30000000)"""
_ANNOTATED = f"""(select l.*, coalesce(b.seq, 0) service_instance_seq, b.started_us service_instance_started_us from {_L} l asof left join {_BOOTS} b on l.service_name = b.service_name and l.line_offset >= b.boot_order)"""


def _boots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    ln = model.lines(spark, folder)
    return ln, sequences.boots(ln, BY, "line_offset")


def _with_kind(annotated: DataFrame) -> DataFrame:
    return annotated.withColumn("issue_kind", classify.issue_kind(F.col("body"), text.exception_type(F.col("body")), F.lit("none"), F.col("severity_text")))


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    ln, b = _boots(spark, folder)
    return _with_kind(sequences.with_instances(ln, b, BY, "line_offset")).withColumn("template_id", ids.stable_id(F.col("service_name"), F.col("severity_text"), F.substring("body", 1, 12)))


@query(f"select service_name, seq, boot_order, started_us from {_BOOTS}")
def service_restarts(spark: SparkSession, folder: str) -> DataFrame:
    return _boots(spark, folder)[1]


@query(f"select service_name, service_instance_seq, count(*) event_count from {_ANNOTATED} group by all")
def instance_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    ln, b = _boots(spark, folder)
    return sequences.instance_counts(sequences.with_instances(ln, b, BY, "line_offset"), BY)


@query(f"select a.event_id, a.service_name, a.service_instance_seq, a.service_instance_started_us from {_ANNOTATED} a left join (select service_name, max(seq) top from {_BOOTS} group by all) t using (service_name) where t.top is null or a.service_instance_seq > t.top - 2")
def last_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last two restarts of each service."""
    ln, b = _boots(spark, folder)
    kept = sequences.keep_instances(sequences.with_instances(ln, b, BY, "line_offset"), b, BY, 2)
    return kept.select("event_id", "service_name", "service_instance_seq", "service_instance_started_us")


_MARKS = "(" + " union all ".join(f"select service_name, run_id, line_offset, ts_us, '{d}' dependency, case when regexp_matches(body, {text_sql.quoted(sequences.DOWN[d])}) then 'down' else 'up' end kind from {_L} where regexp_matches(body, {text_sql.quoted(sequences.DOWN[d])}) or regexp_matches(body, {text_sql.quoted(sequences.UP[d])})" for d in sequences.DOWN) + ")"
_INCIDENTS = f"""(select service_name, dependency, no, min(case when kind = 'down' then ts_us end) down_us, min(case when kind = 'up' then ts_us end) up_us, count(*) filter (kind = 'down') down_events,
  greatest((min(case when kind = 'up' then ts_us end) - min(case when kind = 'down' then ts_us end)) / 1000000.0, 0.0) duration_s from (
  select *, sum(b) over (partition by service_name, dependency order by line_offset rows unbounded preceding) no from (
  select *, case when kind = 'down' and coalesce(lag(kind) over (partition by service_name, dependency order by line_offset), 'up') <> 'down' then 1 else 0 end b from {_MARKS})) where no > 0 group by all)"""


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.connectivity_marks(model.lines(spark, folder), ["service_name", "run_id", "line_offset", "ts_us"])


@query(f"select service_name, dependency, cast(no as bigint) no, down_us, up_us, down_events, case when up_us is not null then round(duration_s, 6) end duration_s from {_INCIDENTS}")
def connectivity_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Outages of dependencies from messages in file order."""
    out = sequences.connectivity_incidents(_marks(spark, folder), BY, "line_offset")
    return rounded(out.withColumn("duration_s", F.when(F.col("up_us").isNotNull(), F.col("duration_s"))), "duration_s")


@query(f"select service_name, dependency, arg_max(kind, line_offset) state, count(*) filter (kind = 'down') down_events, count(*) filter (kind = 'up') up_events from {_MARKS} group by all")
def connectivity_state(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.connectivity_state(_marks(spark, folder), BY, "line_offset")


_TID = "md5(service_name || chr(31) || severity_text || chr(31) || substring(body, 1, 12))"


@query(f"select service_name, {_TID} template_id, ts_us // 60000000 * 60000000 minute_us, count(*) n, arg_min(severity_text, event_id) severity_text from {_L} where ts_us is not null group by all having count(*) >= 2")
def template_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes in which a template occurs at least twice."""
    df = model.lines(spark, folder).withColumn("template_id", ids.stable_id(F.col("service_name"), F.col("severity_text"), F.substring("body", 1, 12)))
    return sequences.bursts(df, ["service_name", "template_id"], "ts_us", 2)


_CODE = f"""(select *, {_TID} template_id, {_ISSUE.replace("exception_type", "exc").replace("error_kind = 'traceback'", "false")} issue_kind from (select *, {text_sql.exception_type("body")} exc, body msg from {_ANNOTATED}))"""
_FIRST = f"(select service_name, service_instance_seq, f.* from (select service_name, service_instance_seq, arg_min(struct_pack(first_us := ts_us, template_id := template_id, severity_text := severity_text), line_offset) f from {_CODE} where issue_kind = 'code' and ts_us is not null group by all))"


@query(f"select * from {_FIRST}")
def first_code_errors(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.first_code_errors(_annotated(spark, folder), BY, "line_offset")


@query(f"select i.service_name, count(*) instances, count(f.first_us) with_first_error, count(*) - count(f.first_us) survived from (select distinct service_name, service_instance_seq from {_ANNOTATED}) i left join {_FIRST} f using (service_name, service_instance_seq) group by all")
def survival(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.survival(_annotated(spark, folder), BY, "line_offset")


@query(f"""with p as (select service_name, ts_us // 1000000 as second, sum(length(body)) v from {_L} group by all)
  select service_name, second, """ + ", ".join(f"round(sum(v) over (partition by service_name order by second range between {n - 1} preceding and current row) / {n}.0, 6) rate_{n}s" for n in (5, 30, 60)) + " from p")
def rolling_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Characters per second over the last 5, 30 and 60 seconds."""
    df = model.lines(spark, folder).select("service_name", F.floor(F.col("ts_us") / 1_000_000).alias("s"), F.length("body").alias("n"))
    return rounded(sequences.rolling_rates(df, BY, "s", "n"), "rate_5s", "rate_30s", "rate_60s")


@query(f"""select service_name, started_us ts_us, 'boot' kind, 'service instance #' || seq || ' boot' label, seq instance_seq, null template_id, null n, null dependency, null severity_text from {_BOOTS}
union all select service_name, first_us, 'first_code_error', 'first code error in instance #' || service_instance_seq, service_instance_seq, template_id, 1, null, severity_text from {_FIRST}
union all select service_name, minute_us, 'template_burst', 'burst of ' || n || ' events for ' || substring(template_id, 1, 12), null, template_id, n, null, severity_text from ({SQL["template_bursts"]})
union all select service_name, down_us, 'connectivity_down', dependency || ' down', null, null, null, dependency, null from {_INCIDENTS}
union all select service_name, up_us, 'connectivity_up', dependency || ' up', null, null, null, dependency, null from {_INCIDENTS} where up_us is not null""")
def replay(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline of all kinds of items."""
    _, b = _boots(spark, folder)
    incidents = sequences.connectivity_incidents(_marks(spark, folder), BY, "line_offset")
    return sequences.replay(BY, b, sequences.first_code_errors(_annotated(spark, folder), BY, "line_offset"), template_bursts(spark, folder), incidents)


# ---- the same by the templates of whole bodies; the queries above take the first 12 characters of a body for its template, as their SQL does
_WHOLE_L = f"""(select * exclude (t), md5(service_name || chr(31) || severity_text || chr(31) || {text_sql.cut_headline("t")} || chr(31)) whole_id from ({text_sql.normalized(
    f"(select *, case when contains(body, chr(10)) then {text_sql.first_line('body')} else body end line from {_L})", "line", "event_id, service_name, worker_id, severity_text, ts_us, line_offset, body")}))"""
_WHOLE_FIRST = _FIRST.replace(_TID, "whole_id").replace(f"from {_L} l asof", f"from {_WHOLE_L} l asof")


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    df = templates.identify(spread(model.lines(spark, folder)))
    return df.select("event_id", "service_name", "worker_id", "severity_text", "ts_us", "line_offset", "body", "template_id")


@query(SQL["template_bursts"].replace(_TID, "whole_id").replace(_L, _WHOLE_L))
def template_bursts_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes in which a template of whole bodies occurs at least twice."""
    return sequences.bursts(_whole(spark, folder), ["service_name", "template_id"], "ts_us", 2)


@query(f"select * from {_WHOLE_FIRST}")
def first_code_errors_whole(spark: SparkSession, folder: str) -> DataFrame:
    b = _boots(spark, folder)[1]
    return sequences.first_code_errors(_with_kind(sequences.with_instances(_whole(spark, folder), b, BY, "line_offset")), BY, "line_offset")


@query(SQL["replay"].replace(_FIRST, _WHOLE_FIRST).replace(SQL["template_bursts"], SQL["template_bursts_whole"]))
def replay_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline with the templates of whole bodies."""
    _, b = _boots(spark, folder)
    incidents = sequences.connectivity_incidents(_marks(spark, folder), BY, "line_offset")
    return sequences.replay(BY, b, first_code_errors_whole(spark, folder), template_bursts_whole(spark, folder), incidents)


# ------------------------------------------------------------------ runs, registry, baseline

_RT, _RUNS = f"({model.RUN_TEMPLATES_SQL})", f"({model.RUNS_SQL})"


@query(f"""select r.run_id, r.service_name, r.scenario, r.status, coalesce(i.n, 0) incidents, round(coalesce(i.d, 0.0), 3) downtime_s from {_RUNS} r
  left join (select run_id, count(*) n, sum(duration_seconds) d from connectivity_incidents group by all) i using (run_id)""")
def run_registry(spark: SparkSession, folder: str) -> DataFrame:
    r = model.runs(spark, folder).select("run_id", "service_name", "scenario", "status")
    i = registry.incident_rollup(table(spark, folder, "connectivity_incidents", "run_id", "duration_seconds"))
    return r.join(i, "run_id", "left").select("run_id", "service_name", "scenario", "status", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.round(F.coalesce("downtime_s", F.lit(0.0)), 3).alias("downtime_s"))


@query(f"""select service_name, template_id, f.*, a.run_id first_seen_run_id, z.run_id last_seen_run_id, a.created_at first_seen_at, z.created_at last_seen_at, runs_seen_count, green_runs_seen_count, total_event_count from (
  select r.service_name, t.template_id, arg_min(struct_pack(normalized_template := normalized_template, severity_text := severity_text, issue_kind := issue_kind, error_kind := error_kind, exception_type := exception_type), struct_pack(created_at := created_at, run_id := t.run_id)) f,
  min(struct_pack(created_at := created_at, run_id := t.run_id)) a, max(struct_pack(created_at := created_at, run_id := t.run_id)) z, count(*) runs_seen_count, count(*) filter (status = 'green') green_runs_seen_count, cast(sum(t.event_count) as bigint) total_event_count
  from {_RT} t join {_RUNS} r on r.run_id = t.run_id group by all)""")
def template_registry_build(spark: SparkSession, folder: str) -> DataFrame:
    return registry.template_registry(model.run_templates(spark, folder), model.runs(spark, folder))


BASELINE_SQL = f"""(with g as (select * from {_RUNS} where status = 'green'), c as (select service_name, scenario, count(*) n from g group by all having count(*) >= {MIN_GREEN}),
s as (select g.service_name, g.scenario, t.template_id, arg_max(struct_pack(normalized_template := normalized_template, severity_text := severity_text, issue_kind := issue_kind), struct_pack(a := created_at, b := t.run_id)) s from {_RT} t join g on g.run_id = t.run_id join c on c.service_name = g.service_name and c.scenario = g.scenario group by all),
p as (select s.service_name, s.scenario, s.template_id, s.s, coalesce(t.event_count, 0) x from s join g on g.service_name = s.service_name and g.scenario = s.scenario left join {_RT} t on t.run_id = g.run_id and t.template_id = s.template_id)
select service_name, scenario, template_id, s.*, avg(x) mean_count, coalesce(stddev_samp(x), 0) std_count, quantile_cont(x, 0.5) p50_count, quantile_cont(x, 0.95) p95_count, quantile_cont(x, 0.99) p99_count, min(x) min_count, max(x) max_count, count(*) runs_in_baseline
from p group by service_name, scenario, template_id, s)"""


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    return registry.baseline(model.run_templates(spark, folder), model.runs(spark, folder), MIN_GREEN)


@query(f"select * replace (round(mean_count, 6) as mean_count, round(std_count, 6) as std_count, round(p50_count, 6) as p50_count, round(p95_count, 6) as p95_count, round(p99_count, 6) as p99_count) from {BASELINE_SQL}")
def baseline_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_baseline(spark, folder), "mean_count", "std_count", "p50_count", "p95_count", "p99_count")


@query(f"select service_name, r.run_id, r.created_at, r.status, r.event_count from (select service_name, arg_max(struct_pack(run_id := run_id, created_at := created_at, status := status, event_count := event_count), struct_pack(a := created_at, b := run_id)) r from {_RUNS} group by all)")
def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    return registry.latest_runs(model.runs(spark, folder)).select("service_name", "run_id", "created_at", "status", "event_count")


@query(f"""select run_id, service_name, created_at, event_count - lag(event_count) over w delta_events, error_count - lag(error_count) over w delta_errors, coalesce(error_count - lag(error_count) over w > 0, false) alert
  from {_RUNS} window w as (partition by service_name order by created_at, run_id)""")
def run_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return registry.run_deltas(model.runs(spark, folder))


@query(f"select run_id, service_name, created_at from {_RUNS} qualify row_number() over (partition by service_name order by created_at desc, run_id desc) <= 3")
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """The last three runs of each service."""
    return registry.history(model.runs(spark, folder), 3).select("run_id", "service_name", "created_at")


@query(f"with o as (select run_id, service_name, status from {_RUNS}), n as (select run_id, service_name, 'reindexed' status from {_RUNS} where error_count > 0) select * from o where run_id not in (select run_id from n) union all select * from n")
def registry_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with errors indexed anew."""
    r = model.runs(spark, folder)
    return registry.upsert(r.select("run_id", "service_name", "status"), r.where("error_count > 0").select("run_id", "service_name", F.lit("reindexed").alias("status")))


# ------------------------------------------------------------------ diffs

_HALF = lambda op: f"(select template_id, count(*) event_count, arg_min(severity_text, struct_pack(a := source, b := \"offset\")) severity_text, arg_min(error_kind, struct_pack(a := source, b := \"offset\")) error_kind from log_events where template_id is not null and run_id {op} (select min(run_id) || '~' from (select run_id, row_number() over (order by run_id) i, count(*) over () n from (select distinct run_id from log_events)) where i * 2 >= n) group by all)"


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Templates of the runs of the first and of the second half of the run ids."""
    ev = table(spark, folder, "log_events", "run_id", "template_id", "severity_text", "error_kind", "source", "offset")
    ids_ = ev.select("run_id").where("run_id is not null").distinct()
    n = ids_.count()
    cut = ids_.orderBy("run_id").limit((n + 1) // 2).agg(F.max("run_id").alias("m"))
    at = F.struct("source", "offset")
    half = ev.where("template_id is not null")
    agg = lambda d: d.groupBy("template_id").agg(F.count(F.lit(1)).alias("event_count"), F.min_by("severity_text", at).alias("severity_text"), F.min_by("error_kind", at).alias("error_kind"))
    return agg(half.where(F.col("run_id") <= cut.scalar())), agg(half.where(F.col("run_id") > cut.scalar()))


@query(f"""select * from (select coalesce(r.template_id, l.template_id) template_id,
  case when l.event_count is null and (r.severity_text in ('ERROR','CRITICAL','FATAL') or coalesce(r.error_kind, 'none') not in ('', 'none')) then 'new'
       when r.event_count is null and (l.severity_text in ('ERROR','CRITICAL','FATAL') or coalesce(l.error_kind, 'none') not in ('', 'none')) then 'fixed'
       when r.event_count >= 5 and r.event_count >= l.event_count * 2.0 then 'frequency' end kind, coalesce(l.event_count, 0) left_count, coalesce(r.event_count, 0) right_count
  from {_HALF("<=")} l full join {_HALF(">")} r on l.template_id = r.template_id) where kind is not null""")
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of the later half of the runs against the earlier half; what grew by the ratio counts, however few events they are."""
    return diff.compare_runs(*_halves(spark, folder), rise=0)


@query(SQL["compare_runs"].replace("r.event_count >= l.event_count * 2.0", "r.event_count >= greatest(l.event_count * 2.0, l.event_count + 5)"))
def compare_runs_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The same where an increase is one of 5 events at least."""
    return diff.compare_runs(*_halves(spark, folder))


_INF = "1e308"
FINDINGS_SQL = f"""(with b as (select * from {BASELINE_SQL}), r as (select run_id, service_name, scenario from {_RUNS}),
j as (select r.run_id, r.service_name, r.scenario, t.template_id, t.severity_text, b.severity_text base_severity, t.issue_kind, t.event_count c, b.mean_count m, b.std_count s, b.p95_count p
  from {_RT} t join r on r.run_id = t.run_id left join b on b.service_name = r.service_name and b.scenario = r.scenario and b.template_id = t.template_id),
z as (select *, case when s > 1e-9 then (c - m) / s when c > m then {_INF} else 0.0 end z, case when m > 0 then c / m when c > 0 then {_INF} else 1.0 end d from j)
select run_id, service_name, scenario, template_id, 'new_template' kind, severity_text, base_severity, c observed_count, m mean_count, null::double delta_factor, null::double z_score from z where m is null
union all select run_id, service_name, scenario, template_id, 'regressed_template', severity_text, base_severity, c, m, d, z from z where m is not null and c >= 5 and c > p and z > 3.0
union all select run_id, service_name, scenario, template_id, 'severity_shifted', severity_text, base_severity, c, m, null, null from z where m is not null and severity_text <> '' and base_severity <> '' and severity_text <> base_severity
union all select run_id, service_name, scenario, template_id, 'code_error', severity_text, base_severity, c, m, null, null from z where issue_kind = 'code' and upper(severity_text) in ('ERROR','CRITICAL','FATAL') and c > 0
union all select r.run_id, r.service_name, r.scenario, b.template_id, 'missing_template', null, b.severity_text, null, b.mean_count, null, null from r join b on b.service_name = r.service_name and b.scenario = r.scenario
  where not exists (select 1 from j where j.run_id = r.run_id and j.template_id = b.template_id))"""


def _base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates of the runs (read by many parts, so written once), runs, baseline."""
    rt, runs = materialised(model.run_templates(spark, folder)), model.runs(spark, folder)
    return rt, runs, registry.baseline(rt, runs, MIN_GREEN)


def _found(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same, and the findings."""
    rt, runs, base = _base(spark, folder)
    return rt, runs, base, materialised(diff.diff_findings(rt, runs, base))


_ROUND = "round(mean_count, 6) as mean_count, round(delta_factor, 6) as delta_factor, round(z_score, 6) as z_score"


@query(f"select * replace ({_ROUND}) from {FINDINGS_SQL}")
def diff_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every run against the baseline of its cohort."""
    return rounded(diff.diff_findings(*_base(spark, folder)), "mean_count", "delta_factor", "z_score")


#: Decisions for the check: by the first character of the template id.
_OVERRIDES = f"""(select distinct service_name, scenario, template_id, case when template_id < '4' then 'pinned' else 'banned' end decision from {BASELINE_SQL} where template_id < '8'
  union select distinct service_name, scenario, template_id, 'banned' from {FINDINGS_SQL} where kind = 'new_template' and template_id >= 'a')"""


def _decisions(base: DataFrame, found: DataFrame) -> DataFrame:
    key = ["service_name", "scenario", "template_id"]
    first = base.where("template_id < '8'").select(*key, F.when(F.col("template_id") < "4", "pinned").otherwise("banned").alias("decision"))
    more = found.where("kind = 'new_template' and template_id >= 'a'").select(*key, F.lit("banned").alias("decision"))
    return first.unionByName(more).distinct()


def _overridden(spark: SparkSession, folder: str) -> DataFrame:
    _, _, base, found = _found(spark, folder)
    return diff.apply_overrides(found, _decisions(base, found))


OVERRIDDEN_SQL = f"""(with f as (select * from {FINDINGS_SQL}), o as (select service_name, scenario, template_id, min(decision) decision from {_OVERRIDES} group by all),
ob as (select run_id, service_name, scenario, template_id, max(observed_count) observed_count, min(severity_text) severity_text from f where kind <> 'missing_template' group by all)
select f.* from f left join o using (service_name, scenario, template_id) where not (f.kind = 'new_template' and coalesce(o.decision in ('pinned', 'banned'), false))
union all select run_id, service_name, scenario, template_id, 'policy_violation', severity_text, null, observed_count, null, null, null from ob join o using (service_name, scenario, template_id) where decision = 'banned'
union all select r.run_id, service_name, scenario, o.template_id, 'pinned_missing', null, null, null, null, null, null from (select distinct run_id, service_name, scenario from f) r join o using (service_name, scenario)
  where decision = 'pinned' and not exists (select 1 from ob where ob.run_id = r.run_id and ob.template_id = o.template_id))"""


@query(f"select run_id, template_id, kind, severity_text, observed_count from {OVERRIDDEN_SQL}")
def diff_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Findings after pinned and banned templates."""
    return _overridden(spark, folder).select("run_id", "template_id", "kind", "severity_text", "observed_count")


#: Decisions from the data: failing templates are banned, others that every run of a baseline has are pinned, the rest is undecided.
_FAILS = "coalesce(upper(severity_text) in ('ERROR', 'CRITICAL', 'FATAL'), false)"
_WHOLE_OVERRIDES = f"""(select distinct service_name, scenario, template_id, case when {_FAILS} then 'banned' else 'pinned' end decision from {BASELINE_SQL} where {_FAILS} or min_count > 0
  union select distinct service_name, scenario, template_id, 'banned' from {FINDINGS_SQL} where kind = 'new_template' and {_FAILS})"""
_WHOLE_OVERRIDDEN_SQL = OVERRIDDEN_SQL.replace(_OVERRIDES, _WHOLE_OVERRIDES)


def _whole_decisions(base: DataFrame, found: DataFrame) -> DataFrame:
    key = ["service_name", "scenario", "template_id"]
    first = base.where(f"{_FAILS} or min_count > 0").select(*key, F.when(F.expr(_FAILS), "banned").otherwise("pinned").alias("decision"))
    more = found.where(f"kind = 'new_template' and {_FAILS}").select(*key, F.lit("banned").alias("decision"))
    return first.unionByName(more).distinct()


@query(f"select run_id, template_id, kind, severity_text, observed_count from {_WHOLE_OVERRIDDEN_SQL}")
def diff_overrides_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Findings after decisions on templates of all ids."""
    _, _, base, found = _found(spark, folder)
    return diff.apply_overrides(found, _whole_decisions(base, found)).select("run_id", "template_id", "kind", "severity_text", "observed_count")


_LV = lambda c: f"case upper({c}) when 'DEBUG' then 0 when 'INFO' then 1 when 'NOTICE' then 2 when 'WARN' then 3 when 'WARNING' then 3 when 'ERROR' then 4 when 'CRITICAL' then 5 when 'FATAL' then 5 else 0 end"
_N = lambda k: f"count(*) filter (kind = '{k}')"


@query(f"""select run_id, "new", missing, regressed, severity_shifted, code_errors, policy_violations, code_error_events,
  case when greatest("new", missing, regressed, severity_shifted, code_errors, policy_violations) = 0 then 'no-change' when code_errors > 0 or policy_violations > 0 or regressed > 0 or up > 0 or risky > 0 then 'unsafe' else 'safe' end verdict
from (select run_id, {_N("new_template")} "new", {_N("missing_template")} missing, {_N("regressed_template")} regressed, {_N("severity_shifted")} severity_shifted, {_N("code_error")} code_errors, {_N("policy_violation")} policy_violations,
  cast(coalesce(sum(observed_count) filter (kind = 'code_error'), 0) as bigint) code_error_events, count(*) filter (kind = 'new_template' and coalesce(severity_text, '') <> '' and upper(severity_text) not in ('INFO','DEBUG','NOTICE')) risky,
  count(*) filter (kind = 'severity_shifted' and {_LV("severity_text")} > {_LV("base_severity")}) up from {OVERRIDDEN_SQL} group by run_id)""")
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of each run."""
    return diff.diff_summary(_overridden(spark, folder))


@query(SQL["diff_summary"].replace(OVERRIDDEN_SQL, _WHOLE_OVERRIDDEN_SQL))
def diff_summary_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of each run after decisions on templates of all ids."""
    _, _, base, found = _found(spark, folder)
    return diff.diff_summary(diff.apply_overrides(found, _whole_decisions(base, found)))


_NEW = f"(select distinct template_id, normalized_template, severity_text from ({TEMPLATES_SQL}))"
_OLD = "(select distinct lower(trim(template_id)) template_id, lower(trim(normalized_template)) normalized_template, upper(trim(severity_text)) severity_text from template_registry where template_id is not null and snapshot_no = 1)"


@query(f"""with a as (select template_id l, severity_text, {text_sql.shingles("normalized_template")} s from {_NEW}), b as (select template_id r, severity_text, {text_sql.shingles("normalized_template")} s from {_OLD})
select l template_id, r predecessor_template_id, round(j, 6) similarity_score from (select l, r, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) j from a join b on a.severity_text = b.severity_text and l <> r) where j > 0.5
qualify row_number() over (partition by l order by j desc, r) = 1""")
def lineage_predecessors(spark: SparkSession, folder: str) -> DataFrame:
    """For each template the most similar one of the first registry snapshot with the same severity."""
    reg = table(spark, folder, "template_registry", "template_id", "normalized_template", "severity_text", "snapshot_no").where("template_id is not null and snapshot_no = 1")
    old = reg.select(clean_name("template_id").alias("template_id"), clean_name("normalized_template").alias("normalized_template"), F.upper(F.trim("severity_text")).alias("severity_text")).distinct()
    return rounded(diff.predecessors(_templates(spark, folder), old), "similarity_score")


_PROBE = "Failed to get queue segment at offset <NUM>: ValueError before the deadline passed"


@query(f"""select template_id, round(j, 6) similarity from (select template_id, len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q))) j from (select template_id, {text_sql.shingles("normalized_template")} s, {text_sql.shingles(text_sql.quoted(_PROBE))} q from {_NEW})) order by j desc, template_id limit 5""")
def lineage_topk(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diff.most_similar(_templates(spark, folder), _PROBE), "similarity").select("template_id", "similarity")


@query(f"""with f as (select * from {FINDINGS_SQL}), n as (select distinct f.service_name, f.scenario, f.severity_text, f.template_id, t.normalized_template x from f join {_RT} t on t.run_id = f.run_id and t.template_id = f.template_id where kind = 'new_template'),
a as (select *, {text_sql.shingles("x")} s from n), b as (select service_name, scenario, severity_text, template_id, {text_sql.shingles("normalized_template")} s from {BASELINE_SQL}),
p as (select a.service_name, a.scenario, a.severity_text, a.template_id, b.template_id r, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) j from a join b on a.service_name = b.service_name and a.scenario = b.scenario and a.severity_text = b.severity_text and a.template_id <> b.template_id),
q as (select * from p where j > 0.5 qualify row_number() over (partition by service_name, scenario, severity_text, template_id order by j desc, r) = 1)
select f.run_id, f.template_id, case when f.kind = 'new_template' and q.r is not null then 'evolved_template' else f.kind end kind, case when f.kind = 'new_template' then q.r end predecessor_template_id, case when f.kind = 'new_template' then round(q.j, 6) end similarity_score
from f left join q on q.service_name = f.service_name and q.scenario = f.scenario and q.severity_text = f.severity_text and q.template_id = f.template_id""")
def diff_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with the likely predecessors of new templates."""
    rt, _, base, found = _found(spark, folder)
    out = diff.with_lineage(found, rt.select("run_id", "template_id", "normalized_template"), materialised(base))
    return rounded(out.select("run_id", "template_id", "kind", "predecessor_template_id", "similarity_score"), "similarity_score")


@query(f"""select r.run_id, r.service_name, r.scenario, 'connectivity_regression' kind, i.dependency, i.down_at, i.up_at, i.duration_seconds from connectivity_incidents i join {_RUNS} r on r.run_id = i.run_id""")
def connectivity_regressions(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "connectivity_incidents", "run_id", "service_name", "dependency", "down_at", "up_at", "duration_seconds")
    return diff.connectivity_findings(i, model.runs(spark, folder))


def _editor(spark: SparkSession, folder: str, decisions) -> DataFrame:
    rt, runs, base, found = _found(spark, folder)
    r = runs.where("status = 'red'").select("run_id", F.col("service_name").alias("_s"), "scenario")
    seen = rt.drop("service_name").join(r, "run_id").withColumnRenamed("_s", "service_name")
    return rounded(diff.editor_universe(seen, base, decisions(base, found)), "mean_count")


@query(f"""with t as (select r.service_name, r.scenario, t.template_id, min(struct_pack(a := coalesce(normalized_template, ''), b := coalesce(severity_text, ''))) x, cast(sum(t.event_count) as bigint) observed_count from {_RT} t join {_RUNS} r on r.run_id = t.run_id where r.status = 'red' group by all),
o as (select service_name, scenario, template_id, min(decision) decision from {_OVERRIDES} group by all)
select coalesce(t.service_name, b.service_name, o.service_name) service_name, coalesce(t.scenario, b.scenario, o.scenario) scenario, coalesce(t.template_id, b.template_id, o.template_id) template_id,
  coalesce(t.x.a, b.normalized_template) normalized_template, coalesce(t.x.b, b.severity_text) severity_text, observed_count, round(mean_count, 6) mean_count, decision
from t full join {BASELINE_SQL} b on b.service_name = t.service_name and b.scenario = t.scenario and b.template_id = t.template_id
full join o on o.service_name = coalesce(t.service_name, b.service_name) and o.scenario = coalesce(t.scenario, b.scenario) and o.template_id = coalesce(t.template_id, b.template_id)""")
def baseline_editor(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of red runs, of the baseline and of decisions side by side."""
    return _editor(spark, folder, _decisions)


@query(SQL["baseline_editor"].replace(_OVERRIDES, _WHOLE_OVERRIDES))
def baseline_editor_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The same with decisions on templates of all ids."""
    return _editor(spark, folder, _whole_decisions)


@query(f"select run_id, lag(run_id) over (partition by service_name, scenario order by created_at, run_id) previous_run_id from {_RUNS}")
def previous_runs(spark: SparkSession, folder: str) -> DataFrame:
    return registry.previous_runs(model.runs(spark, folder))


@query(f"""select coalesce(i.service_name, s.service_name) service_name, i.runs, s.lines, s.chars from (select service_name, count(*) runs from {_RUNS} group by all) i
  full join (select lower(trim(split_part(source, '/', 2))) service_name, count(*) as lines, cast(sum(length(line)) as bigint) chars from raw_lines group by all) s on s.service_name = i.service_name""")
def service_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed runs and raw lines of each service."""
    indexed = model.runs(spark, folder).groupBy("service_name").agg(F.count(F.lit(1)).alias("runs"))
    lines = table(spark, folder, "raw_lines", "source", "line").groupBy(clean_name(F.split("source", "/")[1]).alias("service_name")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
    return registry.overview(indexed, lines)


# ------------------------------------------------------------------ graphs and dashboards

_INC = "(select run_id, lower(trim(service_name)) service_name, lower(trim(dependency)) dependency, duration_seconds from connectivity_incidents)"


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "connectivity_incidents", "run_id", "service_name", "dependency", "duration_seconds")
    return df.withColumn("service_name", clean_name("service_name")).withColumn("dependency", clean_name("dependency"))


@query(f"select service_name, dependency, count(distinct run_id) runs_with_dependency, count(*) incidents from {_INC} group by all")
def service_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return graph.service_dependencies(_incidents(spark, folder))


_CO = f"(select worker_id w, ts_us t, {_TID.replace('service_name || chr(31) || ', '')} id from {_L})"


@query(f"""with e as (select * from {_CO}), c as (select id, count(*) m, sum(count(*)) over () total from e group by id),
p as (select a.id a, b.id b, count(*) n from e a join e b on a.w = b.w and (b.t > a.t or (b.t = a.t and b.id > a.id)) and b.t - a.t <= 900000000 and a.id <> b.id group by all having count(*) >= 2)
select p.a template_a, p.b template_b, n, round(ca.m / ca.total, 6) p_a, round(cb.m / cb.total, 6) p_b, round(n / ((ca.m / ca.total) * (cb.m / cb.total) * ca.total), 6) lift from p join c ca on ca.id = p.a join c cb on cb.id = p.b""")
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Templates that follow each other on a worker within 15 minutes."""
    df = model.lines(spark, folder).withColumn("template_id", F.md5(F.concat_ws(ids.SEPARATOR, "severity_text", F.substring("body", 1, 12))))
    return rounded(graph.cooccurrence(df, 900_000_000, 2), "p_a", "p_b", "lift")


@query(SQL["cooccurrence"].replace(_CO, f"(select worker_id w, ts_us t, whole_id id from {_WHOLE_L})"))
def cooccurrence_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the templates of whole bodies (written once: a filter on the ids would repeat their computation)."""
    df = materialised(_whole(spark, folder).select("worker_id", "ts_us", "template_id"))
    return rounded(graph.cooccurrence(df, 900_000_000, 2), "p_a", "p_b", "lift")


@query(f"""with b as (select * from {BASELINE_SQL}), r as (select run_id, service_name, scenario from {_RUNS}), p as (select r.*, t.template_id, t.event_count from {_RT} t join r on r.run_id = t.run_id),
k as (select service_name, scenario, template_id from p group by service_name, scenario, template_id qualify row_number() over (partition by service_name, scenario order by sum(event_count) desc, template_id) <= 50)
select k.service_name, k.scenario, r.run_id, k.template_id, coalesce(p.event_count, 0) n, round(case when b.std_count is null then null when b.std_count >= 1e-9 then (coalesce(p.event_count, 0) - b.mean_count) / b.std_count
  when coalesce(p.event_count, 0) = b.mean_count then 0.0 when coalesce(p.event_count, 0) > b.mean_count then {_INF} else -{_INF} end, 6) z, b.mean_count is null is_novel
from k join r on r.service_name = k.service_name and r.scenario = k.scenario left join p on p.run_id = r.run_id and p.template_id = k.template_id left join b on b.service_name = k.service_name and b.scenario = k.scenario and b.template_id = k.template_id""")
def heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dashboards.heatmap(*_base(spark, folder)), "z")


_PLACED = f"(select t.template_id, t.event_count, r.* from {_RT} t join (select run_id, service_name, scenario, row_number() over (partition by service_name, scenario order by created_at, run_id) no from {_RUNS}) r on r.run_id = t.run_id)"


@query(f"""select run_id, count(*) templates_in_run, count(*) filter (x) novel_count, round(count(*) filter (x) / count(*), 6) novelty_fraction from (
  select run_id, coalesce(no - lag(no) over (partition by service_name, scenario, template_id order by no) > 5, true) x from {_PLACED}) group by run_id""")
def novelty_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(dashboards.novelty(model.run_templates(spark, folder), model.runs(spark, folder)), "novelty_fraction")


@query(f"""with f as (select p.service_name, p.scenario, p.template_id, p.no from {_PLACED} p left join {BASELINE_SQL} b on b.service_name = p.service_name and b.scenario = p.scenario and b.template_id = p.template_id
  where case when b.mean_count is null then p.event_count >= 5 else p.event_count >= 5 and p.event_count > b.p95_count and (case when b.std_count > 1e-9 then (p.event_count - b.mean_count) / b.std_count when p.event_count > b.mean_count then {_INF} else 0 end) > 3.0 end),
r as (select run_id, service_name, scenario, row_number() over (partition by service_name, scenario order by created_at, run_id) no from {_RUNS}),
c as (select r.run_id, count(f.template_id) c, count(f.template_id) filter (g.template_id is null) n from r left join f on f.service_name = r.service_name and f.scenario = r.scenario and f.no = r.no left join f g on g.service_name = f.service_name and g.scenario = f.scenario and g.template_id = f.template_id and g.no = f.no - 1 group by all),
x as (select r.run_id, count(f.template_id) filter (g.template_id is null) x from r left join f on f.service_name = r.service_name and f.scenario = r.scenario and f.no = r.no - 1 left join f g on g.service_name = f.service_name and g.scenario = f.scenario and g.template_id = f.template_id and g.no = r.no group by all)
select run_id, c current_flagged_count, n new_regressions, x fixed_regressions, n - x net from c join x using (run_id)""")
def regression_burndown(spark: SparkSession, folder: str) -> DataFrame:
    return dashboards.burndown(*_base(spark, folder))


@query(f"""select service_name, {_N("code_error")} code_error_templates, cast(coalesce(sum(observed_count) filter (kind = 'code_error'), 0) as bigint) code_error_events, {_N("new_template")} new_templates, {_N("regressed_template")} regressed_templates from {FINDINGS_SQL} group by rollup (service_name)""")
def service_health(spark: SparkSession, folder: str) -> DataFrame:
    return dashboards.health(diff.diff_findings(*_base(spark, folder))).drop("policy_violations")


_HEALTH = f"""{_N("code_error")} code_error_templates, cast(coalesce(sum(observed_count) filter (kind = 'code_error'), 0) as bigint) code_error_events, {_N("new_template")} new_templates, {_N("regressed_template")} regressed_templates, {_N("policy_violation")} policy_violations"""


@query(f"select service_name, {_HEALTH} from {_WHOLE_OVERRIDDEN_SQL} group by rollup (service_name)")
def service_health_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per service and in all after decisions, with what violates them."""
    _, _, base, found = _found(spark, folder)
    return dashboards.health(diff.apply_overrides(found, _whole_decisions(base, found)))


@query(f"select service_name, {_HEALTH} from {_WHOLE_OVERRIDDEN_SQL} where run_id in (select arg_max(run_id, struct_pack(a := created_at, b := run_id)) from {_RUNS} group by service_name) group by rollup (service_name)")
def latest_health(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the latest run of each service."""
    _, runs, base, found = _found(spark, folder)
    return dashboards.latest_health(diff.apply_overrides(found, _whole_decisions(base, found)), registry.latest_runs(runs))


@query(f"select run_id from ({SQL['diff_summary_whole']}) where verdict = 'unsafe' or \"new\" > 0 or code_errors > 0")
def ci_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that a pipeline should stop for."""
    return registry.gate(diff_summary_whole(spark, folder)).select("run_id")


@query(f"select 'service' what, service_name \"name\", count(*) runs from {_RUNS} where service_name is not null group by all union all select 'scenario', scenario, count(*) from {_RUNS} where scenario is not null group by all")
def services_and_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return registry.services_and_scenarios(model.runs(spark, folder))


@query(f"select service_name, count(*) incidents, string_agg(distinct dependency, ', ' order by dependency) dependencies, round(coalesce(sum(duration_seconds), 0), 3) downtime_s from {_INC} group by all")
def connectivity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return dashboards.connectivity(_incidents(spark, folder)).withColumn("downtime_s", F.round("downtime_s", 3))


@query(f"""select template_id, kind, event_no from (select template_id, event_no, case when event_no = 3 and r is null then 'new_template' when r is not null and event_no = greatest(5, r + 1) then 'regression' end kind from (
  select e.template_id, row_number() over (partition by e.template_id order by source, "offset", event_id) event_no, b.r from log_events e left join (select lower(trim(template_id)) template_id, max(total_event_count) // 100 r from template_registry group by all) b on b.template_id = e.template_id where e.template_id is not null)) where kind is not null""")
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """When the running count of a template first passes the bound for a new one, or that of the registry (a hundredth of its total)."""
    ev = table(spark, folder, "log_events", "template_id").where("template_id is not null").groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    reg = table(spark, folder, "template_registry", "template_id", "total_event_count").groupBy(clean_name("template_id").alias("template_id")).agg(F.expr("max(total_event_count) div 100").alias("r"))
    j = ev.join(reg, "template_id", "left")
    bound = F.greatest(F.lit(5).cast("long"), F.col("r") + 1)
    kinds = F.array(F.when(F.col("r").isNull() & (F.col("n") >= 3), F.struct(F.lit("new_template").alias("kind"), F.lit(3).cast("long").alias("event_no"))), F.when(F.col("r").isNotNull() & (F.col("n") >= bound), F.struct(F.lit("regression").alias("kind"), bound.alias("event_no"))))
    return j.select("template_id", F.explode(kinds).alias("k")).where("k is not null").select("template_id", "k.kind", "k.event_no")


@query(f"""with c as (select t.run_id, r.service_name, r.scenario, t.template_id, b.mean_count m, b.std_count s, b.p95_count p, unnest(range(1, t.event_count + 1)) event_no
    from {_RT} t left join {_RUNS} r on r.run_id = t.run_id left join {BASELINE_SQL} b on b.service_name = r.service_name and b.scenario = r.scenario and b.template_id = t.template_id),
z as (select *, case when m is not null then case when s > 1e-9 then (event_no - m) / s when event_no > m then {_INF} else 0.0 end end z from c),
f as (select run_id, service_name, scenario, template_id, min(struct_pack(event_no := event_no, z := z, m := m, p := p)) f from z where case when m is null then event_no >= 3 else event_no >= 5 and event_no > p and z > 3.0 end group by all)
select run_id, service_name, scenario, template_id, case when f.m is null then 'new_template' else 'regression' end kind, f.event_no, round(f.m, 6) baseline_mean, round(f.p, 6) baseline_p95, round(f.z, 6) z_score from f""")
def anomalies_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The detector of :func:`logweave.streaming.tail.anomalies` over all events of each run against the baseline of its cohort: the event with which a template is first new or first a regression."""
    rt, runs, base = _base(spark, folder)
    return rounded(diff.first_anomalies(rt, runs, base), "baseline_mean", "baseline_p95", "z_score")


# ------------------------------------------------------------------ template mining (order-dependent: no SQL)


@query()
def drain_templates(spark: SparkSession, folder: str) -> DataFrame:
    return drain.rollup(drain.mine(_templates(spark, folder)))


@query()
def drain_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their canonical template."""
    clusters = drain.mine(_templates(spark, folder))
    return templates.remap_templates(table(spark, folder, "log_events", "event_id", "template_id").where("template_id is not null"), clusters).select("event_id", "template_id")
