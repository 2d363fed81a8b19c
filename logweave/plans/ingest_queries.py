"""Queries of the ingest operators over the raw lines and nested run documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text, text_sql
from logweave.operators import dashboards, ingest
from logweave.operators.instants import clean_name
from logweave.sources.tables import table

#: The other engine has no look-ahead: the character behind a level is part of the match.
_BEGINS = ingest.BEGINS.replace("(?![A-Za-z0-9_])", "(?:[^A-Za-z0-9_]|$)")
_RECORDS = rf"""(select source, min(line_no) record_pos, count(*) line_count, string_agg(line, chr(10) order by line_no) raw from (
  select *, sum(b) over (partition by source order by line_no) rec from (
    select *, case when regexp_matches(line, {text_sql.quoted(_BEGINS)}) or line_no = min(line_no) over (partition by source) then 1 else 0 end b from (
      select source, line_no, min(regexp_replace(coalesce(line, ''), {text_sql.quoted(text.ANSI)}, '', 'g')) line from raw_lines where source is not null and line_no is not null group by all)))
  group by source, rec)"""


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the raw lines: lines that begin one, and the continuations behind them."""
    recs = ingest.records(table(spark, folder, "raw_lines", "source", "line_no", "line"))
    return recs.select("source", "record_pos", F.col("line_count").cast("long").alias("line_count"), F.length("raw").cast("long").alias("n_chars"), F.md5("raw").alias("digest"))


def _json(keys: tuple) -> str:
    one = lambda k: f"""nullif(case json_type(x.j) when 'OBJECT' then json_extract_string(x.j, '$."{k}"') end, '')""" if isinstance(k, str) else f"""nullif(json_extract_string(x.j, '$."{k[0]}"."{k[1]}"'), '')"""
    return "coalesce(" + ", ".join(one(k) for k in keys) + ")"


_GENERIC = ingest.GENERIC.replace(r"\z", "$")
_DECODED = rf"""(select *, case when j is not null then 'json' when len(string_split(raw, chr(9))) >= 5 then 'tab' when regexp_matches(raw, {text_sql.quoted(_GENERIC)}) then 'generic' else 'raw' end form from (
  select *, case when regexp_matches(raw, '^\s*\{{') and json_valid(raw) and json_type(case when json_valid(raw) then raw end) = 'OBJECT' then cast(raw as json) end j from {_RECORDS}))"""
_LEVEL = "case when v = 'WARN' then 'WARNING' when v in ('TRACE','DEBUG','INFO','WARNING','ERROR','CRITICAL','FATAL') then v else 'INFO' end"


def decoded_records(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the records of the raw lines: JSON, tab-separated and generic text, or the whole as message."""
    recs = ingest.records(table(spark, folder, "raw_lines", "source", "line_no", "line"))
    ev = ingest.decode(recs, "default", "run", "")
    return ev.select("source", F.col("offset").alias("record_pos"), "line_count", "parse_format", "parse_status", "timestamp", "severity_text", "service_name", "thread_name", "process_name", "process_pid", "worker_id")


def timeline_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents nested in run documents, by dependency, as rows again."""
    rows = table(spark, folder, "connectivity_incidents").where("dependency is not null and run_id is not null").withColumn("dependency", clean_name("dependency"))
    per = rows.groupBy("run_id", "service_name", "dependency").agg(F.struct(F.collect_list(F.struct("down_at", "up_at", "down_events")).alias("incidents")).alias("d"))  # as many as one run document holds
    nested = per.groupBy("run_id", "service_name").agg(F.map_from_entries(F.collect_list(F.struct("dependency", "d"))).alias("connectivity_timeline"))
    return dashboards.flatten_timeline(nested)


QUERIES = {f.__name__: f for f in (log_records, decoded_records, timeline_incidents)}
SQL = {
    "log_records": f"select source, record_pos, line_count, length(raw) n_chars, md5(raw) digest from {_RECORDS}",
    "timeline_incidents": "select run_id, service_name, lower(trim(dependency)) dependency, down_at, up_at, down_events from connectivity_incidents where dependency is not null and run_id is not null",
    "decoded_records": rf"""select source, record_pos, line_count, parse_format, parse_status, "timestamp", {_LEVEL} severity_text, service_name, thread_name, process_name, process_pid, worker_id from (
  select source, record_pos, line_count, case when form = 'json' then 'json' else 'text' end parse_format, case when form <> 'json' and regexp_matches(raw, '^\s*[{{\[]') then 'degraded' else 'ok' end parse_status,
    case form when 'json' then {_json(ingest.KEYS["timestamp"])} when 'tab' then string_split(raw, chr(9))[1] when 'generic' then regexp_extract(raw, {text_sql.quoted(_GENERIC)}, 1) end "timestamp",
    case form when 'json' then coalesce({_json(ingest.KEYS["severity"])}, 'INFO') when 'tab' then head[1] when 'generic' then regexp_extract(raw, {text_sql.quoted(_GENERIC)}, 2) else 'INFO' end v,
    coalesce(case form when 'json' then {_json(ingest.KEYS["service_name"])} end, 'default') service_name,
    case form when 'json' then {_json(ingest.KEYS["thread_name"])} when 'tab' then head[2] end thread_name,
    case form when 'json' then {_json(ingest.KEYS["process_name"])} when 'tab' then head[3] end process_name,
    case form when 'json' then try_cast({_json(ingest.KEYS["process_pid"])} as bigint) end process_pid,
    case form when 'json' then {_json(ingest.KEYS["worker_id"])} end worker_id
  from (select *, regexp_split_to_array(trim(string_split(raw, chr(9))[2]), '\s+') head from {_DECODED}) x)""",
}
