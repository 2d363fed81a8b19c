"""Log files to typed events: record assembly, JSON, tab-separated and generic text decoding, degraded marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave import schemas
from logweave.functions import ids, text
from logweave.operators import templates
from logweave.operators.log_entries import CHUNK_LINES, assemble, by_pattern
from logweave.sources.files import align

LEVELS = "TRACE|DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL"
#: A line begins a record if it starts with a brace or bracket, a date and time, or a level.
BEGINS = rf"^[ \t\r]*(?:[{{\[]|\[?\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T :]\d{{2}}:\d{{2}}:\d{{2}}|(?i:{LEVELS})(?![A-Za-z0-9_]))"
_TIME = r"\d{4}[-/]\d{2}[-/]\d{2}(?:[T ][0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-][0-2]\d:?[0-5]\d)?|:[0-2]\d:[0-5]\d:[0-5]\d)"
#: Generic text: time, level, message over all lines. The strict form ends at the first line, as an older reader did.
GENERIC = rf"(?s)^(?:\[)?({_TIME})(?:\])?[\s\t-]+({LEVELS})\b(.*)\z"
GENERIC_STRICT = rf"^(?:\[)?({_TIME})(?:\])?[\s\t-]+({LEVELS})\b([^\n]*)\z"

# Keys of JSON records by field, in order of precedence; a pair is a key of a nested object.
KEYS: dict[str, tuple] = {
    "timestamp": ("time", "timestamp", "@timestamp", "asctime", "datetime", ("attributes", "time")),
    "severity": ("level", "levelname", "severity", "severity_text", "log.level", ("attributes", "level")),
    "body": ("message", "body", "msg", "event", ("attributes", "message"), "exception.message", ("exception", "message")),
    "service_name": ("microservice", "service.name", "service_name", "service", ("resource", "service.name"), ("attributes", "service.name")),
    "thread_name": ("threadName", "thread.name", "thread_name", ("attributes", "thread.name")),
    "process_name": ("processName", "process.name", "process_name", ("attributes", "process.name")),
    "process_pid": ("pid", "process.pid", "process_pid", ("attributes", "process.pid")),
    "service_instance_id": ("service.instance.id", "service_instance_id", ("resource", "service.instance.id"), ("attributes", "service.instance.id")),
    "worker_id": ("worker_id", ("attributes", "worker_id")),
    "server_kind": ("server.kind", "server_kind", ("resource", "server.kind"), ("attributes", "server.kind")),
    "trace_id": ("trace_id", "traceId", "trace.id"),
    "span_id": ("span_id", "spanId", "span.id"),
    "container_id": ("container.id", "container_id"),
    "k8s_pod_name": ("k8s.pod.name", "pod_name"),
    "k8s_container_name": ("k8s.container.name", "container.name", "k8s_container_name"),
}


#: One valid JSON object and nothing else. As a list of one, so that text behind it, which the parser would let pass, makes it invalid.
_OPTIONS = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false", "allowComments": "false"}
_TOP = sorted({k if isinstance(k, str) else k[0] for ks in KEYS.values() for k in ks} | {"attributes", "resource"})
_RECORD = T.StructType([T.StructField(k, T.StringType()) for k in _TOP])


def _parsed(raw: Column) -> Column:
    """The fields of :data:`KEYS` of a JSON object as texts, from one parse; null for any other text."""
    text_ = F.when(raw.rlike(r"^\s*\{"), F.concat(F.lit("["), raw, F.lit("]")))
    return F.from_json(text_, T.ArrayType(_RECORD), _OPTIONS)


def _json_field(keys: tuple) -> Column:
    """First value that is neither null nor empty; a pair is looked up in its object only where there is one."""
    got = [F.col("_record").getField(k) if isinstance(k, str) else F.get_json_object(F.col("_record").getField(k[0]), f"$['{k[1]}']") for k in keys]
    return F.coalesce(*[F.when(g != "", g) for g in got])


def records(lines: DataFrame) -> DataFrame:
    """(source, record_pos, line_count, raw) of physical lines (source, line_no, line): colour codes left out, continuations attached.

    With a column ``offset``, the byte at which each line begins, record_pos is
    the byte of the record; without it the number of its first line.
    """
    bytes_ = "offset" in lines.columns
    rows = lines.select("source", (F.col("offset") + 1 if bytes_ else F.col("line_no")).alias("line_no"), "line")
    out = assemble(rows, CHUNK_BYTES if bytes_ else CHUNK_LINES, clean=lambda c: text.strip_ansi(F.coalesce(F.col(c), F.lit(""))), layouts=by_pattern(BEGINS)).drop("layout").withColumnRenamed("text", "raw")
    return out.withColumn("record_pos", F.col("record_pos") - 1) if bytes_ else out


#: Bytes per chunk of a file where lines are placed by their bytes.
CHUNK_BYTES = 1 << 19


def decode(recs: DataFrame, service: str, run_id: str, observed_at: str, include_raw: bool = False, strict: bool = False) -> DataFrame:
    """Events of records: JSON, else tab-separated text, else generic text, else the whole as message.

    Text that begins like JSON but is none is ``degraded``.  ``offset`` is the
    record's place (see ``records``).  strict: generic text of several lines
    is whole message, as an older reader had it.
    """
    df = recs.withColumn("_list", _parsed(F.col("raw"))).withColumn("_record", F.when(F.size("_list") == 1, F.get("_list", F.lit(0))))
    df = df.withColumn("_json", F.col("_record").isNotNull()).withColumn("_tabs", F.split("raw", "\t", 5)).drop("_list")
    generic = GENERIC_STRICT if strict else GENERIC
    df = df.withColumn("_form", F.when(F.col("_json"), "json").when(F.size("_tabs") == 5, "tab").when(F.col("raw").rlike(generic), "generic").otherwise("raw"))
    by = lambda **c: F.coalesce(*[F.when(F.col("_form") == k, v) for k, v in c.items()])
    head = F.split(F.trim(F.get("_tabs", F.lit(1))), r"\s+")
    g = lambda i: F.regexp_extract("raw", generic, i)
    field = {k: _json_field(v) for k, v in KEYS.items()}
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    sev = by(json=F.coalesce(field["severity"], F.lit("INFO")), tab=F.get(head, F.lit(0)), generic=g(2), raw=F.lit("INFO"))
    df = df.withColumn("_sev", text.canonical_severity(sev)).withColumn("body", F.coalesce(by(json=F.coalesce(field["body"], F.col("raw")), tab=strip(F.get("_tabs", F.lit(4))), generic=F.regexp_replace(g(3), r"^[ \t\-]+|[ \t\-]+\z", "")), strip(F.col("raw"))))
    location = F.to_json(F.struct(F.get("_tabs", F.lit(3)).alias("code.function"), F.get("_tabs", F.lit(2)).alias("code.location")))
    only = {k: by(json=field[k]) for k in ("service_instance_id", "worker_id", "trace_id", "span_id", "container_id", "k8s_pod_name", "k8s_container_name")}
    df = df.select(
        F.lit(run_id).alias("run_id"), "source", F.col("record_pos").alias("offset"), F.col("line_count").cast("long").alias("line_count"),
        by(json=field["timestamp"], tab=F.get("_tabs", F.lit(0)), generic=g(1)).alias("timestamp"), F.lit(observed_at).alias("observed_timestamp"),
        F.col("_sev").alias("severity_text"), text.severity_number(F.col("_sev")).alias("severity_number"), "body",
        F.when(F.col("_json"), "json").otherwise("text").alias("parse_format"), F.when(~F.col("_json") & F.col("raw").rlike(r"^\s*[\{\[]"), "degraded").otherwise("ok").alias("parse_status"),
        F.coalesce(by(json=field["service_name"]), F.lit(service)).alias("service_name"), F.lit(service).alias("_scan_service"),
        by(json=field["thread_name"], tab=F.get(head, F.lit(1))).alias("thread_name"), by(json=field["process_name"], tab=F.get(head, F.lit(2))).alias("process_name"),
        by(json=field["process_pid"]).try_cast("long").alias("process_pid"), F.coalesce(by(json=field["server_kind"]), text.server_kind(F.col("raw"), F.lit(service))).alias("server_kind"),
        F.coalesce(by(json=F.col("_record").getField("attributes"), tab=location), F.lit("{}")).alias("attributes_json"), F.coalesce(by(json=F.col("_record").getField("resource")), F.lit("{}")).alias("resource_json"),
        ids.stable_id(F.col("raw")).alias("raw_hash"), (F.col("raw") if include_raw else F.lit(None).cast("string")).alias("raw"), *[c.alias(k) for k, c in only.items()],
    )
    # the id of a template uses the service of the scan, so a record's own service name does not split templates
    own = df.withColumnRenamed("service_name", "_own_service").withColumnRenamed("_scan_service", "service_name")
    named = templates.identify(own).drop("headline").drop("service_name").withColumnRenamed("_own_service", "service_name")
    return align(named.withColumn("event_id", ids.event_id(F.col("run_id"), F.col("source"), F.col("offset"), F.col("raw_hash"))), schemas.EVENTS)
