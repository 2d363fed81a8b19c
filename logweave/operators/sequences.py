"""Ordered-sequence operators over log events: restarts, outages, bursts, rates, first errors, replay.

Orders within a file or service are cut into chunks: windows run inside a
chunk, and one row per chunk carries what the chunks before leave (the last
value, a count), so no file, service or dependency is one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Messages of a service start.
BOOT = r"(?i)\b(?:Starting gunicorn|Starting Granian|Granian server starting|Booting worker with pid|Application startup complete)\b"
# Those of them that come first.
BOOT_HEAD = r"(?i)\b(?:Starting gunicorn|Starting Granian|Granian server starting)\b"
# Messages that show a dependency down, and up again; all ignore case.
DOWN = {
    "kafka": r"(?i)\b_ALL_BROKERS_DOWN\b|\b_TRANSPORT\b|\bbrokers?\s+are\s+down\b|kafka:[^\"']*?Connect\s+to\s+\S+\s+failed|\bbroker\s+transport\s+failure\b|\bGroupCoordinator\b[^\"]*?\bfailed\b",
    "mongo": r"(?i)\bMongo(?:DB)?[^\n]{0,80}\b(?:unreachable|timed?\s*out|not\s+master|closed|disconnect)\b|\bServerSelectionTimeoutError\b|\bAutoReconnect\b",
    "elasticsearch": r"(?i)\belasticsearch\b[^\n]{0,80}\b(?:unreachable|timed?\s*out|refused|circuit_breaking)\b|\bConnectionTimeout\b.*\belasticsearch\b",
}
UP = {
    "kafka": r"(?i)\b(?:re)?joined\s+group\b|\bGroup\s+\S+\s+heartbeat\b|\bbroker\s+\S+\s+(?:up|connected)\b|\bpartitions\s+assigned\b|\bsubscribed\s+to\s+topic\b|\bmessage\s+(?:produced|delivered)\b",
    "mongo": r"(?i)\bConnected\s+to\s+mongo(?:db)?\b|\bmongo(?:db)?\b[^\n]{0,40}\b(?:reconnected|connected|topology\s+opened)\b",
    "elasticsearch": r"(?i)\belasticsearch\b[^\n]{0,40}\b(?:connected|ready)\b",
}
BOOT_GAP_US = 30_000_000


#: Length of a chunk in the unit of the order (lines or bytes).
CHUNK = 1 << 16


def _chunked(df: DataFrame, by: Sequence[str], order: str, chunk: int) -> DataFrame:
    """Add ``_g``, the group as one value that is never null, and ``_chunk`` of the order (-1 for a null)."""
    return df.withColumn("_g", F.struct(*[F.col(c) for c in by])).withColumn("_chunk", F.coalesce(F.expr(f"`{order}` div {int(chunk)}"), F.lit(-1).cast("long")))


def _inside(order: str) -> Window:
    return Window.partitionBy("_g", "_chunk").orderBy(order)


def _earlier() -> Window:
    return Window.partitionBy("_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _last_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add the last value that is not null of the rows before in the group (chunked rows)."""
    ends = df.groupBy("_g", "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    carried = ends.select("_g", "_chunk", F.last("_end", ignorenulls=True).over(_earlier()).alias("_carried"))
    near = F.last(value, ignorenulls=True).over(_inside(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_near", near).join(carried, ["_g", "_chunk"]).withColumn(out, F.coalesce("_near", "_carried")).drop("_near", "_carried")


def _running_count(df: DataFrame, order: str, flag: str, out: str) -> DataFrame:
    """Add the number of rows with the flag up to each row of the group (chunked rows)."""
    counts = df.groupBy("_g", "_chunk").agg(F.count_if(flag).alias("_n"))
    carried = counts.select("_g", "_chunk", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_carried"))
    near = F.count_if(flag).over(_inside(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_near", near).join(carried, ["_g", "_chunk"]).withColumn(out, (F.col("_near") + F.col("_carried")).cast("long")).drop("_near", "_carried")


def boots(events: DataFrame, by: Sequence[str], order: str, ts_us: str = "ts_us", body: str = "body", gap_us: int = BOOT_GAP_US, chunk: int = CHUNK) -> DataFrame:
    """Confirmed restarts: by.., seq (from 1), boot_order, started_us.

    Markers in file order; one begins a restart unless its time is known and at
    most ``gap_us`` after the last known marker time (coalesced markers count
    too; a time before it coalesces as well).
    """
    marks = events.where(F.col(body).rlike(BOOT)).select(*by, F.col(order).alias("boot_order"), F.col(ts_us).alias("_us"))
    marks = _last_before(_chunked(marks, by, "boot_order", chunk).repartition("_g", "_chunk"), "boot_order", "_us", "_last")
    new = F.col("_last").isNull() | F.col("_us").isNull() | (F.col("_us") - F.col("_last") > gap_us)
    return _running_count(marks.where(new).withColumn("_new", F.lit(True)), "boot_order", "_new", "seq").select(*by, "seq", "boot_order", F.col("_us").alias("started_us"))


def with_instances(events: DataFrame, boot: DataFrame, by: Sequence[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Add service_instance_seq (0 before the first restart) and service_instance_started_us.

    Per chunk of a file that has events: the restarts inside it, and the last
    one before it. An event meets the one whose stretch of the chunk it is in.
    """
    rows = _chunked(events, by, order, chunk)
    starts = _chunked(boot.select(*by, "boot_order", "seq", "started_us"), by, "boot_order", chunk).select("_g", "_chunk", F.struct("boot_order", "seq", "started_us").alias("_b"))
    none = F.lit(None).cast(starts.schema["_b"].dataType)
    ends = starts.groupBy("_g", "_chunk").agg(F.max("_b").alias("_b")).unionByName(rows.select("_g", "_chunk").distinct().withColumn("_b", none)).groupBy("_g", "_chunk").agg(F.max("_b").alias("_b"))
    carried = ends.select("_g", "_chunk", F.last("_b", ignorenulls=True).over(_earlier()).alias("_b")).where("_b is not null")
    stretch = carried.unionByName(starts).select("_g", "_chunk", F.col("_b.boot_order").alias("_from"), F.col("_b.seq").alias("_seq"), F.col("_b.started_us").alias("_started"))
    stretch = stretch.withColumn("_to", F.lead("_from").over(_inside("_from"))).withColumnsRenamed({"_g": "_bg", "_chunk": "_bc"})
    on = (F.col("_g") == F.col("_bg")) & (F.col("_chunk") == F.col("_bc")) & (F.col(order) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(order) < F.col("_to")))
    joined = rows.join(stretch, on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in events.columns if c not in ("service_instance_seq", "service_instance_started_us")], F.coalesce("_seq", F.lit(0).cast("long")).alias("service_instance_seq"), F.col("_started").alias("service_instance_started_us"))


def keep_instances(annotated: DataFrame, boot: DataFrame, by: Sequence[str], spec: str | int) -> DataFrame:
    """Events of the last N restarts of their file: ``all``, ``last`` or a number (not above 0: last); files without restart keep all."""
    if spec == "all":
        return annotated
    if spec == "last":
        n = 1
    else:
        try:
            n = max(1, int(spec))
        except (TypeError, ValueError):
            raise ValueError(f"instances must be 'all', 'last' or a number, not {spec!r}") from None
    top = boot.groupBy(*by).agg(F.max("seq").alias("_top")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_top")
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    return annotated.join(top, on, "left").where(F.col("_top").isNull() | (F.col("service_instance_seq") > F.col("_top") - n)).drop("_top", *[f"_k{i}" for i in range(len(by))])


def instance_counts(annotated: DataFrame, by: Sequence[str]) -> DataFrame:
    return annotated.groupBy(*by, "service_instance_seq").agg(F.count(F.lit(1)).alias("event_count"))


def connectivity_marks(events: DataFrame, keep: Sequence[str], body: str = "body") -> DataFrame:
    """Rows that show a dependency down or up (down has precedence): keep.., dependency, kind."""
    found = F.array(*[F.when(F.col(body).rlike(DOWN[d]), F.struct(F.lit(d).alias("dependency"), F.lit("down").alias("kind"))).when(F.col(body).rlike(UP[d]), F.struct(F.lit(d).alias("dependency"), F.lit("up").alias("kind"))) for d in DOWN])
    return events.select(*keep, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select(*keep, "m.*")


def connectivity_incidents(marks: DataFrame, by: Sequence[str], order: str, ts_us: str = "ts_us", chunk: int = CHUNK) -> DataFrame:
    """Outages per group and dependency in file order: no, down_us, up_us (null while open), duration_s, down_events.

    An outage begins with a down marker after anything else than down, and ends
    with the next up marker.
    """
    g = [*by, "dependency"]
    rows = _chunked(marks.select(*g, order, ts_us, "kind"), g, order, chunk).repartition("_g", "_chunk")
    begins = (F.col("kind") == "down") & (F.coalesce("_prior", F.lit("up")) != "down")
    rows = _running_count(_last_before(rows, order, "kind", "_prior").withColumn("_begins", begins), order, "_begins", "no").where("no > 0")
    first = lambda kind: F.min_by(ts_us, F.when(F.col("kind") == kind, F.col(order)))
    out = rows.groupBy(*g, "no").agg(first("down").alias("down_us"), first("up").alias("up_us"), F.count_if(F.col("kind") == "down").alias("down_events"))
    return out.withColumn("duration_s", F.greatest((F.col("up_us") - F.col("down_us")) / 1e6, F.lit(0.0)))


def connectivity_state(marks: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Last state per group and dependency with the numbers of down and up markers."""
    return marks.groupBy(*by, "dependency").agg(F.max_by("kind", order).alias("state"), F.count_if(F.col("kind") == "down").alias("down_events"), F.count_if(F.col("kind") == "up").alias("up_events"))


def bursts(events: DataFrame, key: Sequence[str], ts_us: str, threshold: int, severity: str = "severity_text", order: str = "event_id") -> DataFrame:
    """Minutes in which a key has at least ``threshold`` events: key.., minute_us, n, severity of the first."""
    minute = (F.floor(F.col(ts_us) / F.lit(60_000_000)) * 60_000_000).cast("long")
    return events.where(F.col(ts_us).isNotNull()).groupBy(*key, minute.alias("minute_us")).agg(F.count(F.lit(1)).alias("n"), F.min_by(severity, order).alias("severity_text")).where(F.col("n") >= threshold)


def first_code_errors(annotated: DataFrame, by: Sequence[str], order: str, ts_us: str = "ts_us") -> DataFrame:
    """First event of kind ``code`` with a time per restart, in file order."""
    code = annotated.where((F.col("issue_kind") == "code") & F.col(ts_us).isNotNull())
    return code.groupBy(*by, "service_instance_seq").agg(F.min_by(F.struct(F.col(ts_us).alias("first_us"), "template_id", "severity_text"), order).alias("f")).select(*by, "service_instance_seq", "f.*")


def survival(annotated: DataFrame, by: Sequence[str], order: str, ts_us: str = "ts_us") -> DataFrame:
    """Restarts per group: instances, with_first_error, survived."""
    instances = annotated.select(*by, "service_instance_seq").distinct()
    errors = first_code_errors(annotated, by, order, ts_us).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("service_instance_seq").alias("_seq"))
    on = F.col("service_instance_seq") == F.col("_seq")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return instances.join(errors, on, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("instances"), F.count("_seq").alias("with_first_error"), (F.count(F.lit(1)) - F.count("_seq")).alias("survived"))


def rolling_rates(samples: DataFrame, by: Sequence[str], second: str, value: str, widths: Sequence[int] = (5, 30, 60)) -> DataFrame:
    """Trailing sums over the last seconds divided by the width; samples are summed per second first, so a busy key is at most one row a second."""
    per = samples.groupBy(*by, F.col(second).cast("long").alias("second")).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(*by).orderBy("second")
    return per.select(*by, "second", *[(F.sum("v").over(w.rangeBetween(-n + 1, 0)) / n).alias(f"rate_{n}s") for n in widths])


REPLAY = ("ts_us", "kind", "label", "instance_seq", "template_id", "n", "dependency", "severity_text")


def replay(by: Sequence[str], boot: DataFrame, first_errors: DataFrame, burst: DataFrame, incidents: DataFrame) -> DataFrame:
    """Timeline items of all kinds, each with :data:`REPLAY` columns (null where a kind has none)."""

    def items(df: DataFrame, kind: str, ts: str, label: Column, **cols: Column) -> DataFrame:
        have = {"ts_us": F.col(ts), "kind": F.lit(kind), "label": label, **cols}
        types = {"ts_us": "long", "instance_seq": "long", "n": "long"}
        return df.select(*by, *[have.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in REPLAY])

    seq = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    out = items(boot, "boot", "started_us", F.concat(F.lit("service instance "), seq("seq"), F.lit(" boot")), instance_seq=F.col("seq"))
    out = out.unionByName(items(first_errors, "first_code_error", "first_us", F.concat(F.lit("first code error in instance "), seq("service_instance_seq")), instance_seq=F.col("service_instance_seq"), template_id=F.col("template_id"), n=F.lit(1), severity_text=F.col("severity_text")))
    out = out.unionByName(items(burst, "template_burst", "minute_us", F.concat(F.lit("burst of "), F.col("n").cast("string"), F.lit(" events for "), F.substring("template_id", 1, 12)), template_id=F.col("template_id"), n=F.col("n"), severity_text=F.col("severity_text")))
    out = out.unionByName(items(incidents, "connectivity_down", "down_us", F.concat("dependency", F.lit(" down")), dependency=F.col("dependency")))
    return out.unionByName(items(incidents.where("up_us is not null"), "connectivity_up", "up_us", F.concat("dependency", F.lit(" up")), dependency=F.col("dependency")))
