"""Incremental operators: anomaly detection with state, bursts, rates, restart sessions, and materialising sinks."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.operators import ingest, templates
from logweave.operators.combine import combine_batches
from logweave.session import ship
from logweave.sources import files
from logweave.streaming import growing

_OUT = "kind string, template_id string, observed_count long, baseline_mean double, baseline_p95 double, z_score double"
_STATE = "total long, novel boolean, regressed boolean"
INFINITE = 1e308


def _detect(z_threshold: float, min_count: int, novelty_min: int):
    """Per template: the running count, and each kind of anomaly once."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, novel, regressed = state.get if state.exists else (0, False, False)
        base = None
        for pdf in batches:
            if not len(pdf):
                continue
            total += int(pdf["n"].sum())
            base = pdf.iloc[0]
        out = []
        if base is not None and pd.isna(base["mean_count"]):
            if total >= novelty_min and not novel:
                novel = True
                out.append(("new_template", key[0], total, None, None, None))
        elif base is not None:
            mean, std, p95 = float(base["mean_count"]), float(base["std_count"]), float(base["p95_count"])
            z = (total - mean) / std if std > 1e-9 else (INFINITE if total > mean else 0.0)
            if total >= min_count and total > p95 and z > z_threshold and not regressed:
                regressed = True
                out.append(("regression", key[0], total, mean, p95, z))
        state.update((total, novel, regressed))
        yield pd.DataFrame(out, columns=["kind", "template_id", "observed_count", "baseline_mean", "baseline_p95", "z_score"])

    return run


def anomalies(events: DataFrame, baseline: DataFrame, z_threshold: float = 3.0, min_count: int = 5, novelty_min: int = 3) -> DataFrame:
    """Anomalies of a stream of events (template_id) against a baseline (template_id, mean_count, std_count, p95_count).

    Every micro-batch is counted where it is read, so a template with a third
    of the events reaches its task as a row per Arrow batch; the state is one
    row per template and survives restarts with the checkpoint.
    """
    b = baseline.select(F.col("template_id").alias("_b"), "mean_count", "std_count", "p95_count")
    rows = combine_batches(events.where("template_id is not null"), ["template_id"], count="n")
    joined = rows.join(b, F.col("template_id") == F.col("_b"), "left").drop("_b")
    return joined.groupBy("template_id").applyInPandasWithState(_detect(z_threshold, min_count, novelty_min), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame, ts: str, threshold: int = 50, delay: str = "1 hour") -> DataFrame:
    """Minutes in which a template has at least ``threshold`` events; minutes close ``delay`` after their end."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute"), "template_id").agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("n") >= threshold).select(F.col("window.start").alias("minute"), "template_id", "n")


def rates(events: DataFrame, ts: str, value: str, width: str = "5 seconds", slide: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Sliding sums by service."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), "service_name").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def restart_sessions(events: DataFrame, ts: str, gap: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Restart markers of a service as sessions."""
    from logweave.operators.sequences import BOOT

    marks = events.where(F.col("body").rlike(BOOT)).withWatermark(ts, delay)
    return marks.groupBy(F.session_window(ts, gap), "service_name").agg(F.count(F.lit(1)).alias("markers")).select(F.col("session_window.start").alias("started_at"), "service_name", "markers")


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None, settle_s: float = 60.0) -> DataFrame:
    """New lines of the log files of a folder as a stream (source, first_line, text), see :class:`logweave.streaming.growing.GrowingFiles`.

    With ``files_per_batch``, or in a file system other than the local or a
    mounted one, only closed files are read, each once and whole: what is
    appended later is not seen.
    """
    if files_per_batch or "://" in folder.removeprefix("file://"):
        reader = spark.readStream.format("text").option("wholetext", True)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.load(folder).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source"), F.lit(1).cast("long").alias("first_line"), F.col("value").alias("text"))
    ship(spark)
    spark.dataSource.register(growing.GrowingFiles)
    path = re.sub("^file:/+", "/", folder)
    if not growing.listed(path) and not os.path.isdir(path):
        raise FileNotFoundError(path)
    return spark.readStream.format("growing_files").option("folder", os.path.abspath(path)).option("settle_s", str(settle_s)).load()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the ``batch=N`` folders below a path, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def materialize(stream: DataFrame, out: str, checkpoint: str, service: str, run_id: str, every: str | None = None):
    """Append the events of new lines and bring the templates up to date; returns the running query.

    Each micro-batch is a folder of its own, so a batch that is run again
    replaces itself.  Templates are merged from their aggregates up to the
    batch before and those of the batch: no event is read twice.  A record
    whose lines come in two batches is two records.  every: seconds or other
    interval of a query that goes on; without it all there is is read once.
    """

    def step(batch: DataFrame, number: int) -> None:
        lines = batch.select("source", "first_line", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("_n", "line")).select("source", (F.col("_n") + F.col("first_line")).alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))
        spark = batch.sparkSession
        files.write_table(ingest.decode(ingest.records(lines), service, run_id, ""), f"{out}/events/batch={number}")
        partial = templates.partial_templates(spark.read.parquet(f"{out}/events/batch={number}"))
        older = [n for n in _numbers(spark, f"{out}/state") if n < number]
        if older:
            partial = templates.merge_templates(partial.unionByName(spark.read.parquet(f"{out}/state/batch={older[-1]}")))
        files.write_table(partial, f"{out}/state/batch={number}")
        files.write_table(templates.finished_templates(spark.read.parquet(f"{out}/state/batch={number}")), f"{out}/templates.parquet")
        for n in older[:-1]:  # the one before stays, for this batch to be run again
            _remove(spark, f"{out}/state/batch={n}")

    how = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**how).start()


def run_until(query, max_runtime_s: float | None = None, idle_ticks: int | None = None, stop: Callable[[], bool] | None = None, tick_s: float = 1.0) -> str:
    """Wait for a running query until it ends, has run so long, had no new rows for so many ticks, or ``stop`` says so; the reason."""
    began, idle, last = time.monotonic(), 0, None
    while not query.awaitTermination(tick_s):
        now = progress(query)
        idle = 0 if now["batch"] != last and now["rows"] else idle + 1
        last = now["batch"]
        reason = "max_runtime" if max_runtime_s is not None and time.monotonic() - began >= max_runtime_s else "idle" if idle_ticks is not None and idle >= idle_ticks else "stopped" if stop is not None and stop() else None
        if reason:
            query.stop()
            return reason
    return "ended"


def to_ndjson(stream: DataFrame, out: str, checkpoint: str):
    """Append rows of a stream as JSON lines; returns the running query."""
    return stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").json(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> dict:
    """Snapshot of a running query: rows and rates of its last micro-batch."""
    p = query.lastProgress or {}
    get = lambda k: p.get(k) if isinstance(p, dict) else getattr(p, k, None)
    return {"name": query.name, "active": query.isActive, "batch": get("batchId"), "rows": get("numInputRows"), "rows_per_second": get("processedRowsPerSecond")}
