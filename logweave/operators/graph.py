"""Edge lists: service dependencies and templates that occur together on a worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_dependencies(incidents: DataFrame) -> DataFrame:
    """(service_name, dependency): runs in which it shows, and incidents."""
    return incidents.groupBy("service_name", "dependency").agg(F.count_distinct("run_id").alias("runs_with_dependency"), F.count(F.lit(1)).alias("incidents"))


def cooccurrence(events: DataFrame, lag_us: int = 30_000_000, min_count: int = 1, worker: str = "worker_id", ts_us: str = "ts_us", template: str = "template_id") -> DataFrame:
    """Ordered pairs of different templates on one worker at most ``lag_us`` apart: n, p_a, p_b, lift.

    Pairs are in (time, template) order.  Events are first counted per
    (worker, time, template), so repeats are one row; they meet only in the
    same or the next bucket of ``lag_us``.  A null worker is the worker ''.
    """
    e = events.where(F.col(ts_us).isNotNull() & (F.coalesce(F.col(template), F.lit("")) != ""))
    e = e.groupBy(F.coalesce(F.col(worker), F.lit("")).alias("w"), F.col(ts_us).alias("t"), F.col(template).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    bucket = F.floor(F.col("t") / F.lit(lag_us))
    a = e.withColumn("k", F.explode(F.array(bucket, bucket + 1))).select("w", "k", F.col("t").alias("ta"), F.col("id").alias("a"), F.col("c").alias("ca"))
    b = e.select("w", bucket.alias("k"), F.col("t").alias("tb"), F.col("id").alias("b"), F.col("c").alias("cb"))
    after = ((F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))) & (F.col("tb") - F.col("ta") <= lag_us) & (F.col("a") != F.col("b"))
    pairs = a.join(b, ["w", "k"]).where(after).groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("n")).where(F.col("n") >= min_count)
    counts = e.groupBy("id").agg(F.sum("c").alias("m"))
    total = counts.agg(F.sum("m").alias("total"))
    shares = counts.withColumn("total", total.scalar()).withColumn("p", F.col("m") / F.col("total"))
    sa, sb = shares.select(F.col("id").alias("a"), F.col("p").alias("p_a"), "total"), shares.select(F.col("id").alias("b"), F.col("p").alias("p_b"))
    out = pairs.join(sa, "a").join(sb, "b")
    return out.select(F.col("a").alias("template_a"), F.col("b").alias("template_b"), "n", "p_a", "p_b", (F.col("n") / (F.col("p_a") * F.col("p_b") * F.col("total"))).alias("lift"))
