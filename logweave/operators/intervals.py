"""Problem 5: overlapping and gapped time intervals per entity.

Two-level merge: intervals are clipped into time shards and merged inside each
(entity, shard), so an entity with a third of all rows is many groups.  An
interval over many shards is two clipped ends and one piece for the shards it
covers whole, which stands in the first of them.  One row per (entity, shard)
then tells how far the shards before reach and which period is open there;
with it the pieces that touch a shard boundary are stitched, and pieces inside
a covered stretch are dropped where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.instants import clean_name, instant

#: Length of a time shard in the unit of the intervals: an hour of milliseconds.
SHARD = 3_600_000


def _shard(c: str, shard: int) -> Column:
    return F.expr(f"({c} - pmod({c}, {int(shard)})) div {int(shard)}")


def _periods(df: DataFrame, entity: Sequence[str], start: str, end: str, shard: int) -> DataFrame:
    """(_e, sh, s, e): merged intervals with the shard of their start, hash-partitioned by (_e, sh). ``_e`` is never null, its fields may be."""
    rows = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(entity)]).alias("_e"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("e > s")
    cut = rows.withColumn("lo", _shard("s", shard)).withColumn("hi", _shard("(e - 1)", shard))
    piece = lambda sh, a, z: F.struct(F.expr(sh).alias("sh"), F.expr(a).cast("long").alias("s"), F.expr(z).cast("long").alias("e"))
    first, last = piece("lo", "s", f"(lo + 1) * {shard}"), piece("hi", f"hi * {shard}", "e")
    pieces = F.when(F.expr("lo = hi"), F.array(piece("lo", "s", "e"))).when(F.expr("hi = lo + 1"), F.array(first, last)).otherwise(F.array(first, last, piece("lo + 1", f"(lo + 1) * {shard}", f"hi * {shard}")))
    # of pieces with one start the longest holds: combined before the shuffle, many intervals may end in one shard
    clipped = cut.select("_e", F.explode(pieces).alias("p")).groupBy("_e", "p.sh", "p.s").agg(F.max("p.e").alias("e")).where("sh is not null")  # said for both readers of the shuffle, which the join below would else tell apart
    in_shard = Window.partitionBy("_e", "sh").orderBy("s")
    reached = F.max("e").over(in_shard.rowsBetween(Window.unboundedPreceding, -1))
    marked = clipped.repartition("_e", "sh").withColumn("_new", F.when(F.col("s") <= reached, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.groupBy("_e", "sh", "_no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    # per shard: how far the shards before reach, and the start of the last period that begins in them
    before = Window.partitionBy("_e").orderBy("sh").rowsBetween(Window.unboundedPreceding, -1)
    shards = local.groupBy("_e", "sh").agg(F.max("s").alias("_last"), F.max("e").alias("_to")).withColumn("_reach", F.max("_to").over(before))
    opened = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    shards = shards.withColumn("_opened", opened).withColumn("_open", F.last("_opened", ignorenulls=True).over(before)).select("_e", "sh", "_reach", "_open")
    begins = F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))
    stitched = local.join(shards, ["_e", "sh"]).where(begins | (F.col("e") > F.col("_reach"))).select("_e", F.when(begins, F.col("s")).otherwise(F.col("_open")).alias("s"), "e")
    return stitched.withColumn("sh", _shard("s", shard)).where("sh is not null").repartition("_e", "sh").groupBy("_e", "sh", "s").agg(F.max("e").alias("e"))


def _next_start(periods: DataFrame) -> DataFrame:
    """Add ``_to``, the start of the entity's next period: inside its shard, or the first of the next shard that has any."""
    in_shard = Window.partitionBy("_e", "sh").orderBy("s")
    later = periods.groupBy("_e", "sh").agg(F.min("s").alias("_first"), F.max("e").alias("_any")).select("_e", "sh", F.lead("_first").over(Window.partitionBy("_e").orderBy("sh")).alias("_later"))
    return periods.withColumn("_next", F.lead("s").over(in_shard)).join(later, ["_e", "sh"]).withColumn("_to", F.coalesce("_next", "_later"))


def _entity(entity: Sequence[str]) -> list[Column]:
    return [F.col(f"_e.k{i}").alias(c) for i, c in enumerate(entity)]


def merge_intervals(df: DataFrame, entity: Sequence[str], start: str, end: str, shard: int = SHARD) -> DataFrame:
    """(entity, start, end) of the merged intervals.

    Intervals with a null bound or an end not after the start are ignored;
    null entities are one entity each, as in GROUP BY.
    """
    return _periods(df, entity, start, end, shard).select(*_entity(entity), F.col("s").alias(start), F.col("e").alias(end))


def gaps(periods: DataFrame, entity: Sequence[str], start: str, end: str, shard: int = SHARD) -> DataFrame:
    """The spaces between one merged period of an entity and the next."""
    keyed = periods.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(entity)]).alias("_e"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    led = _next_start(keyed.withColumn("sh", _shard("s", shard)).where("sh is not null").repartition("_e", "sh"))
    return led.where("_to is not null").select(*_entity(entity), F.col("e").alias(start), F.col("_to").alias(end))


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, shard: int = SHARD) -> DataFrame:
    """(entity, period_kind, start, end): merged intervals (``down``) and the gaps behind them (``gap``), from one evaluation."""
    kind = lambda k, a, z: F.struct(F.lit(k).alias("k"), F.col(a).alias("a"), F.col(z).alias("z"))
    led = _next_start(_periods(df, entity, start, end, shard))
    both = led.select("_e", F.explode(F.array(kind("down", "s", "e"), kind("gap", "e", "_to"))).alias("p")).where("p.z is not null")
    return both.select(*_entity(entity), F.col("p.k").alias("period_kind"), F.col("p.a").alias(start), F.col("p.z").alias(end))


def downtime(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """p5: run_id, dependency, period_kind (down or gap), start_ms, end_ms.

    An open incident lasts until its run's ``finished_at``; unreadable times,
    an unknown run of an open incident and ends not after their start leave the
    incident out.
    """
    finished = runs.groupBy("run_id").agg(F.max(F.unix_micros(F.col("finished_at").cast("timestamp"))).alias("_fin"))
    rows = incidents.select("run_id", clean_name("dependency").alias("dependency"), instant("down_at").alias("_a"), F.col("up_at"), instant("up_at").alias("_b"))
    rows = rows.join(finished, "run_id", "left").withColumn("_b", F.when(F.col("up_at").isNull(), F.col("_fin")).otherwise(F.col("_b")))
    ms = lambda c: F.floor(F.col(c) / 1000).cast("long")
    rows = rows.where("_b > _a").select("run_id", "dependency", ms("_a").alias("start_ms"), ms("_b").alias("end_ms"))
    keys = ["run_id", "dependency"]
    return periods_and_gaps(rows, keys, "start_ms", "end_ms").select("run_id", "dependency", "period_kind", "start_ms", "end_ms")
