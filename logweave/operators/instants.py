"""Problem 6: mixed timestamp formats and time zones to one instant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.instants import CANONICAL, as_nullable, parse_instants

PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("ts_us", "observed_us")])


@F.pandas_udf(PAIR)
def instant_pair(ts: pd.Series, observed: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
    """Instants of a timestamp and of the timestamp at which it was observed (see ``parse_instants``)."""
    seen = parse_instants(observed, zone, order)
    return pd.DataFrame({"ts_us": as_nullable(*parse_instants(ts, zone, order, seen)), "observed_us": as_nullable(*seen)})


@F.pandas_udf(T.LongType())
def instant(ts: pd.Series) -> pd.Series:
    """Microseconds since 1970 UTC of texts that carry their zone; null for others."""
    return as_nullable(*parse_instants(ts))


def clean_name(c: Column | str) -> Column:
    """Names are compared trimmed and in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def service_zones(services: DataFrame) -> DataFrame:
    """One row per service: ``_service``, ``_zone``, ``_order`` (the smallest of several rows)."""
    return services.groupBy(clean_name("service_name").alias("_service")).agg(F.min(F.trim("time_zone")).alias("_zone"), F.min(clean_name("date_order")).alias("_order"))


def with_instants(df: DataFrame, services: DataFrame, service: Column, ts: str, observed: str | None = None) -> DataFrame:
    """Add ``ts_us`` and ``observed_us`` (null where unreadable).

    Local times are those of the row's service; for an unknown or null service
    they are unreadable.  The columns of ``df`` may have any other names.
    """
    z = F.broadcast(service_zones(services)) if _small(services) else service_zones(services)
    seen = F.col(observed) if observed else F.lit(None).cast("string")
    pair = instant_pair(F.col(ts), seen, F.col("_zone"), F.col("_order"))
    joined = df.withColumn("_service_key", service).join(z, F.col("_service_key") == F.col("_service"), "left")
    return joined.withColumn("_pair", pair).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_pair.ts_us").alias("ts_us"), F.col("_pair.observed_us").alias("observed_us"))


#: Largest services table (bytes, as the optimizer estimates it) that is broadcast; a larger one is joined as Spark chooses.
SERVICES_BROADCAST_BYTES = 8 << 20


def _small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SERVICES_BROADCAST_BYTES


def normalised_event_times(events: DataFrame, services: DataFrame) -> DataFrame:
    """(record_id, field_name, epoch_us) of ``timestamp`` and ``observed_timestamp`` of events.

    Only values that are not canonical already.  Null, empty and unreadable
    values, dates that do not exist and rows without ``event_id`` give no row;
    equal rows are given once.
    """
    odd = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(CANONICAL)
    rows = events.select("event_id", F.col("timestamp").alias("_ts"), F.col("observed_timestamp").alias("_obs"), clean_name("service_name").alias("_svc"))
    rows = rows.where(F.col("event_id").isNotNull() & (odd("_ts") | odd("_obs")))
    timed = with_instants(rows, services, F.col("_svc"), "_ts", "_obs")
    fields = F.array(
        F.when(odd("_ts"), F.struct(F.lit("timestamp").alias("field_name"), F.col("ts_us").alias("epoch_us"))),
        F.when(odd("_obs"), F.struct(F.lit("observed_timestamp").alias("field_name"), F.col("observed_us").alias("epoch_us"))),
    )
    found = timed.select(F.col("event_id").alias("record_id"), F.explode(fields).alias("x")).where("x.epoch_us is not null")
    return found.select("record_id", "x.field_name", "x.epoch_us").distinct()


def normalised_record_times(entries: DataFrame, services: DataFrame) -> DataFrame:
    """The same for the time of JSON entries (``source``, ``record_pos``, ``parse_format``, ``ts_text`` of ``log_entries``)."""
    rows = entries.where((F.col("parse_format") == "json") & (F.col("ts_text") != "") & ~F.col("ts_text").rlike(CANONICAL))
    timed = with_instants(rows.select("source", "record_pos", "ts_text"), services, clean_name(F.try_element_at(F.split("source", "/"), F.lit(2))), "ts_text")
    return timed.where("ts_us is not null").select(F.concat_ws("#", "source", F.col("record_pos").cast("string")).alias("record_id"), F.lit("time").alias("field_name"), F.col("ts_us").alias("epoch_us")).distinct()
