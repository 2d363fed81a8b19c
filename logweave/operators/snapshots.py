"""Problem 2: what changed between consecutive full snapshots.

All snapshots are range-partitioned by key and kept sorted by key and snapshot:
one shuffle, after copies of a row were combined where they are read.  One pass
over a range is then a merge of every snapshot with the one before it, two
neighbouring rows of a key being the two pointers.  A hot service is split,
since ranges are cut by (service, template).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.combine import combine_batches
from logweave.operators.instants import clean_name
from logweave.session import sized

# The seven levels; anything else is INFO, WARN is WARNING.
SEVEN = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "FATAL")


def canonical_level(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up == "WARN", "WARNING").when(up.isin(*SEVEN), up).otherwise("INFO")


def same_text(c: Column) -> Column:
    """A text without what may differ: letter case and white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def snapshot_changes(snapshots: DataFrame, group: str, key: str, snapshot: str, delivered: str, compared: Sequence[Column]) -> DataFrame:
    """(group, key, snapshot, change_kind, n_compared_changed) per key and snapshot where it was added, removed or changed.

    snapshots: full contents, one row per key and snapshot; of repeated rows
    the one with the latest ``delivered`` holds (null is the earliest; between
    equal ones the largest compared values).  Each snapshot is compared with
    the previous one in which the group has any row; a group's first gives no
    row.  Rows with a null group, key or snapshot are no keys; a row with a
    null key still shows that its group was delivered.
    """
    values = [f"_v{i}" for i in range(len(compared))]
    rows = snapshots.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(snapshot).cast("long").alias("_s"), F.col(delivered).alias("_d"), *[c.alias(v) for c, v in zip(compared, values)]).where("_g is not null and _s is not null")
    # which snapshots each group has: groups x snapshots rows, combined on the map side
    in_order = Window.partitionBy("_g").orderBy("_s")
    calendar = sized(rows.select("_g", "_s").distinct().select("_g", "_s", F.row_number().over(in_order).alias("_no"), F.lead("_s").over(in_order).alias("_after")))
    ranged = combine_batches(rows.where("_k is not null"), ["_g", "_k", "_s", "_d", *values]).repartitionByRange("_g", "_k")
    # the row that holds in each snapshot; ranges are whole keys, so nothing is moved any more
    holds = ranged.groupBy("_g", "_k", "_s").agg(F.max(F.struct("_d", F.struct(*values).alias("v"))).alias("_m")).select("_g", "_k", "_s", F.col("_m.v").alias("_v")).join(calendar, ["_g", "_s"])
    walk = Window.partitionBy("_g", "_k").orderBy("_s")
    pair = holds.select("*", F.lag("_no").over(walk).alias("_pn"), F.lag("_v").over(walk).alias("_pv"), F.lead("_no").over(walk).alias("_nn"))
    consecutive = F.col("_pn").eqNullSafe(F.col("_no") - 1)
    differing = sum((F.when(F.col("_v")[v].eqNullSafe(F.col("_pv")[v]), 0).otherwise(1) for v in values), F.lit(0))
    events = F.array(
        F.when(~consecutive & (F.col("_no") > 1), F.struct(F.col("_s").alias("s"), F.lit("added").alias("kind"), F.lit(0).alias("n"))),
        F.when(consecutive & (differing > 0), F.struct(F.col("_s").alias("s"), F.lit("changed").alias("kind"), differing.alias("n"))),
        F.when(F.col("_after").isNotNull() & ~F.col("_nn").eqNullSafe(F.col("_no") + 1), F.struct(F.col("_after").alias("s"), F.lit("removed").alias("kind"), F.lit(0).alias("n"))),
    )
    found = pair.select("_g", "_k", F.explode(events).alias("e")).where("e is not null")
    return found.select(F.col("_g").alias(group), F.col("_k").alias(key), F.col("e.s").alias(snapshot), F.col("e.kind").alias("change_kind"), F.col("e.n").alias("n_compared_changed"))


def _key(c: str) -> Column:
    k = clean_name(c)
    return F.when(k != "", k)


def registry_changes(registry: DataFrame) -> DataFrame:
    """Changes of the template registry: service_name, template_id, snapshot_no, change_kind."""
    keyed = registry.select(_key("service_name").alias("service_name"), _key("template_id").alias("template_id"), "snapshot_no", "delivered_at", same_text(F.col("normalized_template")).alias("_text"), canonical_level(F.col("severity_text")).alias("_level"))
    found = snapshot_changes(keyed, "service_name", "template_id", "snapshot_no", "delivered_at", [F.col("_text"), F.col("_level")])
    return found.select("service_name", "template_id", "snapshot_no", "change_kind")
