"""Problem 7: items of varying length into containers of fixed capacity.

Best-fit decreasing with a segment tree over remaining capacities: the tightest
open container that still takes an item is found in logarithmic time.  Items
are spread over shards of about :data:`SHARD_ITEMS` by a hash, so each shard
holds sizes like the whole; every (capacity, shard) is packed on its own.
:func:`fill` compares the number of containers with the least that any packing
could need; the README has measured figures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items per shard.
SHARD_ITEMS = 25_000


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity: how many open containers have them. Only nodes that hold any are kept."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, (capacity + 1)).bit_length()
        self.count: dict[int, int] = {}
        self.open: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.open.setdefault(remaining, []).append(container)
        count, i = self.count, remaining + self.size
        while i:
            count[i] = count.get(i, 0) + 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining, container) of the tightest open container with at least ``need``, removed; None if there is none."""
        c = self.count
        i = need + self.size
        if i not in c:
            while i > 1 and (i & 1 or i + 1 not in c):  # up to the first subtree to the right that has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if 2 * i in c else 2 * i + 1
        remaining = i - self.size
        container = self.open[remaining].pop()
        while i:
            if c[i] == 1:
                del c[i]
            else:
                c[i] -= 1
            i >>= 1
        return remaining, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(container of each item, number of containers); items of 1..capacity, taken from the longest to the shortest."""
    where = [0] * len(sizes)
    tree, used = RemainingTree(capacity), 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = tree.take(sizes[i])
        if got is None:
            remaining, container = capacity, used
            used += 1
        else:
            remaining, container = got
        where[i] = container
        if remaining > sizes[i]:
            tree.add(remaining - sizes[i], container)
    return where, used


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Containers of one (capacity, shard)."""
    capacity, shard = int(pdf["capacity_tokens"].iloc[0]), int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
    doc, n = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy()
    whole = n // capacity * (n > capacity)  # pieces that fill a container
    rest = n - whole * capacity
    k = np.flatnonzero(rest > 0)
    where, used = best_fit_decreasing(rest[k].tolist(), capacity)
    pieces = np.repeat(np.arange(len(n)), whole)
    piece_no = np.arange(len(pieces)) - np.repeat(np.cumsum(whole) - whole, whole)
    base = shard << 32
    out = pd.DataFrame({
        "container_id": np.concatenate((np.array(where, dtype=np.int64), used + np.arange(len(pieces)))) + base,
        "doc_id": np.concatenate((doc[k], doc[pieces])), "piece_no": np.concatenate((whole[k], piece_no)),
        "n_tokens": np.concatenate((rest[k], np.full(len(pieces), capacity))),
    })
    out["from_token"] = out["piece_no"] * capacity
    out.insert(0, "capacity_id", int(pdf["capacity_id"].iloc[0]))
    return out


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) under a byte-level tokenizer: one token per UTF-8 byte and one at the end; a null text is an empty one."""
    return documents.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("n_tokens"))


def pack(items: DataFrame, capacities: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece: capacity_id, container_id, doc_id, piece_no, from_token, n_tokens.

    items: doc_id, n_tokens (rows with null or less than 1 are left out);
    every row is an item of its own.  An item is cut only if it is longer than
    the container: into full pieces and a rest that is packed like any item.
    Capacities that are null or less than 1 are left out; there may be any
    number, they are joined to the shards.
    """
    rows = items.where("doc_id is not null and n_tokens >= 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
    n = items.where("doc_id is not null").count()  # for the number of shards only: reads no text
    shards = max(1, round(n / shard_items))
    # copies of a row are counted, then spread over the shards like other items
    copies = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("_c")).select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_copy"))
    sharded = copies.select(F.pmod(F.xxhash64("doc_id", "n", "_copy"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n")
    given = capacities.where("capacity_id is not null and capacity_tokens >= 1").select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    per_shard = given.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    schema = "capacity_id int, container_id long, doc_id long, piece_no long, from_token long, n_tokens long"
    columns = [c.split()[0] for c in schema.split(", ")]
    return sharded.join(per_shard, "shard").groupBy("capacity_id", "capacity_tokens", "shard").applyInPandas(lambda pdf: _pack(pdf)[columns], schema)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, the least number any packing needs (all tokens over the capacity, rounded up), and the share of room that is used."""
    used = packed.groupBy("capacity_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    least = F.expr("(tokens + capacity_tokens - 1) div capacity_tokens")
    return used.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id").select("capacity_id", "capacity_tokens", "containers", least.alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used_share"))
