"""Problem 3: per-key results where a few keys hold most rows.

Rows are range-partitioned and sorted by (key, member), so the ranges are of
equal size whatever the keys are: a hot key is cut into many ranges, and copies
of one row are combined where they are read.  Each range counts its keys, in
pieces of at most :data:`PIECE_ROWS` rows (rows, different members, first and
last member).  Prefix sums over these counts give each piece the exact number
of its first row within its key; by this number the pieces are put together to
chunks of :data:`CHUNK_ROWS` rows, equal for all keys and wherever the ranges
were cut, and in order of the numbers the boundary states of neighbouring
pieces and chunks are merged: a member on both sides counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.operators.combine import combine_batches
from logweave.operators.instants import clean_name

#: Rows of a piece, the unit in which rows are counted and numbered.
PIECE_ROWS = 1 << 16
#: Rows of a chunk; chunks are equal to within one piece.
CHUNK_ROWS = 1 << 20


def _pieces(n_keys: int, piece_rows: int):
    """Counts of the keys of one sorted range in pieces: keys, range and piece number, rows, different members, first and last member."""
    names = [f"k{i}" for i in range(n_keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, seq = None, 0
        rows = distinct = held = 0  # rows of the piece with copies, its different members, its rows as they are
        first = last = None
        out: list[tuple] = []

        def close():
            nonlocal rows, distinct, held, seq
            if held:
                out.append((*key, part, seq, rows, distinct, first, last))
                seq += 1
            rows = distinct = held = 0

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            member = b.column(n_keys)
            before = np.concatenate(([0], np.cumsum(b.column(n_keys + 1).to_numpy(zero_copy_only=False))))  # rows, copies counted, in front of each
            # positions where a key, or a member of the same key, differs from the row before
            new_key = None
            for i in range(n_keys):
                d = pc.fill_null(pc.not_equal(b.column(i).slice(1), b.column(i).slice(0, n - 1)), True) if n > 1 else pa.array([], pa.bool_())
                new_key = d if new_key is None else pc.or_(new_key, d)
            new_member = pc.or_(new_key, pc.not_equal(member.slice(1), member.slice(0, n - 1))) if n > 1 else pa.array([], pa.bool_())
            steps = new_member.to_numpy(zero_copy_only=False).cumsum()
            starts = [0, *(new_key.to_numpy(zero_copy_only=False).nonzero()[0] + 1).tolist(), n]
            for a, z in zip(starts, starts[1:]):
                k = tuple(b.column(i)[a].as_py() for i in range(n_keys))
                if k != key:
                    close()
                    key, seq, last = k, 0, None
                at = a
                while at < z:
                    upto = min(z, at + piece_rows - held)
                    head = member[at].as_py()
                    inner = int((steps[upto - 2] if upto > 1 else 0) - (steps[at - 1] if at else 0)) if upto - at > 1 else 0
                    distinct += inner + (1 if held == 0 or head != last else 0)
                    if held == 0:
                        first = head
                    last = member[upto - 1].as_py()
                    held += upto - at
                    rows += int(before[upto] - before[at])
                    at = upto
                    if held == piece_rows:
                        close()
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        close()
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out))
        types = [pa.string()] * n_keys + [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*names, "part", "seq", "n_rows", "n_members", "first", "last"])

    return run


def key_pieces(df: DataFrame, keys: Sequence[Column], member: Column, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Counted and numbered pieces: k0.., part, seq, n_rows, n_members, first, last, row_offset, joined.

    row_offset: rows of the key before the piece; joined: whether its first
    member is the last one of the piece before.  Keys and members are strings;
    rows with a null key or member are left out.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[k.cast("string").alias(n) for k, n in zip(keys, names)], member.cast("string").alias("m")).na.drop()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, T.LongType()) for n in ("part", "seq", "n_rows", "n_members")] + [T.StructField(n, T.StringType()) for n in ("first", "last")])
    ranged = combine_batches(rows, [*names, "m"], count="c").repartitionByRange(*names, "m").sortWithinPartitions(*names, "m")
    order = Window.partitionBy(*names).orderBy("part", "seq")
    offset = F.coalesce(F.sum("n_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.mapInArrow(_pieces(len(names), piece_rows), schema).withColumn("row_offset", offset).withColumn("joined", F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)))


def key_chunks(df: DataFrame, keys: Sequence[Column], member: Column, piece_rows: int = PIECE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Equal chunks of each key: k0.., chunk, first_row, n_rows, n_members (those that the chunk before does not end with), first, last."""
    names = [f"k{i}" for i in range(len(keys))]
    pieces = key_pieces(df, keys, member, min(piece_rows, chunk_rows)).withColumn("chunk", F.expr(f"row_offset div {int(chunk_rows)}"))
    return pieces.groupBy(*names, "chunk").agg(
        F.min("row_offset").alias("first_row"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_members") - F.col("joined").cast("long")).alias("n_members"),
        F.min_by("first", "row_offset").alias("first"), F.max_by("last", "row_offset").alias("last"),
    )


def distinct_members_by_key(df: DataFrame, keys: dict[str, Column], member: Column, piece_rows: int = PIECE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact number of rows and of different members per key, without a task that holds a hot key."""
    chunks = key_chunks(df, list(keys.values()), member, piece_rows, chunk_rows)
    by = [F.col(f"k{i}").alias(name) for i, name in enumerate(keys)]
    return chunks.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_members").alias("n_members"))


def event_counts(events: DataFrame) -> DataFrame:
    """p3: different event_id per (service_name, template_id); rows without template_id, service or event_id are left out."""
    counts = distinct_members_by_key(events, {"service_name": clean_name("service_name"), "template_id": F.col("template_id")}, F.col("event_id"))
    return counts.select("service_name", "template_id", F.col("n_members").alias("n_events"))
