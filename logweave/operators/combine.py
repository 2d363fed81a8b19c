"""Combining equal rows where they are read, before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def combine_batches(df: DataFrame, keys: Sequence[str], least: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Rows of equal keys within an Arrow batch as one row: ``least`` columns keep their smallest value that is not null, ``count`` gets the number of rows.

    A group of copies that is a large share of all rows shrinks to a row per
    batch before it is moved, so the task that receives it is no larger than
    others.  What is left of it in different batches is for the operator after
    the shuffle; order is kept among the first rows of groups.
    """
    schema = T.StructType([df.schema[c] for c in (*keys, *least)] + ([T.StructField(count, T.LongType())] if count else []))
    aims = [(c, "min") for c in least] + ([([], "count_all")] if count else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = pa.Table.from_batches([b]).group_by(list(keys), use_threads=False).aggregate(aims)
            cols = [out.column(c) for c in keys] + [out.column(f"{c}_min") for c in least] + ([out.column("count_all")] if count else [])
            yield from pa.Table.from_arrays(cols, names=schema.names).combine_chunks().to_batches()

    return df.select(*keys, *least).mapInArrow(run, schema)
