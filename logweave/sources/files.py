"""Log files as lines, JSON documents of runs, and the sinks of results."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import ship

def resolve_inputs(patterns: Sequence[str]) -> list[str]:
    """Files of globs, folders (all files below), plain paths and ``*.inputs.json`` lists; each once, sorted."""
    found: set[str] = set()
    for p in patterns:
        if p.endswith(".inputs.json") and os.path.isfile(p):
            with open(p) as f:
                data = json.load(f)
            found.update(resolve_inputs(data["inputs"] if isinstance(data, dict) else data))
        elif os.path.isdir(p):
            found.update(os.path.realpath(os.path.join(d, f)) for d, _, fs in os.walk(p) for f in fs)
        else:
            hits = glob.glob(p, recursive=True)
            found.update(os.path.realpath(h) for h in hits if os.path.isfile(h))
            for h in filter(os.path.isdir, hits):
                found.update(resolve_inputs([h]))
    if not found:
        raise FileNotFoundError(f"no input files match {list(patterns)}")
    return sorted(found)


def _number(batches):
    """Number of each line, and its byte, within the split it is read from."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key, lines, size = None, 0, 0
    for b in batches:
        at, path, n = b.column("_at"), b.column("source"), b.num_rows
        if not n:
            continue
        new = pc.or_(pc.not_equal(at.slice(1), at.slice(0, n - 1)), pc.not_equal(path.slice(1), path.slice(0, n - 1)))
        cuts = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            here = (path[a].as_py(), at[a].as_py())
            if here != key:
                key, lines, size = here, 0, 0
            some = b.slice(a, z - a)
            sizes = pc.add(pc.cast(pc.binary_length(some.column("value")), pa.int64()), 1)
            ends = pc.add(pc.cumulative_sum(sizes), size)
            numbers = pa.array(range(lines + 1, lines + z - a + 1), pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("source"), some.column("_at"), numbers, pc.subtract(ends, sizes), ends, some.column("value")], names=["source", "_at", "_no", "_from", "_end", "value"])
            lines, size = lines + z - a, ends[-1].as_py()


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source, line_no, offset, line) of text files: line_no from 1 in file order, the byte at which the line begins.

    Lines end at line feeds, whatever the size of a file and wherever it is
    split; a carriage return before one is left out.  Each split's lines are
    numbered where they are read, and the lines and bytes in the splits before
    it (one row per split) are added, so no text is moved to number it.
    """
    ship(spark)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    raw = spark.read.text(list(paths), lineSep="\n").select(name.alias("source"), F.col("_metadata.file_block_start").alias("_at"), "value")
    numbered = raw.mapInArrow(_number, "source string, _at long, _no long, _from long, _end long, value string")
    splits = numbered.groupBy("source", "_at").agg(F.max("_no").alias("_n"), F.max("_end").alias("_b"))
    before = lambda c: F.expr(f"coalesce(sum({c}) over (partition by source order by _at rows between unbounded preceding and 1 preceding), 0)")
    splits = splits.select("source", "_at", before("_n").alias("_lines"), before("_b").alias("_bytes"))
    return numbered.join(splits, ["source", "_at"]).select("source", (F.col("_lines") + F.col("_no")).alias("line_no"), (F.col("_bytes") + F.col("_from")).alias("offset"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def read_range(spark: SparkSession, path: str, start: int = 0) -> tuple[DataFrame, int]:
    """((source, offset, line), new offset): whole lines of a local file from a byte offset on.

    An offset inside a line goes on to the next one; the last line counts only
    if it has its line feed, and the new offset is behind it.  The bytes are
    read by the executors in blocks.
    """
    from logweave.streaming.growing import BLOCK, last_line_feed

    ship(spark)
    end = last_line_feed(path)
    cuts = list(range(start, end, BLOCK)) + [end] if end > start else []
    blocks = spark.createDataFrame([(path, a, z, start) for a, z in zip(cuts, cuts[1:])], "source string, a long, z long, start long")

    def lines(rows):
        import pandas as pd

        for pdf in rows:
            for p, a, z, first in pdf.itertuples(index=False, name=None):
                with open(p, "rb") as f:
                    f.seek(max(0, a - 1))
                    if a and f.read(1) != b"\n":
                        f.readline()  # the line that the block before ends in
                    at, out = f.tell(), []
                    while at < z and (b := f.readline()):
                        out.append((p, at, b.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
                        at += len(b)
                yield pd.DataFrame(out, columns=["source", "offset", "line"])

    return blocks.mapInPandas(lines, "source string, offset long, line string"), max(start, end)


def read_run_documents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """run.json documents, one row each; unreadable ones are passed over."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(list(paths))
    return df.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in df.columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd; the commit protocol makes it all or nothing."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, all columns or some; a missing table is a FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return df.select(*columns) if columns else df


def write_dataset(events: DataFrame, templates: DataFrame, path: str, include_body: bool = False) -> None:
    """Events as NDJSON with the classification of their template."""
    write = dataset(events, templates, include_body)
    write.select(F.to_json(F.struct(*sorted(write.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


DATASET = ("run_id", "event_id", "template_id", "service_name", "severity_text", "severity_number", "error_kind", "exception_type", "normalized_template", "parse_status", "source", "line_count")


def dataset(events: DataFrame, templates: DataFrame, include_body: bool = False) -> DataFrame:
    t = templates.select(F.col("template_id").alias("_tid"), F.col("classification").alias("_c"))
    j = events.join(t, F.col("template_id") == F.col("_tid"), "left")
    return j.select(*DATASET, F.coalesce("_c", "classification").alias("classification"), *(["body"] if include_body else []))


def split_by_service(df: DataFrame, path: str) -> None:
    """A table in folders by service, each to be taken out alone."""
    write_table(df, path, ["service_name"])


def align(df: DataFrame, schema) -> DataFrame:
    """Columns of a schema in its order: cast, null where missing."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
