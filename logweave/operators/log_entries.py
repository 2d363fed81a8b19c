"""Problem 1: semi-structured log lines into entries with fields.

Lines are collapsed to shape signatures, each distinct signature is resolved to
a layout once, and the rules (signature, layout) are broadcast to the lines
(``functions.layouts``).  Files are cut into chunks of :data:`CHUNK_LINES` lines, so a file with a third of all lines
is many groups; continuation lines at the head of a chunk are attached
backward to the last entry of the chunks before it, which needs one row per
chunk and no text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions import layouts as L
from logweave.operators.combine import combine_batches
from logweave.session import sized

#: Lines per chunk of a file: bounds every group of the assembly.
CHUNK_LINES = 4096

#: Most rules (distinct signatures that have a layout) that are broadcast; more are joined by a shuffle.
RULES_BROADCAST = 100_000

FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in L.Entry._fields])


@F.pandas_udf(T.IntegerType())
def resolve(signature: pd.Series) -> pd.Series:
    """Layouts of distinct signatures."""
    return signature.map(L.layout_of)


@F.arrow_udf(FIELDS)
def entry_fields(text: pa.Array, layout: pa.Array) -> pa.Array:
    """Fields of whole entries."""
    return L.parse_entries(text, layout)


def layout_rules(lines: DataFrame) -> DataFrame:
    """The rules (signature, layout) of all (cleaned) lines: each distinct signature is resolved once, and their number is counted before they are sent to the executors."""
    line = lines.columns[0]
    return sized(L.with_signature(lines, line, "_rule").select("_rule").distinct().select("_rule", resolve("_rule").alias("_layout")).where("_layout >= 0"), RULES_BROADCAST)


def with_layout(df: DataFrame, line: str, rules: DataFrame | None = None) -> DataFrame:
    """Add ``_layout``, the layout that a (cleaned) line begins an entry with; -1 of a continuation. rules: of these and other lines."""
    rules = layout_rules(df.select(line)) if rules is None else rules
    found = L.with_signature(df, line, "_rule").join(rules, "_rule", "left")
    return found.withColumn("_layout", F.coalesce("_layout", F.lit(-1))).drop("_rule")


def by_pattern(pattern: str) -> Callable[[DataFrame, str], DataFrame]:
    """The same for lines that begin an entry where they match a pattern; all have layout 0."""
    return lambda df, line: df.withColumn("_layout", F.when(F.col(line).rlike(pattern), 0).otherwise(-1))


def clean_lines(c: str) -> Column:
    """Without colour codes and trailing blanks, line by line."""
    plain = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), L.ANSI, "")
    return F.regexp_replace(plain, r"[ \t\r\f\x0B]+(?=\n|\z)", "")


def assemble(lines: DataFrame, chunk_lines: int = CHUNK_LINES, clean: Callable[[str], Column] = clean_lines, layouts: Callable[[DataFrame, str], DataFrame] = with_layout) -> DataFrame:
    """(source, record_pos, line_count, text, layout) of physical lines (source, line_no, line).

    clean: what is kept of a line; layouts: adds ``_layout`` to rows with a
    cleaned line, from 0 on if it begins an entry.

    A line that begins an entry starts one, every other line continues the one
    before (the first line of a file begins one anyway, layout -1).  Repeated
    rows count once; of different lines at one place the smallest text is
    taken; a null line is an empty one; rows without source or line_no are left
    out.  One entry is one row, so a file of continuation lines only is one
    row, as it is one message.
    """
    chunk = F.expr(f"(line_no - 1) div {int(chunk_lines)}").alias("_chunk")
    rows = lines.where(F.col("source").isNotNull() & F.col("line_no").isNotNull()).select("source", chunk, F.col("line_no").cast("long").alias("line_no"), clean("line").alias("_line"))
    rows = layouts(rows.where("_chunk is not null"), "_line")  # said here, the plan has it in both readers of the shuffle
    place = ["source", "_chunk"]
    # one shuffle of the lines, read by the marks and by the pieces: both take whole rows from it
    once = rows.repartition(*place).groupBy(*place, "line_no").agg(F.min(F.struct("_line", "_layout")).alias("x"))
    begins = F.when(F.col("x._layout") >= 0, F.col("line_no"))
    # the last beginning of each chunk, and from it of all chunks before: one row per chunk
    marks = once.groupBy(*place).agg(F.max(begins).alias("_last"), F.min("line_no").alias("_first"))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("source", "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_owner"), F.min("_first").over(Window.partitionBy("source")).alias("_file_first"), F.col("_last"))
    to_here = Window.partitionBy(*place).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = once.select(*place, "line_no", "x.*", F.max(begins).over(to_here).alias("_own"))
    joined = lambda c, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda p: p[c]), "\n").alias("text")
    pieces = owned.groupBy(*place, "_own").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("at"), F.min_by("_layout", "line_no").alias("layout"), joined("_line", "line_no"))
    pieces = pieces.join(marks, place).withColumn("record_pos", F.coalesce("_own", "_owner", "_file_first"))
    open_ended = F.col("_own").isNull() | (F.col("_own") == F.col("_last"))
    done = pieces.where(~open_ended).select("source", "record_pos", F.col("n").alias("line_count"), "text", "layout")
    parts = pieces.where(open_ended).groupBy("source", "record_pos").agg(F.sum("n").alias("line_count"), joined("text", "at"), F.min_by("layout", "at").alias("layout"))
    return done.unionByName(parts)


def with_fields(entries: DataFrame) -> DataFrame:
    """Add parse_format, parse_status, ts_text, severity_text, component, body to entries with ``text`` and ``layout``."""
    return entries.withColumn("_f", entry_fields("text", "layout")).select(*[F.col(c) for c in entries.columns if c not in ("text", "layout")], "_f.*")


def log_entries(lines: DataFrame, chunk_lines: int = CHUNK_LINES, rules: DataFrame | None = None) -> DataFrame:
    """One row per entry of physical lines: source, record_pos, line_count and the fields."""
    return with_fields(assemble(combine_batches(lines, ["source", "line_no", "line"]), chunk_lines, layouts=lambda df, line: with_layout(df, line, rules)))


def rules_of(lines: DataFrame, events: DataFrame) -> DataFrame:
    """The rules of physical lines and of the unsplit bodies of events together."""
    return layout_rules(lines.select(clean_lines("line").alias("_line")).unionByName(_unsplit(events).select(_head("text").alias("_line"))))


def _head(c: str) -> Column:
    return F.substring_index(c, "\n", 1)


def _unsplit(events: DataFrame) -> DataFrame:
    return events.where(F.col("template_id").isNull() & F.col("event_id").isNotNull()).select("event_id", "source", F.col("offset").alias("record_pos"), clean_lines("body").alias("text"))


def json_entries(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Of the same only entries that begin with a brace: no other is parsed."""
    return with_fields(assemble(combine_batches(lines, ["source", "line_no", "line"]), chunk_lines).where(F.startswith("text", F.lit("{"))))


def unsplit_entries(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The same for events with null ``template_id``: each ``body`` is one entry, once per ``event_id``; null bodies are empty ones."""
    once = _unsplit(events).groupBy("event_id").agg(F.min(F.struct("source", "record_pos", "text")).alias("x")).select("x.*")
    once = with_layout(once.withColumn("_line", _head("text")), "_line", rules).drop("_line").withColumnRenamed("_layout", "layout")
    return with_fields(once.withColumn("line_count", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")))


def found(entries: DataFrame) -> DataFrame:
    """The columns of p1_found."""
    return entries.select("source", "record_pos", "line_count", "parse_format", "parse_status", "ts_text", "severity_text", "component", F.length("body").cast("long").alias("body_chars"))
