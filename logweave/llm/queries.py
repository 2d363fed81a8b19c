"""Queries of this subpackage and their SQL (where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import leaks, packing, runs, stuffing
from logweave.sources.tables import spread, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.found(runs.event_runs(table(spark, folder, "log_events"), table(spark, folder, "services")))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, folder, "documents")), table(spark, folder, "pack_capacities"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of p7_pack are, against the least number possible."""
    return packing.fill(p7_pack(spark, folder), table(spark, folder, "pack_capacities"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p8_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which tiles of five words or more cover half or more, in any order: passages that were cut up and rearranged."""
    docs = spread(table(spark, folder, "documents", "doc_id", "text"))
    return leaks.leaked_items(docs, table(spark, folder, "eval_items"), seed=leaks.SHINGLE, min_coverage=leaks.COVERAGE)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(spread(table(spark, folder, "documents", "doc_id", "text")))


QUERIES = {f.__name__: f for f in (p4_found, p7_pack, p7_fill, p8_found, p8_reordered, p9_found)}

#: None of these is given as SQL: timestamps of many forms, an order-dependent packing, MIME decoding and a trained model.
#: They are tested against brute force instead (tests/llm).
SQL: dict[str, str] = {}
