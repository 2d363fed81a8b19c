"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.session import ship


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``, pruned to ``columns`` when given."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that costs far more per row than moving it.

    Only a scan with fewer partitions than cores is redistributed (a small
    table in one file); larger ones are left as they are read.  For scans and
    projections only: what is shuffled already is spread already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
