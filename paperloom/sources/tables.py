"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, where the work on a row outweighs moving it once.
TEXT_TABLES = frozenset({"documents", "pages"})


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; a text table that comes in a single piece is dealt out to all cores first.

    Spark cuts large files by itself, so only a small table, less than one split, would keep one core busy.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXT_TABLES and rows._jdf.queryExecution().toRdd().getNumPartitions() == 1:
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows
