"""Contiguous shards of equal byte size by global prefix sums.

Rows are ordered by id in key ranges; the totals of the ranges give each range its start, a running sum inside
the range gives each row its own, and equal targets of the whole cut the line into shards. Only one row for
each range and one for each shard are ever broadcast. No text is shuffled, only ids, sizes and checksums. A row number
ends the order, so that rows of one id, even equal ones, spread over as many ranges as they need.

Defined cases: a null text has no bytes and size 1; an empty text also size 1; ties (repeated ids) are ordered by
checksum and size, and rows equal in all three share whatever place they get; an empty table gives no rows; rows without an id are left out; other
columns of the input, whatever their names, are ignored. With fewer rows than shards some shards are empty. A row longer than a whole
target stays whole, however long, so its shard is larger by that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, materialize, ordered_ranges, with_ids


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row_number: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    number = F.monotonically_increasing_id() if row_number is None else row_number
    return with_ids(docs, id_column).select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), number.alias("row_number")
    )


def assign_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (place inside the shard, from 0) for every row."""
    return _places(sizes(docs, id_column, text_column), shards).drop("row_number")


def _places(rows: DataFrame, shards: int) -> DataFrame:
    order = ("doc_id", "text_crc32", "size", "row_number")
    ranged = ordered_ranges(rows, *order)
    line = Window.orderBy("range_id")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "range_id",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("bytes_total"),
    )
    inside = Window.partitionBy("range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(inside), "row": F.row_number().over(inside)})
        .join(F.broadcast(starts), "range_id")
        .withColumn("place", F.col("rows_before") + F.col("row") - 1)
        .withColumn(
            "shard",
            F.expr(f"CAST(least({shards} - 1, ((2 * (bytes_before + upto) - size) * {shards}) DIV (2 * bytes_total)) AS INT)"),
        )
        .select("doc_id", "size", "text_crc32", "row_number", "shard", "place")
    )
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "row_number", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write docs as one folder shard_number=N for each shard, one file for each, its rows in slot order.

    The numbered rows are stored once, so that each is written where assign_shards() puts it, repeated rows and ids too. The files hold
    docs' own columns alone, whatever their names; rows without an id are left out; an empty table writes no rows.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("row_number"), own.alias("row")), "rows")
    named = rows.select(F.col(f"row.`{id_column}`").alias("doc_id"), F.col(f"row.`{text_column}`").alias("text"), "row_number")
    places = scratch.table(_places(sizes(named, row_number=F.col("row_number")), shards).select("row_number", "shard", "slot"), "places")
    dealt = rows.join(places, "row_number").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias("shard_number")).write.partitionBy("shard_number").parquet(path)
    scratch.drop()
