"""Helpers that the corpus operators share: scratch tables, global order, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.scratch import Scratch, drop_scratch, materialize, scratch_path  # noqa: F401  the operators take them from here

def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that a worker unpacks only those texts at a time. Slices are views, not copies."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def with_ids(df: DataFrame, id_column: str) -> DataFrame:
    """The rows that have an id. A row without one can't be named in a result keyed by id, so it has none."""
    return df.filter(F.col(id_column).isNotNull())


def ordered_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """df in key ranges as a scratch table, with `range_id`: ranges ascend, rows of one range share an id.

    The ids come from one range shuffle and are stored, so every later read sees the same ones.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartitionByRange(n, *keys).withColumn("range_id", F.spark_partition_id()), "ranges")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, component), component being the least node id.

    Each round takes the least label among the neighbours and then jumps along labels, so paths shorten
    by more than half a round. Labels stay in tables of the shared folder; only one count a round reaches
    the driver. An empty edge list gives an empty result.
    """
    held, old = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = held.table(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).dropDuplicates(), "edges")
    labels = old.table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        fresh = Scratch(edges.sparkSession)
        moved = fresh.table(step.join(jump, "component", "left").select("node", "was", F.least("component", "further").alias("component")), "labels")
        old.drop()
        old, labels = fresh, moved.select("node", "component")
        if not moved.filter("was <> component").limit(1).count():
            held.drop()
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def batches_of(rows: Iterator, limit: int) -> Iterator[list]:
    """Lists of (bytes, ...) rows of about `limit` bytes; a longer row stands alone."""
    held, size = [], 0
    for row in rows:
        n = len(row[0])
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
