"""An inverted file over vectors: cells around centres, of which a search looks into the nearest few.

Centres are fitted on a bounded sample; every vector is put into the cell of its nearest centre. A search is exact inside the cells it looks
into, so where it looks into all, as by default, it gives what vector_topk() gives. How many cells are enough hangs on the vectors: tuned() finds
the number by measuring recall against exact search. Store the indexed chunks partitioned by cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from paperloom.functions.nearest import unit_rows
from paperloom.operators import retrieve

CELLS = 64
RECALL = 0.9
ASKED = 200  # questions that recall is measured with, those least by a hash of their id
SAMPLE = 20_000  # vectors that centres are fitted on, those least by a hash of their id; this many at most reach the driver
ROUNDS = 12


def fit(chunks: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by spherical k-means on a sample; fewer where there are fewer distinct vectors, none where there are none."""
    order = F.xxhash64("chunk_id")
    rows = chunks.filter(F.size("embedding") > 0).select("embedding", order.alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(sample).toArrow()
    if not rows.num_rows:
        return np.empty((0, 0))
    size = int(np.max(rows.column("embedding").combine_chunks().value_lengths().to_numpy()))
    points = np.unique(unit_rows(rows.column("embedding"), size)[0].round(12), axis=0)
    points = points[np.random.default_rng(0).permutation(len(points))]
    centres = points[:cells].copy()
    for _ in range(rounds):
        near = points @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        lost = np.bincount(home, minlength=len(centres)) == 0
        # a cell without points starts anew at those that lie worst
        sums[lost] = points[np.argsort(near.max(axis=1))[: lost.sum()]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _cells(batches: Iterator[pa.RecordBatch], at: int, centres: np.ndarray, probe: int) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its nearest cells; rows whose vectors can't be compared are left out."""
    for batch in batches:
        rows, places = unit_rows(batch.column(at), centres.shape[1])
        near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probe]
        out = batch.take(pa.array(np.repeat(places, near.shape[1])))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32))], names=[*out.schema.names, "cell"])


def _with_cells(rows: DataFrame, centres: np.ndarray, probe: int) -> DataFrame:
    shape = StructType([*rows.schema, StructField("cell", IntegerType())])
    if not centres.size:
        return rows.limit(0).withColumn("cell", F.lit(0)).select(*shape.names)
    return rows.mapInArrow(partial(_cells, at=rows.columns.index("embedding"), centres=centres, probe=probe), shape)


def indexed(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """chunks with the cell of each vector; one of another length, zero or null is in none."""
    return _with_cells(chunks, centres, 1)


def search(questions: DataFrame, stored: DataFrame, centres: np.ndarray, k: int = retrieve.VECTOR_TOP, probe: int | None = None) -> DataFrame:
    """As vector_topk() over indexed chunks, looking into `probe` cells for each question, or into all."""
    asked = retrieve.fan_out(questions).select("query_id", "kb_pos", F.col("kb_id").cast("long").alias("kb_id"), "embedding").filter(F.size("embedding") > 0)
    n = max(1, len(centres))
    home = (F.col("kb_id") * n + F.col("cell")).alias("kb_id")
    looked = _with_cells(asked, centres, min(probe or n, n)).select("query_id", "kb_pos", home, "embedding")
    found = retrieve.nearest_rows(looked, stored.select("chunk_id", home, "embedding"), k)
    return found.withColumn("kb_id", F.floor(F.col("kb_id") / n).cast("long"))


def recall(questions: DataFrame, stored: DataFrame, centres: np.ndarray, probe: int, k: int = retrieve.VECTOR_TOP) -> float:
    """Share of the exact top k that a search with `probe` cells finds; 1 where there is nothing to find."""
    keys = ["query_id", "kb_pos", "chunk_id"]
    exact = retrieve.vector_topk(questions, stored, k).select(keys)
    found = search(questions, stored, centres, k, probe).select(*keys, F.lit(1).alias("hit"))
    row = exact.join(found, keys, "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def tuned(questions: DataFrame, stored: DataFrame, centres: np.ndarray, k: int = retrieve.VECTOR_TOP, target: float = RECALL, asked: int = ASKED) -> int:
    """The least number of cells, a power of two or all, whose measured recall reaches the target."""
    some = questions.orderBy(F.xxhash64("query_id"), "query_id").limit(asked)
    probe = 1
    while probe < len(centres) and recall(some, stored, centres, probe, k) < target:
        probe *= 2
    return max(1, min(probe, len(centres)))
