"""Threshold-scaled sketches (FracMinHash) of documents, and the next document in id order.

A sketch keeps every distinct shingle hash that lies below a fixed fraction of the 48-bit hash space; where none
does, it keeps the least, so no text with a word has an empty sketch. Sketches merge: unite two, and drop those
above the threshold if any lies below it, or else all but the least. Shares of a sketch estimate containment between
documents of very unequal length as well as Jaccard.

The order by id uses one stored range split of the ids; each range's texts go to one task, sorted, together with a
copy of the next range's first row, so the whole texts are shuffled once and never gathered.

Defined cases: a null text counts as empty; a text without a word has the empty fingerprint, and two such have
likeness 1, one such and another text 0; repeated ids are ordered by text and each row is the next of the one
before it; rows equal in id and text share whatever place they get; rows without an id are left out; a single row is its own
next; very long texts are read whole; an empty table gives no rows; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ordered_ranges, small, with_ids
from paperloom.llm.shingles import shingle_hashes

#: Share of the hash space that is kept. It is a choice for each corpus: a fingerprint has six bytes for each kept shingle,
#: and the error of a likeness falls with the square root of their number; README has both by fraction.
FRACTION = 0.25
BITS = 48
CHUNK = 1 << 19
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, contained_in_edited double, contained_in_next double"
)


def sketches(texts: list[bytes], fraction: float = FRACTION) -> list[np.ndarray]:
    """Sorted distinct kept hashes of each text."""
    hashes, n = shingle_hashes(texts)
    hashes >>= np.uint64(64 - BITS)
    owner = np.repeat(np.arange(len(texts)), n)
    low = hashes < np.uint64(int(fraction * (1 << BITS)))
    kept = np.bincount(owner[low], minlength=len(texts))
    bare = np.flatnonzero((kept == 0) & (n > 0))
    ends = np.cumsum(n)
    least = {int(k): hashes[ends[k] - n[k] : ends[k]].min() for k in bare}
    cut = np.concatenate(([0], np.cumsum(kept)))
    hashes = hashes[low]
    return [np.array([least[k]], np.uint64) if k in least else np.unique(hashes[cut[k] : cut[k + 1]]) for k in range(len(texts))]


def merge(one: np.ndarray, two: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    both = np.union1d(one, two)
    low = both[both < np.uint64(int(fraction * (1 << BITS)))]
    return low if len(low) else both[:1]


def encode(sketch: np.ndarray) -> str:
    """Six bytes a hash, big-endian and ascending, in base64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 2:] = data
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def likeness(one: np.ndarray, two: np.ndarray) -> tuple[float, float]:
    """(Jaccard, share of the first that is in the second), estimated from two sketches."""
    if not len(one) or not len(two):
        same = float(len(one) == len(two))
        return same, same
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both), both / len(one)


def _route(batches: Iterator[pa.RecordBatch], firsts: list[int]) -> Iterator[pa.RecordBatch]:
    """Give each row its range; a range's first id also goes, marked, to the range before (the first one's to the last)."""
    cuts = np.array(firsts, np.int64)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        where = np.maximum(np.searchsorted(cuts, ids, "right") - 1, 0)
        head = np.flatnonzero(cuts[where] == ids)
        rows = pa.array(np.concatenate((np.arange(len(ids)), head)))
        out = batch.take(rows)
        ranges = np.concatenate((where, (where[head] - 1) % len(cuts))).astype(np.int32)
        marks = np.concatenate((np.zeros(len(ids), bool), np.ones(len(head), bool)))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ranges), pa.array(marks)], names=["doc_id", "text", "range_id", "is_copy"])


def _describe(rows: list[tuple[int, str, str]], fraction: float) -> pa.RecordBatch:
    """Rows of (id, text, next text) as results."""
    texts, edited = [t for _, t, _ in rows], []
    for text, after in ((t, a) for _, t, a in rows):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    raw = [t.encode() for t in edited]
    own, changed = sketches([t.encode() for t in texts], fraction), sketches(raw, fraction)
    # the next text is the following row's, but for the last and where a range ends
    later = [k + 1 if k + 1 < len(rows) and rows[k][2] is texts[k + 1] else None for k in range(len(rows))]
    others = sketches([rows[k][2].encode() for k, j in enumerate(later) if j is None], fraction)
    spare = iter(others)
    follow = [own[j] if j is not None else next(spare) for j in later]
    near = [likeness(a, b) for a, b in zip(own, changed, strict=True)]
    ahead = [likeness(a, b) for a, b in zip(own, follow, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw]), pa.array([encode(s) for s in own]), pa.array([encode(s) for s in changed]),
            *(pa.array([float(p[k]) for p in which], pa.float64()) for k in (0, 1) for which in (near, ahead)),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def _walk(batches: Iterator[pa.RecordBatch], fraction: float) -> Iterator[pa.RecordBatch]:
    """Rows come in order of range, copy mark, id and text; each is described once the one after it is known."""
    held, size, last = [], 0, None
    for batch in small(batches):
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for doc_id, text, range_id, is_copy in zip(*columns, strict=True):
            if last is not None and last[2] == range_id:
                held.append((last[0], last[1], text))
                size += len(last[1])
                if size >= CHUNK:
                    yield _describe(held, fraction)
                    held, size = [], 0
            last = None if is_copy else (doc_id, text, range_id)
    if held:
        yield _describe(held, fraction)


def fingerprint_documents(docs: DataFrame, fraction: float = FRACTION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the next document's beginning."""
    rows = with_ids(docs, id_column).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ranged = ordered_ranges(rows.select("doc_id"), "doc_id")
    # one number for each range, so no more than the session has shuffle partitions
    firsts = [r["first"] for r in ranged.groupBy("range_id").agg(F.min("doc_id").alias("first")).orderBy("range_id").collect()]
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    dealt = rows.mapInArrow(partial(_route, firsts=firsts), "doc_id long, text string, range_id int, is_copy boolean")
    placed = dealt.repartitionById(len(firsts), "range_id").sortWithinPartitions("range_id", "is_copy", "doc_id", "text")
    return placed.mapInArrow(partial(_walk, fraction=fraction), SCHEMA)
