"""Near-duplicate groups by BagMinHash signatures, banding, and verified multiset overlap.

Documents are multisets of five-word shingles. A shingle of count w owns Poisson processes over a hierarchy of
weight intervals (0,1], (1,2], (2,4], (4,8], ...: a process's points come at increasing times, each with a register
and a place in the interval, and points whose place lies above w are thinned out. A register holds the earliest
time over all of a document's points, so two registers are equal with probability weighted Jaccard, without bias. A
process stops as soon as its time passes a bound that fills all registers with high probability; the few documents
left with an empty register repeat with a larger bound, so the signature never depends on the bound.

Groups are the components of all verified links:
1. Equal texts collapse to the least id by a strong digest; only these representatives are banded.
2. In each bucket of a band the member whose buckets are fullest is the pivot, so the original of a group of copies
   is the pivot of most of its buckets. Pivot pairs are verified on the whole texts.
3. All members of a pivot's buckets are its family, so two documents that share any bucket share a family. Families
   that still lie in several components get an exact second pass: their members, in size classes of ratio 1 / threshold
   (linked texts lie in equal or neighbouring classes) and blocks of BLOCK members, meet block by block, where one
   matrix product gives all overlaps. Members outside the pivot's component meet all others; members inside it are
   linked already and don't meet each other, so a family that has m members outside costs m times its size, not its
   square. Only links across components leave a task.
Groups are counted with partial aggregates and stored; the joins that bring their result back to the rows are then plain
equi-joins of two tables, so that AQE may split a bucket, digest or pivot that holds a large part of the rows.
Joins with texts are merge joins at every size, as the other side grows with the corpus and has no bound.
A group of copies of any size costs one link for each copy and pivot, never a row for each pair of copies.

A document is a row's id and text. A further text of a repeated id has a key of its own, beyond the ids, so no link of
either is lost; in the result, groups that share an id share its group id.

Defined cases: a null text counts as empty; equal texts share a group, also without a word; other texts without a
word are linked to nothing; repeated rows keep one output row each, as do rows that repeat an id with other texts; rows
without an id have none; very long texts are read whole; other input columns, whatever their names, are ignored; an empty
table gives no rows. The group id is the least document id in the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, batches_of, components, materialize, small, with_ids
from paperloom.llm.shingles import bags, mix, weighted_jaccard

REGISTERS = 128
ROWS = 4  # registers of a band: at J = 0.8 all 32 bands miss with probability (1 - 0.8^4)^32 = 5e-8
CHUNK = 1 << 19
BLOCK = 256  # members of a family that meet as many others in one task
BLOCK_SHINGLES = 1_000_000  # fewer members meet where their texts are so long that they would exceed this together
_LEVEL = 0xA0761D6478BD642F
_STEP = 0xE7037ED1A0B428DB


def _times(factor: int, n: int) -> np.uint64:
    return np.uint64(factor * n & 0xFFFFFFFFFFFFFFFF)


def _poisson(owner, shingle, weight, bound, registers, out):
    """Lower `out` (texts x registers) by the points of all processes up to each text's time bound."""
    level, low = 0, 0
    while len(owner):
        span = max(1, low)
        state = mix(shingle + _times(_LEVEL, level + 1))
        who, high, time, step = owner, weight, np.zeros(len(owner)), 0
        while len(who):
            step += 1
            draw = mix(state + _times(_STEP, 2 * step))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (span * registers)
            live = time <= bound[who]
            who, high, state, time = who[live], high[live], state[live], time[live]
            if not len(who):
                break
            pick = mix(state + _times(_STEP, 2 * step + 1))
            register = (pick & np.uint64(registers - 1)).astype(np.int64)
            place = low + 1 + ((pick >> np.uint64(32)).astype(np.float64) * 2.0**-32 * span).astype(np.int64)
            fits = place <= high
            np.minimum.at(out.reshape(-1), who[fits] * registers + register[fits], time[fits])
        low = max(1, 2 * low)
        level += 1
        more = weight > low
        owner, shingle, weight = owner[more], shingle[more], weight[more]


def signatures(texts: list[bytes], registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """(registers of each text, whether it has a shingle at all). Equal multisets have equal registers."""
    owner, shingle, weight = bags(texts)
    totals = np.bincount(owner, weight, len(texts))
    out = np.full((len(texts), registers), np.inf)
    slack, todo = 6.0, np.flatnonzero(totals > 0)
    while len(todo):
        bound = np.full(len(texts), -1.0)
        bound[todo] = (np.log(registers) + slack) / totals[todo]
        own = bound[owner] > 0
        out[todo] = np.inf
        _poisson(owner[own], shingle[own], weight[own], bound, registers, out)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack *= 4
    return out, totals > 0


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of each text, distinct across bands."""
    bits = registers.view(np.uint64).reshape(len(registers), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ bits[:, :, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return mix(key).view(np.int64)


def _band(batches: Iterator[pa.RecordBatch], registers: int, rows: int) -> Iterator[pa.RecordBatch]:
    bands = registers // rows
    for batch in small(batches):
        ids = batch.column(0).to_pylist()
        texts = batch.column(1)
        source = ((texts[k].as_buffer().to_pybytes(), ids[k]) for k in range(len(ids)))
        for part in batches_of(source, CHUNK):
            out, full = signatures([t for t, _ in part], registers)
            keys = band_keys(out, rows)[full]
            offsets = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for _, i in part], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
                names=["doc_id", "bands"],
            )


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n = batch.num_rows
        out, size = np.zeros(n), np.zeros(n, np.int64)
        one, two = ([t.as_buffer().to_pybytes() for t in batch.column(c)] for c in (2, 3))
        rows = batches_of(((a + b" " + b, k) for k, (a, b) in enumerate(zip(one, two, strict=True))), CHUNK)
        for part in rows:
            at = [k for _, k in part]
            texts = [x for k in at for x in (one[k], two[k])]
            owner, shingle, weight = bags(texts)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            bag = [(shingle[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            out[at] = [weighted_jaccard(bag[2 * k], bag[2 * k + 1]) for k in range(len(at))]
            size[at] = [bag[2 * k + 1][1].sum() for k in range(len(at))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array(size)], names=["a", "b", "similarity", "size_b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Weighted Jaccard of the whole texts of distinct pairs (a, b), and the number of b's shingles."""
    left = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(left.hint("merge"), "b").join(right.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long, similarity double, size_b long")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs as (row, key, text): the whole input row, and a key that is its id or, where that won't do, one beyond all ids.

    A row without an id, and one that repeats an id with another text than the id's first by digest, is a document of
    its own: its key is a hash of id and text above 2^62.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    told = rows.filter(F.col("id").isNotNull()).select("id", digest.alias("digest")).groupBy("id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    repeats = scratch.table(told.filter("first <> last").drop("last"), "repeats")
    apart = F.xxhash64("id", digest).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    alone = F.col("id").isNull() | (F.col("first").isNotNull() & (digest != F.col("first")))
    return rows.join(repeats, "id", "left").select("row", F.when(alone, apart).otherwise(F.col("id")).alias("key"), "text", "id")


def near_groups(
    docs: DataFrame, threshold: float = 0.8, registers: int = REGISTERS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, copy_id (least id with the same text) and group_id (least id of the near-duplicate group)."""
    scratch = Scratch(docs.sparkSession)
    named = keyed(with_ids(docs, id_column), id_column, text_column, scratch)
    ids = materialize(named.select("id", "key", digest_of(F.col("text"))), "ids")
    members = key_groups(named.select("key", "text"), ids, threshold, registers, rows)
    pairs = scratch.table(members.join(ids.select("key", "id").dropDuplicates(), "key"), "pairs")
    copies = scratch.table(pairs.groupBy("copy").agg(F.min("id").alias("copy_id")), "least_copies")
    groups = scratch.table(pairs.groupBy("group").agg(F.min("id").alias("group_id")), "least_groups")
    least = materialize(pairs.join(copies, "copy").join(groups, "group").select("key", "copy_id", "group_id").dropDuplicates(), "least")
    scratch.drop()
    return ids.join(least, "key").select(F.col("id").alias("doc_id"), "copy_id", "group_id")


def key_groups(texts: DataFrame, ids: DataFrame, threshold: float, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """key, copy (least key with the same text) and group (least key of the group) for each distinct key.

    texts: key, text; ids: key, digest of the text, stored.
    """
    scratch = Scratch(texts.sparkSession)
    copies = scratch.table(ids.groupBy("digest").agg(F.min("key").alias("copy")), "copies")
    members = scratch.table(ids.join(copies, "digest").select("key", "copy").dropDuplicates(), "members")
    firsts = members.filter("key = copy").select(F.col("key").alias("doc_id"))
    texts = texts.select(F.col("key").alias("doc_id"), "text")

    banded = texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        partial(_band, registers=registers, rows=rows), "doc_id long, bands array<long>"
    )
    banded = scratch.table(banded.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bands")
    entries = banded.select("doc_id", F.explode("bands").alias("bucket"))
    shared = scratch.table(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    entries = scratch.table(entries.join(shared, "bucket"), "entries")
    ranks = entries.groupBy("doc_id").agg(F.sum("n").alias("rank"))
    ranked = scratch.table(entries.join(ranks, "doc_id").select("bucket", "doc_id", "rank"), "ranked")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "doc_id")).alias("best"))
    pivots = scratch.table(pivots.select("bucket", F.col("best.doc_id").alias("pivot")), "pivots")
    entries = ranked.select("bucket", "doc_id").join(pivots, "bucket")

    stars = scratch.table(entries.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).dropDuplicates(), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).dropDuplicates()
    read = scratch.table(texts.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidates")
    close = scratch.table(verify(stars, read), "verified")
    links = close.filter(F.col("similarity") >= threshold).select("a", "b")
    groups = components(links)
    more = scratch.table(family_links(close, groups, read, threshold, scratch), "rest")
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    named = members.join(groups.select(F.col("node").alias("copy"), "component"), "copy", "left")
    out = materialize(named.select("key", "copy", F.coalesce("component", "copy").alias("group")), "members")
    scratch.drop()
    return out


def _overlaps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of multiset overlaps of all pairs of texts, their sizes)."""
    owner, shingle, weight = bags(texts)
    sizes = np.bincount(owner, weight, len(texts))
    # the j-th occurrence of a shingle is an element of its own, so that overlaps of multisets are those of sets
    again = np.repeat(np.arange(len(weight)), weight)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
    element, owner = mix(shingle[again] + nth.astype(np.uint64) * np.uint64(_STEP)), owner[again]
    _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[kept] = np.arange(len(kept))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(texts), len(texts)), np.float32)
    for low in range(0, len(kept), 4096):
        i, j = np.searchsorted(column, (low, low + 4096))
        dense = np.zeros((len(texts), 4096), np.float32)
        dense[owner[i:j], column[i:j] - low] = 1
        out += dense @ dense.T
    return out, sizes


def _linker(threshold: float):
    def link_block(group: pd.DataFrame) -> pd.DataFrame:
        ids, place = group["doc_id"].to_numpy(), group["component"].to_numpy()
        if len(set(place)) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        overlap, sizes = _overlaps([t.encode() for t in group["text"]])
        union = sizes[:, None] + sizes[None, :] - overlap
        i, j = np.nonzero((overlap >= threshold * union - 1e-6 * union) & (union > 0) & (place[:, None] < place[None, :]))
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    return link_block


def family_links(close: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links between members of a pivot's family that lie in different components; the pivot itself is compared already."""
    named = groups.select(F.col("node").alias("b"), "component")
    home = groups.select(F.col("node").alias("a"), F.col("component").alias("home"))
    rows = close.filter("size_b > 0").join(named, "b", "left").join(home, "a", "left")
    rows = rows.select(
        F.col("a").alias("pivot"), F.col("b").alias("doc_id"), F.coalesce("component", "b").alias("component"),
        (F.coalesce("component", "b") == F.coalesce("home", "a")).alias("inside"), F.floor(F.log("size_b") / -F.log(F.lit(threshold))).cast("int").alias("class"),
    )
    # class k meets classes k and k - 1 in unit k
    units = rows.withColumn("unit", F.explode(F.array("class", F.col("class") + 1)))
    counts = [F.count("*").alias("n"), F.count_if("inside").alias("n_in"), F.max("class").alias("top")]
    mixed = units.groupBy("pivot", "unit").agg(*counts).filter("n > 1 AND n_in < n AND top = unit")
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.floor(BLOCK_SHINGLES * F.pow(F.lit(threshold), F.col("unit") + 1))))
    # blocks of the members outside come first, those of the members inside after them
    blocks = [F.ceil((F.col("n") - F.col("n_in")) / room).cast("int").alias("out"), F.ceil(F.col("n_in") / room).cast("int").alias("in")]
    mixed = scratch.table(mixed.select("pivot", "unit", *blocks), "mixed")
    place = F.when(F.col("inside"), F.col("out") + F.pmod(F.xxhash64("doc_id"), F.greatest("in", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("out")))
    dealt = units.join(mixed, ["pivot", "unit"]).withColumn("own", place.cast("int"))
    last = F.when(F.col("inside"), F.col("out")).otherwise(F.col("out") + F.col("in")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "pivot", "unit", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", "component"
    )
    whole = scratch.table(dealt, "dealt").join(texts.hint("merge"), "doc_id")
    return whole.groupBy("pivot", "unit", "low", "high").applyInPandas(_linker(threshold), "a long, b long").dropDuplicates()


def keep_one(docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without all but the least id of each group; of rows that repeat an id and its text, one stays.

    A row without an id, and one that repeats an id with another text, is a document of its own, after those with ids:
    it goes only if its text is near that of a row that stays. docs' own columns may have any names.
    """
    named = keyed(docs, id_column, text_column)
    ids = Scratch(docs.sparkSession)
    groups = key_groups(named.select("key", "text"), ids.table(named.select("key", digest_of(F.col("text"))), "ids"), threshold)
    ids.drop()
    kept = materialize(groups.filter(F.col("key") == F.col("group")).select("key").dropDuplicates(), "kept")
    return named.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
