"""Packing of tokenised documents into sequences by first-fit decreasing in random groups of documents.

Documents are tokenised once, cut at multiples of the sequence length, and stored as piece rows of a few numbers. Each
document row draws a random group (a hash of its id, ids and place in the read, so rows that share an id or a whole text
scatter), and every group packs its documents' pieces on its own: a tournament tree over the bins' free room finds
the first bin that a piece fits in O(log bins). The number of groups follows from the number of pieces, about
`group_pieces` to a group at any corpus size, so memory is bounded; texts are never shuffled. Only a document that
has more than `group_pieces` pieces itself makes its group larger; its full pieces each fill a sequence.

Defined cases: a null or empty text is the end-of-document id alone; a very long text gives full pieces and a rest; pieces
of equal length are packed in order of id, start and checksum, so a group's sequences do not hang on the order of its rows;
repeated rows, and rows that repeat an id, are packed as often as they occur; rows without an id are left out; an empty
table gives no rows; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, small, with_ids

#: The tokens that the JSON file adds to the ranks.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
GROUP_PIECES = 4096


@cache
def encoder(path: str):
    """A function from texts to arrays of ids. A .tiktoken file of ranks and a .json file of the same vocabulary
    give equal ids; the first is about four times as fast. The end-of-text string is its own token in both."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        return lambda texts: [own.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    task = TaskContext.get()
    seen = (task.partitionId() if task else 0) << 40
    for batch in small(batches):
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
            data = np.array([*ids, end_id], dtype="<u4").tobytes()
            n = len(data) // 4
            seen += 1
            draw = int.from_bytes(blake2b(struct.pack("<qqI", doc_id, seen, zlib.crc32(data)), digest_size=7).digest(), "little")
            rows += [(doc_id, s, min(length, n - s), zlib.crc32(data[4 * s : 4 * (s + length)]), n, draw) for s in range(0, n, length)]
        columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"])


def tokenize_pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most `length` ids, every id of a document in exactly one, and the random number that their document drew.

    The number hangs on the place in the read, so store the pieces before they are used twice.
    """
    texts = with_ids(docs, id_column).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.mapInArrow(partial(_pieces, path=tokenizer, length=length, end_id=end_id), f"{PIECES}, draw long")


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, given in decreasing order, none above `room`.

    The tree's leaves are the bins' free room, each inner node the greater of its two children; a bin not yet
    opened has all its room, so the leftmost leaf with enough room is either an open bin or the next new one.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [room] * (2 * width)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - width, room - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def _packer(length: int):
    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, group["offset"] = first_fit_decreasing(group["length"].to_numpy(), length)
        group["sequence_id"] = group["pack_group"].astype("int64") * (1 << 32) + bins
        return group[[c.split()[0] for c in PACKED.split(", ")]]

    return pack_group


def pack(pieces: DataFrame, groups: int, length: int = 1024) -> DataFrame:
    """Each piece with its sequence and its place there. A sequence's free room stays at its end."""
    dealt = pieces.withColumn("pack_group", F.pmod("draw", F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInPandas(_packer(length), PACKED)


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, group_pieces: int = GROUP_PIECES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    pieces = materialize(tokenize_pieces(docs, tokenizer, length, end_id, id_column, text_column), "pieces")
    return pack(pieces, max(1, -(-pieces.count() // group_pieces)), length)
