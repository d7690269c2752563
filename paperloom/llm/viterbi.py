"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reads a stretch of text once; at each position its output links name every piece that ends there, and
each relaxes the best score of that position from the best score where the piece begins. Characters that no single
piece covers become byte pieces. No piece holds a space mark after another character, so text is cut before each run
of space marks and equal stretches are encoded once per worker (a bounded memo).

The vocabulary is that of a model file. Its scores serve as they are with scores="stored"; a file of merge ranks has
no probabilities, so scores="zipf", the default, takes log 1/(rank + 2) from them, a fixed rule and not training. Ties
go to the piece that begins earliest. decode(encode(text)) == text for every text.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows give repeated results; rows
without an id keep a null id; an empty table gives no rows; other input columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import small

SPACE = "▁"
OWN_MARK = "\ud800"  # stands for a space mark that the text itself holds; no valid text has a lone surrogate
UNKNOWN_PENALTY = 10.0
MEMO = 400_000  # stretches remembered by a worker
LONG = 64  # characters of a stretch that is not worth remembering
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SCHEMA = "doc_id long, n_tokens long, score double, ids array<int>, decoded_equal boolean"


class Codec:
    def __init__(self, path: str, scores: str = "zipf"):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(k) for k in range(model.vocab_size())]
        self.bytes_of = {int(self.pieces[k][3:5], 16): k for k in range(len(self.pieces)) if model.is_byte(k)}
        self.plain = [k for k in range(len(self.pieces)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        rank = lambda k: max(0.0, -model.get_score(k))
        self.scores = {k: model.get_score(k) if scores == "stored" else -math.log(rank(k) + 2) for k in self.plain}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.single = {self.pieces[k] for k in self.plain if len(self.pieces[k]) == 1}
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[k]) for k in self.plain)
        self.automaton = ahocorasick.Automaton()
        for k in self.plain:
            self.automaton.add_word(self.pieces[k], (len(self.pieces[k]), self.scores[k], k))
        self.automaton.make_automaton()
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        for b, k in self.bytes_of.items():
            self.surface[k] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.ids: dict[str, bytes] = {}
        self.values: dict[str, float] = {}

    def _viterbi(self, text: str) -> tuple[float, list[int]]:
        n = len(text)
        best = [0.0] + [-math.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        known = self.single.issuperset(text)
        done = 0  # positions up to here have had their unknown characters relaxed
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            if done < end:
                if not known:
                    self._relax_unknown(text, best, back, done, end)
                done = end
            start = end - length
            value = best[start] + score
            if value > best[end] or value == best[end] and start < back[end][0]:
                best[end], back[end] = value, (start, piece)
        if not known:
            self._relax_unknown(text, best, back, done, n)
        ids: list[int] = []
        k = n
        while k:
            start, piece = back[k]
            ids += [piece] if piece >= 0 else [self.bytes_of[b] for b in reversed((SPACE if text[start] == OWN_MARK else text[start]).encode())]
            k = start
        return best[n], ids[::-1]

    def _relax_unknown(self, text: str, best: list[float], back: list[tuple[int, int]], start: int, stop: int) -> None:
        for k in range(start, stop):
            if text[k] not in self.single and best[k] + self.unknown > best[k + 1]:
                best[k + 1], back[k + 1] = best[k] + self.unknown, (k, -1)

    def encode(self, text: str) -> tuple[float, np.ndarray]:
        """(score, ids) of the best segmentation."""
        if not text:
            return 0.0, np.empty(0, np.int32)
        marked = SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)
        stretches = STRETCH.findall(marked) if self.cut else [marked]
        if len(self.ids) > MEMO:
            self.ids.clear()
            self.values.clear()
        brief = []
        for stretch in set(stretches).difference(self.ids):
            self.values[stretch], ids = self._viterbi(stretch)
            self.ids[stretch] = array("i", ids).tobytes()
            if len(stretch) > LONG:
                brief.append(stretch)
        # fsum, so that the score does not hang on the order of the stretches
        total = math.fsum(map(self.values.__getitem__, stretches))
        out = np.frombuffer(b"".join(map(self.ids.__getitem__, stretches)), np.int32)
        for stretch in brief:
            del self.ids[stretch], self.values[stretch]
        return total, out

    def decode(self, ids: list[int]) -> str:
        """Text of ids. Byte pieces stand in `surface` as surrogate escapes, so one pass turns them into characters."""
        joined = "".join(map(self.surface.__getitem__, ids))
        return joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")[1:]


@cache
def codec(path: str, scores: str = "zipf") -> Codec:
    return Codec(path, scores)


def _encode(batches: Iterator[pa.RecordBatch], path: str, scores: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, scores)
    for batch in small(batches):
        texts = batch.column(1).to_pylist()
        coded = [own.encode(t) for t in texts]
        sizes = np.array([len(i) for _, i in coded], np.int64)
        flat = np.concatenate([i for _, i in coded] or [np.empty(0, np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes), pa.array([s for s, _ in coded], pa.float64()), lists,
                pa.array([own.decode(i.tolist()) == t for (_, i), t in zip(coded, texts, strict=True)], pa.bool_()),
            ],
            names=["doc_id", "n_tokens", "score", "ids", "decoded_equal"],
        )


def encode_documents(docs: DataFrame, path: str, scores: str = "zipf", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_encode, path=path, scores=scores), SCHEMA)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in small(batches):
        texts = [None if i is None else own.decode(i) for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_documents(coded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Texts of columns of ids; null ids give a null text."""
    return coded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids")).mapInArrow(partial(_decode, path=path), "doc_id long, text string")
