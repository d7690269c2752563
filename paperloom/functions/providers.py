"""Models as pluggable functions on columns; the defaults are deterministic and need no network.

A provider wraps a plain Python function on a batch, so a service client can take its place. Every embedder is called
once for each distinct text (operators.embed), whatever the provider.
"""

from __future__ import annotations

import base64
import hashlib
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[Sequence[str]], list[list[float]]]
Ask = Callable[[Sequence[str]], list[str]]
Rank = Callable[[Sequence[str], Sequence[str]], list[float]]
_WORD = re.compile(r"\w+")
#: How the cl100k vocabulary parts a text into words; a fixed value.
CL100K = (
    r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
)


def hashing_embedder(size: int = 64) -> Embed:
    """Signed feature hashing of words."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for word in _WORD.findall((text or "").lower()):
                h = int(hashlib.md5(word.encode()).hexdigest()[:16], 16)
                v[h % size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


def overlap_ranker(questions: Sequence[str], texts: Sequence[str]) -> list[float]:
    """Share of a question's words that a text has."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        asked = set(_WORD.findall((q or "").lower()))
        out.append(len(asked & set(_WORD.findall((t or "").lower()))) / len(asked) if asked else 0.0)
    return out


def echo(prompts: Sequence[str]) -> list[str]:
    """A model that returns what it is asked, so a pipeline without a model stays deterministic."""
    return [p or "" for p in prompts]


TRIES, DELAY = 3, 1.0  # calls of a failing service; seconds before the second, doubled each time


def patient(call: Callable[[list], Sequence], rows: list, tries: int = TRIES, delay: float = DELAY) -> list:
    """call(rows), again where it fails, and at last row by row, so that one bad row spoils no other; null for a row that fails alone."""
    for n in range(tries):
        try:
            out = list(call(rows))
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} replies to {len(rows)} rows")
            return out
        except Exception:  # a service's failure is answered by the caller's fallback
            if n + 1 < tries:
                time.sleep(delay * 2**n)
    return [None] if len(rows) == 1 else [x for row in rows for x in patient(call, [row], 1, 0)]


def in_batches(call: Callable[[list], Sequence], rows: list, size: int, tries: int = TRIES, delay: float = DELAY) -> list:
    return [x for k in range(0, len(rows), size) for x in patient(call, rows[k : k + size], tries, delay)]


def embedding(text: Column, embed: Embed, batch: int = 10, tries: int = TRIES, delay: float = DELAY) -> Column:
    """Vectors, asked for in batches; null for a text that the model fails on."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(in_batches(embed, texts.fillna("").tolist(), batch, tries, delay), dtype=object)

    return run(text)


def answer(prompt: Column, ask: Ask, otherwise: Column | None = None, tries: int = TRIES, delay: float = DELAY) -> Column:
    """The model's reply; where it fails, `otherwise` or null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(patient(ask, prompts.fillna("").tolist(), tries, delay), dtype=object)

    reply = run(prompt)
    return reply if otherwise is None else F.coalesce(reply, otherwise)


def relevance(question: Column, text: Column, rank: Rank) -> Column:
    """Rerank scores; null for a batch that fails, as a slow service is not asked twice."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(rank(questions.tolist(), texts.tolist()), dtype=float)
        except Exception:  # the order before reranking stands
            return pd.Series([None] * len(texts), dtype=float)

    return run(question, text)


def rerank_request(model: str, question: str, texts: Sequence[str], top: int) -> dict:
    """What a rerank service is sent."""
    return {"model": model, "input": {"query": question, "documents": list(texts)}, "parameters": {"top_n": top, "return_documents": False}}


def rerank_scores(response: dict, n: int) -> list[float | None]:
    """Scores by place of the candidate, from a service's (index, relevance_score) results; null for those it left out."""
    out: list[float | None] = [None] * n
    for result in response["output"]["results"]:
        out[result["index"]] = float(result["relevance_score"])
    return out


def timed(rank: Rank, seconds: float = 0.8) -> Rank:
    """rank that fails where its reply takes longer."""

    def run(questions: Sequence[str], texts: Sequence[str]) -> list[float]:
        with ThreadPoolExecutor(1) as pool:
            return pool.submit(rank, questions, texts).result(timeout=seconds)

    return run


def token_counter(path: str) -> Callable[[Column], Column]:
    """Counts of a real vocabulary, a tokenizers JSON file or a .tiktoken file of ranks; blank counts 0. The file must be at the same
    path on every worker."""

    def count(text: Column) -> Column:
        @F.pandas_udf("int")
        def run(texts: pd.Series) -> pd.Series:
            size = _counter(path)
            return texts.fillna("").map(lambda t: size(t) if t.strip() else 0)

        return run(text)

    return count


@cache
def _counter(path: str) -> Callable[[str], int]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda t: len(own.encode(t, add_special_tokens=False).ids)
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("ranks", pat_str=CL100K, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(other.encode_ordinary(t))
