"""Severity of toxicity by cumulative-link ordinal regression on sparse word features.

The model is P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector shared by ordered thresholds. It is
fitted on at most `sample_rows` labelled rows, those least by a hash of the id, equal texts once. Features are words and word beginnings
whose document frequency is higher in toxic than in other sample rows by the G test (at most `features` of them), valued by their
rate in the text on a log scale. The labels are 0 and 1; grades 1 to 3 of toxic rows come from how much of
the text is evidence, cut at the terciles of the toxic sample. Expected severity is the sum of P(grade > k).

Scoring reads every whole text once, with only the features and weights in the task, and shuffles nothing.

Defined cases: a null text counts as empty and has the severity of no evidence; labels that are null or belong to no
document are not used; of an id with several texts the sample has one, that with the least hash; features of equal G are
taken in alphabetical order; without both kinds of label nothing is toxic; repeated rows are scored each; rows without an id
keep a null id; very long texts are read whole; an empty table gives no rows; other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, small

SAMPLE_ROWS = 20_000
FEATURES = 2_000
GRADES = 3
PREFIXES = (4, 5, 6, 7)
LEAST_G = 30.0  # G statistic of a feature against the label; chance gives so much once in 20 million
CUTOFF = 0.35
SCHEMA = "doc_id long, n_words long, n_evidence long, severity double, p_toxic double, grade int, toxic boolean"
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    evidence: frozenset[str] = frozenset()
    thresholds: tuple[float, ...] = (30.0,) * GRADES


def features_of(text: str) -> tuple[Counter, int]:
    """Counts of words, and of beginnings of longer words marked with a caret; number of words."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                out["^" + word[:size]] += n
    return out, sum(words.values())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(features_of(text)[0].keys())
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (seen[1], seen[0]))], names=["feature", "n_toxic", "n_other"]
        )


def _rows(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, counts, words = [], [], []
        for text in batch.column(0).to_pylist():
            found, n = features_of(text)
            own = [(vocabulary[f], c) for f, c in found.items() if f in vocabulary]
            ids.append([k for k, _ in own])
            counts.append([c for _, c in own])
            words.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(words, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            names=["toxic", "n_words", "at", "n"],
        )


def value(count, words):
    """Occurrences in a hundred words on a log scale."""
    return 3.0 * np.log1p(100.0 * count / np.maximum(words, 1))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(owner, at, values, grades, n_features, steps: int = 400, rate: float = 0.1, penalty: float = 1e-3):
    """Weights and ordered thresholds that minimise the mean negative log-likelihood plus an L2 penalty, by Adam.

    The design matrix is given as triplets (row, feature, value). Thresholds are a first one and positive steps, so
    they stay in order.
    """
    rows, cuts = len(grades), GRADES
    weights, first, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(cuts - 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, first, gaps)]
    upper, lower = grades < cuts, grades > 0
    for step in range(1, steps + 1):
        theta = np.concatenate((first, first + np.cumsum(np.exp(gaps))))
        z = np.bincount(owner, weights[at] * values, rows)
        high = np.where(upper, _sigmoid(theta[np.minimum(grades, cuts - 1)] - z), 1.0)
        low = np.where(lower, _sigmoid(theta[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) * upper, low * (1 - low) * lower
        g_z = (d_high - d_low) / p / rows
        g_theta = np.bincount(np.minimum(grades, cuts - 1), -d_high / p / rows, cuts) + np.bincount(np.maximum(grades - 1, 0), d_low / p / rows, cuts)
        g_w = np.bincount(at, g_z[owner] * values, n_features) + penalty * weights
        later = np.cumsum(g_theta[::-1])[::-1]
        for x, g, (m, v) in zip((weights, first, gaps), (g_w, later[:1], later[1:] * np.exp(gaps)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return weights, np.concatenate((first, first + np.cumsum(np.exp(gaps))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from a bounded sample of labelled documents; what reaches the driver is bounded by both parameters."""
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample_rows)
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # of an id that is repeated one text is taken, so no more rows come than were sampled
    one = texts.join(F.broadcast(sample), "_id").groupBy("_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("copy"), "text")).alias("r"))
    # copies of one text would lend their words the weight of many documents
    rows = one.select("r.text", "r.copy", "toxic").dropDuplicates(["copy", "toxic"]).select("text", "toxic")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(rows, "sample")
    found = rows.mapInArrow(_tally, "feature string, n_toxic long, n_other long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))
    total = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    n_toxic = total["toxic"] or 0
    n_other = total["n"] - n_toxic
    if not n_toxic or not n_other:
        scratch.drop()
        return Model()
    odds = F.log(((F.col("n_toxic") + 0.05) / (n_toxic + 1)) / ((F.col("n_other") + 0.5) / (n_other + 1)))
    with_it, rows_all = F.col("n_toxic") + F.col("n_other"), n_toxic + n_other
    cells = [(F.col("n_toxic"), with_it, n_toxic), (F.col("n_other"), with_it, n_other)]
    cells += [(n_toxic - F.col("n_toxic"), rows_all - with_it, n_toxic), (n_other - F.col("n_other"), rows_all - with_it, n_other)]
    gain = sum((F.when(n > 0, 2 * n * F.log(n * rows_all / (row * column))).otherwise(0.0) for n, row, column in cells), F.lit(0.0))
    found = found.withColumns({"odds": odds, "gain": gain}).filter((F.col("gain") >= LEAST_G) & (F.col("odds") > 0))
    chosen = found.orderBy(F.desc("gain"), "feature").limit(features).collect()
    vocabulary = {r["feature"]: k for k, r in enumerate(chosen)}
    strong = np.array([r["odds"] > 2.0 and not r["feature"].startswith("^") for r in chosen])
    got = rows.mapInArrow(partial(_rows, vocabulary=vocabulary), "toxic int, n_words long, at array<int>, n array<int>").toPandas()
    scratch.drop()
    sizes = got["at"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(got)), sizes)
    at = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["at"]] or [np.empty(0, np.int64)]).astype(np.int64)
    count = np.concatenate([np.asarray(x, dtype=float) for x in got["n"]] or [np.empty(0)])
    words = got["n_words"].to_numpy()
    toxic = got["toxic"].to_numpy()
    share = np.bincount(owner, count * strong[at], len(got)) / np.maximum(words, 1)
    cuts = np.quantile(share[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, share, "left"), 0)
    weights, thresholds = fit_cumulative_link(owner, at, value(count, words[owner]), grades, len(chosen))
    return Model(
        {f: float(weights[k]) for f, k in vocabulary.items()}, frozenset(f for f, k in vocabulary.items() if strong[k]), tuple(map(float, thresholds))
    )


def _score(batches: Iterator[pa.RecordBatch], model: Model, cutoff: float) -> Iterator[pa.RecordBatch]:
    theta = np.array(model.thresholds)
    weights, evidence = model.weights, model.evidence
    for batch in small(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            found, n = features_of(text)
            own = [(weights[f], c) for f, c in found.items() if f in weights]
            z = sum(w * value(c, n) for w, c in own)
            rows.append((n, sum(c for f, c in found.items() if f in evidence), float(z)))
        z = np.array([r[2] for r in rows])
        above = 1.0 - _sigmoid(theta[None, :] - z[:, None]) if rows else np.empty((0, len(theta)))
        levels = np.hstack((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))))
        grade = np.argmax(levels[:, :-1] - levels[:, 1:], axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(above.sum(axis=1), pa.float64()),
                pa.array(above[:, 0], pa.float64()), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= cutoff),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Expected severity (0 to 3), P(toxic), the likeliest grade and the decision for every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_score, model=model, cutoff=cutoff), SCHEMA)


def _clean(batches: Iterator[pa.RecordBatch], model: Model, cutoff: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), pa.compute.fill_null(batch.column(at), "")], names=["doc_id", "text"])
        toxic = next(_score(iter([pair]), model, cutoff)).column(6)
        yield batch.filter(pa.compute.invert(toxic))


def drop_toxic(docs: DataFrame, model: Model, cutoff: float = CUTOFF, text_column: str = "text") -> DataFrame:
    """docs without the toxic rows, with docs' own columns, in one pass and without a join."""
    return docs.mapInArrow(partial(_clean, model=model, cutoff=cutoff, at=docs.columns.index(text_column)), docs.schema)
