"""Ranked retrieval for batches of questions: vectors, terms, fusion, filters, budgets.

A ranked list is rows (query_id, chunk_id, score, rank); rank makes the order explicit and every order has a tie key.
Questions are a batch that the caller sends; chunks are the store, partitioned by knowledge base. Each search scores
ids alone and leaves contents to a late join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import nearest
from paperloom.functions import text as T
from paperloom.sources.scratch import materialize

RRF = 60
VECTOR_TOP, TERM_TOP = 20, 20
MIN_SCORE = 0.5
BUDGET = 3000
TOP = {"SIMPLE": 5, "STANDARD": 10, "COMPLEX": 20}
RERANK_TOP = 5
#: Fixed values of rank by places: the last place and the number of places that an index keeps, and the sum of all 1 / n^2.
LAST_PLACE, PLACES, BASEL = 16383, 256, 1.64493406685
#: Bytes of question vectors that are broadcast at a time; a larger batch goes in several blocks, each of which reads the stored
#: vectors once. 64 MB are 250 000 questions of 64 numbers.
BLOCK_BYTES = 64 << 20
#: Of a term search: a question's rarest terms that a chunk is looked up for first, rows that one task sorts, and rows of a broadcast.
PROBES, TASK_ROWS, BROADCAST_ROWS = 4, 1_000_000, 500_000


def _numbered(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))


def fan_out(questions: DataFrame) -> DataFrame:
    """One row for each knowledge base that a question asks, with its place kb_pos in the request."""
    return questions.select("*", F.posexplode("kb_ids").alias("kb_pos", "kb_id")).drop("kb_ids")


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = VECTOR_TOP, block: int | None = None) -> DataFrame:
    """Exact cosine top k of each (question, knowledge base): (query_id, kb_id, kb_pos, chunk_id, distance, kb_rank).

    questions: query_id, embedding, kb_ids; chunks: chunk_id, kb_id, embedding. Stored vectors never move: the rows of a question
    for each of its knowledge bases are counted and measured first, and blocks of them of at most BLOCK_BYTES (or of `block`
    rows) are broadcast. A worker takes one matrix product for each batch of stored vectors and gives k rows for each question and
    partition; a window over these picks the k best. So a knowledge base with a third of all chunks is no hot spot.
    Vectors that are null, zero or of another length than the questions' find nothing and are not found.
    """
    asked = fan_out(questions).select("query_id", "kb_pos", F.col("kb_id").cast("long").alias("kb_id"), "embedding").filter(F.size("embedding") > 0)
    return nearest_rows(asked, chunks, k, block)


def nearest_rows(asked: DataFrame, chunks: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """vector_topk() of rows (query_id, kb_pos, kb_id, embedding); several of one query_id and kb_pos share their k."""
    spark = chunks.sparkSession
    about = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).first()
    size = about["size"] or 0
    blocks = max(1, -(-about["n"] // (block or max(1, BLOCK_BYTES // (8 * max(1, size))))))
    kind = asked.schema["query_id"].dataType.simpleString()
    stored = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("kb_id").cast("long").alias("kb_id"), "embedding")
    made = f"query_id {kind}, kb_pos int, kb_id long, chunk_id long, distance double"
    n_stored = stored.count() if block is None else about["n"]
    if n_stored < about["n"]:
        # more questions than stored vectors: these are broadcast and the questions stay where they are
        blocks = max(1, -(-n_stored * 8 * max(1, size) // BLOCK_BYTES))
        moved, still, seek, keys = stored, asked.select("query_id", "kb_pos", "kb_id", "embedding"), nearest.search_stored, ("chunk_id",)
    else:
        moved, still, seek, keys = asked, stored, nearest.search, ("query_id", "kb_pos")
    found = None
    for n in range(blocks):
        part = moved.filter(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == n) if blocks > 1 else moved
        held = spark.sparkContext.broadcast(part.toArrow())
        near = still.mapInArrow(partial(seek, k=k, size=size, **{"stored" if still is not stored else "asked": held}), made)
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id", "kb_pos").orderBy("distance", "chunk_id")
    return found.withColumn("kb_rank", F.row_number().over(order).cast("int")).filter(F.col("kb_rank") <= k)


def postings(chunks: DataFrame, text: str = "content", positions: bool = False) -> DataFrame:
    """(chunk_id, kb_id, term, tf): the term index. Store it, partitioned by kb_id and bucketed by term to search often; stored_postings()
    does for one batch. With positions also the places of a term among the words, from 1, as far as a text index keeps them."""
    words = T.lexemes(F.col(text))
    placed = F.transform(words, lambda w, k: F.struct(w.alias("term"), F.least(k + 1, F.lit(LAST_PLACE)).alias("at"))) if positions else F.transform(words, lambda w: F.struct(w.alias("term")))
    ids = ["chunk_id", "kb_id"]
    twice = chunks.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").select(*ids)
    once = _runs(chunks.join(twice, ids, "left_anti").select(*ids, F.sort_array(placed).alias("w")), positions)
    # rows of one chunk count together
    again = _runs(chunks.join(twice, ids, "left_semi").select(*ids, F.sort_array(placed).alias("w")), positions).groupBy(*ids, "term")
    counted = [F.sum("tf").cast("int").alias("tf")]
    if positions:
        counted.append(F.slice(F.array_sort(F.flatten(F.collect_list("places"))), 1, PLACES).alias("places"))
    return once.unionByName(again.agg(*counted))


def _runs(rows: DataFrame, positions: bool) -> DataFrame:
    """Counts of the sorted words of each row, made in the row, so that words are not shuffled: a term's run ends where the next begins."""
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i)["term"] != F.get("w", i - 1)["term"]))
    begun = rows.filter(F.size("w") > 0).withColumn("s", starts)

    def run(start, k):
        n = F.coalesce(F.get("s", k + 1), F.size("w")) - start
        parts = [F.get("w", start)["term"].alias("term"), n.alias("tf")]
        if positions:
            parts.append(F.transform(F.slice("w", start + 1, F.least(n, F.lit(PLACES))), lambda x: x["at"]).alias("places"))
        return F.struct(*parts)

    # outer: of an inner one the optimiser filters by the array first, which makes it twice
    cut = begun.select("chunk_id", "kb_id", F.explode_outer(F.transform("s", run)).alias("r"))
    return cut.filter("r IS NOT NULL").select("chunk_id", "kb_id", "r.*")


def stored_postings(chunks: DataFrame, text: str = "content", positions: bool = False) -> DataFrame:
    """The term index as a table in the session's shared folder, as a search reads it more than once."""
    return materialize(postings(chunks, text, positions), "postings")


def nearness(places: list[np.ndarray]) -> float:
    """Rank of a text that has all terms of a question, by how near to each other they stand: each pair of places of two terms is
    evidence of its own, worth a tenth of the root of a weight that falls with their distance. One term alone is ranked by its count."""
    if len(places) == 1:
        return float((0.1 / np.arange(1, len(places[0]) + 1) ** 2).sum() / BASEL)
    doubt = 0.0
    for k, own in enumerate(places):
        for other in places[:k]:
            gap = np.abs(np.subtract.outer(np.asarray(own, float), np.asarray(other, float))).ravel()
            gap = gap[gap > 0]
            weight = np.where(gap > 100, 1e-30, 1.0 / (1.005 + 0.05 * np.exp(np.minimum(gap, 100) / 1.5 - 2.0)))
            doubt += np.log1p(-0.1 * np.sqrt(weight)).sum()
    return float(-np.expm1(doubt))


def term_ranked(questions: DataFrame, index: DataFrame, k: int = TERM_TOP) -> DataFrame:
    """term_topk() for all terms, ranked by nearness() instead of frequencies; index: stored_postings(positions=True)."""

    @F.pandas_udf("double")
    def rank(places: pd.Series) -> pd.Series:
        return places.map(lambda p: round(nearness(list(p)), 6))

    found = term_topk(questions, index, k=1 << 30)
    rows = index.join(found.join(question_terms(questions).select("query_id", "term"), "query_id"), ["chunk_id", "kb_id", "term"])
    scored = rows.groupBy("query_id", "kb_id", "kb_pos", "chunk_id").agg(F.collect_list("places").alias("places"))
    order = Window.partitionBy("query_id", "kb_pos").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.select("query_id", "kb_id", "kb_pos", "chunk_id", rank("places").alias("score"))
    return ranked.withColumn("kb_rank", F.row_number().over(order).cast("int")).filter(F.col("kb_rank") <= k)


def _lexemes():
    return F.array_distinct(F.flatten(F.transform(T.query_terms(F.col("question")), lambda t: T.lexemes(t))))


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, n_terms): distinct lexemes of each question's search terms; a blank question has none."""
    each = questions.select("query_id", _lexemes().alias("terms"))
    # outer: an inner one would filter by the terms first, and make them for every text that a question is joined with
    rows = each.select("query_id", F.explode_outer("terms").alias("term"), F.size("terms").alias("n_terms"))
    return rows.filter("term IS NOT NULL")


def _term_sets(questions: DataFrame) -> DataFrame:
    """(query_id, set_id, terms): the sorted distinct terms of each question; questions of the same terms have one set_id."""
    own = questions.groupBy("query_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(_lexemes())))).alias("terms"))
    return materialize(own.filter(F.size("terms") > 0).withColumn("set_id", F.min("query_id").over(Window.partitionBy("terms"))), "sets")


def _having(pairs: DataFrame, wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(set_id, kb_id, chunk_id, n_terms, tf) of pairs whose chunk has all of the n wanted terms.

    pairs: set_id, kb_id, chunk_id, n_terms, n, stored. wanted: term by set_id, or by set_id and kb_id. The postings of the
    chunks and what they are asked meet in as many tasks as they have rows for, so that none sorts more than about TASK_ROWS.
    """
    keys = ["chunk_id", "kb_id", "term"]
    held = index
    for part in (wanted.select("term"), pairs.select("chunk_id", "kb_id")):
        part = materialize(part.dropDuplicates(), "sought")
        if part.count() <= BROADCAST_ROWS:
            held = held.join(F.broadcast(part), part.columns, "left_semi")
    held = materialize(held, "held")
    each = pairs.join(wanted, [c for c in wanted.columns if c != "term"])
    rows = held.count() + (pairs.agg(F.sum("n")).first()[0] or 0)
    if rows > TASK_ROWS:
        held, each = (x.repartition(-(-rows // TASK_ROWS), *keys) for x in (held, each))
    found = held.join(each, keys).groupBy("set_id", "kb_id", "chunk_id", "n_terms", "n")
    return found.agg(F.sum("tf").cast("long").alias("tf"), F.count("*").alias("matched")).filter("matched = n").drop("matched", "n")


def term_topk(questions: DataFrame, index: DataFrame, k: int = TERM_TOP, any_term: bool = False) -> DataFrame:
    """Chunks of each (question, knowledge base) that have all its terms, or any of them, by the sum of frequencies.

    questions: query_id, question, kb_ids. A blank question finds nothing, and questions of the same terms are sought once. Where all
    terms are wanted, a question's rarest term in a knowledge base names the candidates; these are looked up for the PROBES rarest, and
    only what has them for all terms. A knowledge base that lacks a term gives none. So common words cost nothing but in questions that
    have no other.
    """
    sets = _term_sets(questions)
    lists = sets.filter("query_id = set_id")
    terms = materialize(lists.select("set_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")), "terms")
    if any_term:
        hits = index.join(terms, "term").groupBy("set_id", "kb_id", "chunk_id").agg(F.sum("tf").cast("long").alias("tf"))
    else:
        # each step is stored, as its size then tells whether it is broadcast to the index or the index has to move
        asked = materialize(terms.select("term").dropDuplicates(), "asked")
        spread = materialize(index.groupBy("kb_id", "term").agg(F.count("*").alias("n")).join(asked, "term", "left_semi"), "spread")
        # most questions have a word that no chunk has; they end here, before they meet each knowledge base
        anywhere = spread.select("term").dropDuplicates().join(terms, "term").groupBy("set_id", "n_terms").agg(F.count("*").alias("known"))
        terms = materialize(terms.join(anywhere.filter("known = n_terms").select("set_id"), "set_id", "left_semi"), "known")
        whole = spread.join(terms, "term").groupBy("set_id", "kb_id", "n_terms").agg(F.count("*").alias("known"))
        whole = materialize(whole.filter("known = n_terms").select("set_id", "kb_id"), "whole")
        by_rarity = Window.partitionBy("set_id", "kb_id").orderBy("n", "term")
        rarest = spread.join(terms, "term").join(whole, ["set_id", "kb_id"], "left_semi").withColumn("nth", F.row_number().over(by_rarity))
        rarest = materialize(rarest.filter(F.col("nth") <= PROBES).select("set_id", "kb_id", "term", "n_terms", "nth"), "rarest")
        named = index.join(rarest.filter("nth = 1"), ["kb_id", "term"]).select("set_id", "kb_id", "chunk_id", "n_terms", F.least("n_terms", F.lit(PROBES)).alias("n"))
        likely = _having(materialize(named, "named"), rarest.select("set_id", "kb_id", "term"), index)
        likely = materialize(likely.drop("tf").withColumn("n", F.col("n_terms")), "likely")
        hits = _having(likely, terms.select("set_id", "term"), index)
    # k of each set are as many as a question can show; then each of its questions gets them
    first = Window.partitionBy("set_id", "kb_id").orderBy(F.desc("tf"), "chunk_id")
    hits = hits.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).select("set_id", "kb_id", "chunk_id", "tf")
    hits = hits.join(sets.select("query_id", "set_id"), "set_id").drop("set_id")
    places = fan_out(questions.select("query_id", "kb_ids")).withColumn("kb_id", F.col("kb_id").cast("long"))
    scored = hits.withColumn("kb_id", F.col("kb_id").cast("long")).join(places, ["query_id", "kb_id"])
    order = Window.partitionBy("query_id", "kb_pos").orderBy(F.desc("tf"), "chunk_id")
    return scored.withColumn("kb_rank", F.row_number().over(order).cast("int")).filter(F.col("kb_rank") <= k)


def concatenated(found: DataFrame, per_kb: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank): lists of the knowledge bases put one after another in request order.

    per_kb=True ranks inside each knowledge base instead, so the first one has no head start.
    """
    if per_kb:
        return found.select("query_id", "chunk_id", F.col("kb_rank").alias("rank"))
    return _numbered(found, ["query_id"], "kb_pos", "kb_rank").select("query_id", "chunk_id", "rank")


def fuse(*lists: DataFrame, k: int = RRF, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank); ties go to the earlier list, then the better rank."""
    rows = None
    for n, one in enumerate(lists):
        part = one.select("query_id", "chunk_id", "rank", F.lit(n).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.min(F.struct("source", "rank")).alias("first")
    )
    out = _numbered(merged, ["query_id"], F.desc("score"), "first", "chunk_id")
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("query_id", "chunk_id", "score", "rank")


def hybrid(questions: DataFrame, chunks: DataFrame, index: DataFrame, top: int, any_term: bool = False) -> DataFrame:
    return fuse(concatenated(vector_topk(questions, chunks)), concatenated(term_topk(questions, index, any_term=any_term)), top=top)


def _leading(near: DataFrame, top: int) -> DataFrame:
    rows = concatenated(near.filter(F.col("kb_rank") <= top)).filter(F.col("rank") <= top)
    return rows.select("query_id", "chunk_id", F.round(F.lit(1.0) / F.col("rank"), 6).alias("score"), "rank")


def vector_only(questions: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """Vector search cut to the first `top` over all knowledge bases in request order, scored 1 / rank."""
    return _leading(vector_topk(questions, chunks, k=top), top)


def _both_vectors(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(search by the question's vector, search by the hypothesis's), in one pass over the stored vectors."""
    kinds = F.array(F.struct(F.lit(0).alias("kind"), "embedding"), F.struct(F.lit(1).alias("kind"), F.col("hyde_embedding").alias("embedding")))
    each = questions.select("query_id", "kb_ids", F.explode(kinds).alias("v")).filter("v.embedding IS NOT NULL")
    near = vector_topk(each.select(F.struct("query_id", F.col("v.kind").alias("kind")).alias("query_id"), "kb_ids", "v.embedding"), chunks)
    parts = [near.filter(F.col("query_id.kind") == k).withColumn("query_id", F.col("query_id.query_id")) for k in (0, 1)]
    return parts[0], parts[1]


def with_hypothesis(questions: DataFrame, chunks: DataFrame, index: DataFrame, top: int, any_term: bool = False) -> DataFrame:
    """Hybrid search fused with a vector search by the vector of a hypothetical answer (column hyde_embedding)."""
    near, guess = _both_vectors(questions, chunks)
    first = fuse(concatenated(near), concatenated(term_topk(questions, index, any_term=any_term)), top=VECTOR_TOP)
    return fuse(first.select("query_id", "chunk_id", "rank"), concatenated(guess), top=top)


def allowed_only(questions: DataFrame, accessible: DataFrame) -> DataFrame:
    """questions with kb_ids cut to those that their user may read; `denied` where none is left.

    accessible: user_id, kb_id.
    """
    each = questions.select("query_id", "user_id", F.posexplode("kb_ids").alias("kb_pos", "kb_id"))
    seen = each.join(accessible, ["user_id", "kb_id"], "left_semi").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("kb_pos", "kb_id"))), lambda x: x["kb_id"]).alias("ok")
    )
    out = questions.join(seen, "query_id", "left")
    return out.withColumns({"kb_ids": F.coalesce("ok", F.array().cast("array<bigint>")), "denied": F.col("ok").isNull()}).drop("ok")


def confident(ranked: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Rows of at least `least`; where a question has none, its best one."""
    own = Window.partitionBy("query_id")
    best = F.row_number().over(own.orderBy(F.desc("score"), "rank")) == 1
    kept = ranked.withColumns({"_any": F.max("score").over(own) >= least, "_best": best})
    return kept.filter((F.col("score") >= least) | (~F.col("_any") & F.col("_best"))).drop("_any", "_best")


def within_budget(ranked: DataFrame, budget: int = BUDGET, tokens: str = "tokens") -> DataFrame:
    """The leading rows of each question whose tokens fit; the first that doesn't fit ends the list.

    A first row that is over budget alone stays if `content` is present, cut after whole sentences.
    """
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumn("used", F.sum(tokens).over(upto))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) == 1
    summed = summed.withColumn("_cut", first & (F.col("used") > budget))
    if "content" not in ranked.columns:
        return summed.filter(F.col("used") <= budget).drop("_cut")
    cut = first_sentences(F.col("content"), budget)
    out = summed.withColumn("content", F.when(F.col("_cut"), cut).otherwise(F.col("content")))
    out = out.filter((F.col("used") <= budget) | (F.col("_cut") & ~T.is_blank(F.col("content"))))
    return out.withColumn(tokens, F.when(F.col("_cut"), T.estimate_tokens(F.col("content"))).otherwise(F.col(tokens))).drop("_cut")


def first_sentences(text, budget: int):
    """Whole sentences from the start, ended by 。！？ or a newline, while their token estimates fit."""
    parts = F.transform(F.split(text, r"(?<=[。！？\n])"), lambda s: F.struct(s.alias("s"), T.estimate_tokens(s).alias("n")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def take(state, part):
        fits = state["open"] & (state["used"] + part["n"] <= budget)
        return F.struct(
            F.when(fits, F.concat(state["text"], part["s"])).otherwise(state["text"]).alias("text"),
            F.when(fits, state["used"] + part["n"]).otherwise(state["used"]).alias("used"), fits.alias("open"),
        )

    return F.aggregate(parts, start, take, lambda s: s["text"])


def rerank(ranked: DataFrame, top: int = RERANK_TOP, enabled: bool = False) -> DataFrame:
    """The first `top` by rerank_score where a question has more than that and every score came; else by rank."""
    own = Window.partitionBy("query_id")
    if not enabled:
        return ranked.filter(F.col("rank") <= top)
    usable = (F.count("*").over(own) > top) & (F.count("rerank_score").over(own) == F.count("*").over(own))
    marked = ranked.withColumn("_use", usable)
    scored = marked.withColumn("score", F.when(F.col("_use"), F.col("rerank_score")).otherwise(F.col("score")))
    out = _numbered(scored.withColumnRenamed("rank", "_was"), ["query_id"], F.when(F.col("_use"), -F.col("score")), "_was")
    return out.filter(F.col("rank") <= top).drop("_was", "_use")


def by_route(questions: DataFrame, chunks: DataFrame, index: DataFrame, rerank_with: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each question by its own plan: SIMPLE by vectors, STANDARD hybrid, COMPLEX with a hypothesis and then the first five.

    The vectors of all questions and hypotheses are sought in one pass over the store, equal ones once, and the terms of all that need
    them in one join; the plans part afterwards, over ids alone. rerank_with adds rerank_score to ranked rows; without it five are kept by rank.
    """
    hard = F.col("route") == "COMPLEX"
    kinds = F.array(F.struct(F.lit(0).alias("kind"), "embedding"), F.struct(F.lit(1).alias("kind"), F.when(hard, F.col("hyde_embedding")).alias("embedding")))
    each = questions.select("query_id", "route", "kb_ids", F.explode(kinds).alias("v")).select("query_id", "route", "kb_ids", "v.*").filter("embedding IS NOT NULL")
    same = Window.partitionBy("kind", "embedding", "kb_ids")
    each = materialize(each.withColumn("vid", F.min("query_id").over(same)), "vectors")
    lead = each.groupBy("vid", "kind").agg(F.first("kb_ids").alias("kb_ids"), F.first("embedding").alias("embedding"))
    near = vector_topk(lead.select(F.struct("vid", "kind").alias("query_id"), "kb_ids", "embedding"), chunks)
    near = materialize(near.select(F.col("query_id.vid").alias("query_id"), F.col("query_id.kind").alias("kind"), "kb_pos", "chunk_id", "kb_rank"), "near")
    own, guessed = (each.filter(F.col("kind") == k).select("query_id", "vid", "route") for k in (0, 1))

    def of_vector(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("query_id", "vid")

    def worth(asked: DataFrame, kind: int, other: DataFrame, top: int) -> DataFrame:
        """Of the list by a vector what a fusion with other to `top` can show: its first `top` rows, and those that other has too. All
        others come behind the first ones, as a row of a single list has less score the lower it stands."""
        ranks = of_vector(concatenated(near.filter(F.col("kind") == kind)))
        head = asked.join(ranks.filter(F.col("rank") <= top), "vid")
        tail = other.select("query_id", "chunk_id").join(asked, "query_id").join(ranks.filter(F.col("rank") > top), ["vid", "chunk_id"])
        return head.select("query_id", "chunk_id", "rank").unionByName(tail.select("query_id", "chunk_id", "rank"))

    deep = own.filter("route <> 'SIMPLE'")
    terms = materialize(concatenated(term_topk(questions.filter("route <> 'SIMPLE'"), index)), "terms")
    fused = fuse(worth(deep, 0, terms, VECTOR_TOP), terms, top=VECTOR_TOP)
    fused = materialize(fused.join(questions.select("query_id", "route"), "query_id"), "fused")
    simple = own.filter("route = 'SIMPLE'").join(of_vector(_leading(near.filter("kind = 0"), TOP["SIMPLE"])), "vid").select("query_id", "chunk_id", "score", "rank")
    standard = fused.filter((F.col("route") == "STANDARD") & (F.col("rank") <= TOP["STANDARD"])).drop("route")
    first = fused.filter(hard).select("query_id", "chunk_id", "rank")
    wide = fuse(first, worth(guessed, 1, first, TOP["COMPLEX"]), top=TOP["COMPLEX"])
    scored = rerank_with(wide) if rerank_with else wide
    complex_ = rerank(scored, enabled=rerank_with is not None).select("query_id", "chunk_id", "score", "rank")
    return simple.unionByName(standard).unionByName(complex_)


def expanded(questions: DataFrame, rewrites: str = "rewrites") -> DataFrame:
    """(query_id, variant, question): the question itself and up to three rewrites, given as lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(rewrites), F.lit("")), "\n"), T.strip), lambda x: (x != "") & (x != F.col("question")))
    every = F.concat(F.array("question"), F.slice(lines, 1, 3))
    return questions.select("query_id", F.posexplode(every).alias("variant", "question"))
