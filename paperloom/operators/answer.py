"""From ranked chunks to an answer with sources: context, prompt, citations, not-found replies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import providers, vectors
from paperloom.functions import text as T
from paperloom.operators import retrieve, steps
from paperloom.sources.scratch import materialize

# --- fixed values that results depend on ---
UNKNOWN_DOCUMENT = "未知文档"
NOT_FOUND = "No reliable evidence for this question was found in the literature library."
RULES = """Answering rules:
1. Answer only from the reference content. Do not add paper facts from your own knowledge.
2. Cite every key claim, method detail, experiment result, limitation, dataset, metric, or conclusion.
3. Use citation format exactly like this: (source: [ref1]). For multiple references: (source: [ref1][ref2]).
4. If the references are insufficient, say that the current literature library does not contain reliable evidence for the requested point.
5. Distinguish paper facts from your analysis. Any inference must be introduced as an inference from the references.
6. Preserve paper terminology, variables, datasets, metrics, experimental settings, and section structure when relevant.
7. For surveys, comparisons, or writing assistance, keep every substantive statement traceable to references.
"""
PREAMBLE = """You are a literature assistant for personal academic reading and paper writing.
Respond in the same language as the user unless they ask otherwise.

Reference content: %d chunks, labeled from [ref1] to [ref%d].
---
%s
---

"""
# --- end of fixed values ---


def contexts(chosen: DataFrame) -> DataFrame:
    """(query_id, context, n_chunks): the chosen chunks as [refN] blocks in rank order, numbered from 1.

    chosen: query_id, rank, section_title, content.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit(" "), "section_title").alias("title"), "content")))
    block = lambda x, k: F.concat(F.lit("[ref"), (k + 1).cast("string"), F.lit("]"), F.coalesce(x["title"], F.lit("")), F.lit("\n"), x["content"])
    listed = chosen.groupBy("query_id").agg(rows.alias("r"))
    return listed.select("query_id", T.strip(F.array_join(F.transform("r", block), "\n\n")).alias("context"), F.size("r").alias("n_chunks"))


def prompts(context: DataFrame) -> DataFrame:
    return context.withColumn("prompt", F.concat(F.format_string(PREAMBLE, "n_chunks", "n_chunks", "context"), F.lit(RULES)))


def sources(answers: DataFrame, chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (query_id, source_no, chunk_id, doc_id, doc_name, page_num, section_title, excerpt, score) that an answer cites.

    An answer without a citation has all chunks for sources; numbers beyond the chunks are skipped. The place of a
    chunk is its position in rank order, and source_no the order of citation.
    """
    own = retrieve._numbered(chosen.withColumnRenamed("rank", "_rank"), ["query_id"], "_rank").withColumnRenamed("rank", "ref")
    sized = answers.join(chosen.groupBy("query_id").agg(F.count("*").cast("int").alias("n")), "query_id")
    refs = F.when(F.size(T.cited(F.col("answer"))) > 0, T.cited(F.col("answer"))).otherwise(F.sequence(F.lit(1), F.col("n")))
    named = sized.select("query_id", F.posexplode(refs).alias("source_no", "ref"))
    names = documents.select("doc_id", F.col("file_name").alias("doc_name"))
    return named.join(own, ["query_id", "ref"]).join(names, "doc_id", "left").select(
        "query_id", "source_no", "chunk_id", "doc_id", F.coalesce("doc_name", F.lit(UNKNOWN_DOCUMENT)).alias("doc_name"),
        "page_num", "section_title", T.excerpt(F.col("content")).alias("excerpt"), "score",
    )


def sources_json(rows: DataFrame) -> DataFrame:
    """(query_id, sources): a JSON list in citation order."""
    fields = [c for c in rows.columns if c not in ("query_id", "source_no")]
    listed = F.array_sort(F.collect_list(F.struct("source_no", F.struct(*fields).alias("s"))))
    return rows.groupBy("query_id").agg(F.to_json(F.transform(listed, lambda x: x["s"])).alias("sources"))


@dataclass(frozen=True)
class Models:
    """The functions that a plan asks; without one its step does without: no reranking, no check, routes by rule, the
    question's own hyde_embedding."""

    generate: providers.Ask = providers.echo
    normalise: providers.Ask | None = None
    classify: providers.Ask | None = None
    guess: providers.Ask | None = None
    embed: providers.Embed | None = None
    rank: providers.Rank | None = None
    check: providers.Ask | None = None


def ask(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, generate: providers.Ask = providers.echo,
    least: float = retrieve.MIN_SCORE, budget: int = retrieve.BUDGET, always_complex: bool = False,
    index: DataFrame | None = None, models: Models | None = None, cache: DataFrame | None = None, count: Callable[[Column], Column] = T.estimate_tokens,
) -> DataFrame:
    """A whole batch: normalise, look into the cache, route, retrieve, filter, trim, generate, cite, check a fifth. One row for each
    question, found or not, with `cached` where the cache had its answer.

    questions: query_id, question, kb_ids, embedding, and hyde_embedding unless models.guess and models.embed make it; chunks:
    chunk_id, doc_id, kb_id, embedding, content, page_num, section_title; index: the stored postings of chunks, made here if not
    given; cache: cache_key, answer, sources. always_complex is the chat plan, which neither routes nor caches. Answers worth
    keeping come from embed.answers_to_cache().
    """
    models = models or Models(generate)
    known = questions.withColumn("cache_question", steps.normalized(F.col("question"), models.normalise))
    kind = F.lit("COMPLEX") if always_complex else steps.routed(F.col("question"), models.classify)
    routed = known.withColumn("route", kind)
    if models.normalise or models.classify:
        routed = materialize(routed, "routed")
    if cache is not None and not always_complex:
        key = vectors.answer_key(F.col("cache_question"), F.col("kb_ids"))
        kept = cache.select(F.col("cache_key").alias("_key"), F.col("answer").alias("_answer"), F.col("sources").alias("_sources"))
        routed = routed.join(kept, key == F.col("_key"), "left").drop("_key")
    else:
        routed = routed.withColumns({"_answer": F.lit(None).cast("string"), "_sources": F.lit(None).cast("string")})
    asked = routed.filter(F.col("_answer").isNull())
    if models.guess and models.embed:
        asked = steps.with_hypotheses(asked, models.guess, models.embed, F.col("route") == "COMPLEX")
    # several branches read the ranks and the replies, and a model is to be asked once
    ranked = materialize(retrieve.by_route(asked, chunks, retrieve.stored_postings(chunks) if index is None else index, _ranker(asked, chunks, models.rank)), "ranked")
    picked = retrieve.confident(ranked, least).join(chunks.drop("embedding"), "chunk_id").withColumn("tokens", count(F.col("content")))
    chosen = retrieve.within_budget(picked, budget)
    told = prompts(contexts(chosen)).withColumn("answer", providers.answer(F.col("prompt"), models.generate, F.lit(NOT_FOUND)))
    told = materialize(told.select("query_id", "context", "answer"), "answers")
    listed = sources_json(sources(told.select("query_id", "answer"), chosen, documents))
    told = told.join(routed.select("query_id", "question"), "query_id")
    verdict = F.lit(None).cast("struct<score:double,faithful:boolean,reason:string>")
    if models.check:
        one_in_five = F.pmod(F.xxhash64("query_id"), F.lit(5)) == 0
        verdict = F.when(one_in_five, steps.checked(F.col("question"), F.col("answer"), F.col("context"), models.check))
    told = told.select("query_id", "answer", verdict.alias("faithfulness"))
    out = routed.select("query_id", "question", "kb_ids", "cache_question", "route", "_answer", "_sources").join(told, "query_id", "left").join(listed, "query_id", "left")
    answer = F.coalesce("_answer", "answer")
    out = out.withColumns(
        {"not_found": answer.isNull(), "cached": F.col("_answer").isNotNull(), "sources": F.coalesce("_sources", "sources", F.lit("[]")), "answer": F.coalesce(answer, F.lit(NOT_FOUND))}
    )
    return out.drop("_answer", "_sources")


def _ranker(questions: DataFrame, chunks: DataFrame, rank: providers.Rank | None) -> Callable[[DataFrame], DataFrame] | None:
    """A function that adds rerank_score to ranked ids: their contents are joined for the model and left behind."""
    if rank is None:
        return None
    asked, said = questions.select("query_id", "question"), chunks.select("chunk_id", "content")

    def scored(ranked: DataFrame) -> DataFrame:
        rows = ranked.join(said, "chunk_id").join(asked, "query_id")
        return rows.withColumn("rerank_score", providers.relevance(F.col("question"), F.col("content"), rank)).drop("question", "content")

    return scored


def chat(questions: DataFrame, chunks: DataFrame, documents: DataFrame, now: Column, **more) -> tuple[DataFrame, DataFrame]:
    """(answers, messages to append) of a chat turn: always by hypothesis and reranking, never routed or cached.

    questions also have session_id. Each turn gives the user's message and, after it, the assistant's with its sources.
    """
    answers = ask(questions, chunks, documents, always_complex=True, **more).join(questions.select("query_id", "session_id"), "query_id")
    return answers, turns(answers, now)


def turns(answers: DataFrame, now: Column) -> DataFrame:
    """The two messages of each answered question, (session_id, role, content, sources, created_at, position)."""
    none = F.lit(None).cast("string")
    said = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), none.alias("sources")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("sources").alias("sources")),
    )
    return answers.select("session_id", now.alias("created_at"), F.posexplode(said).alias("position", "m")).select("session_id", "m.*", "created_at", "position")


def events(answers: DataFrame, size: int = 16) -> DataFrame:
    """An answer as the events that a listener gets: status, the text in pieces, then done with the sources; (query_id, n, event, data)."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("answer") / size), F.lit(1)).cast("int") - 1),
        lambda k: F.struct(F.lit("token").alias("event"), F.substring(F.col("answer"), k * size + 1, F.lit(size)).alias("data")),
    )
    one = lambda name, data: F.array(F.struct(F.lit(name).alias("event"), data.alias("data")))
    every = F.concat(one("status", F.lit("generating")), pieces, one("done", F.col("sources")))
    return answers.select("query_id", F.posexplode(every).alias("n", "e")).select("query_id", "n", "e.*")


def told_in_full(events: DataFrame) -> DataFrame:
    """(query_id, answer): the text pieces of each answer put together in order."""
    said = F.array_sort(F.collect_list(F.struct("n", "data")))
    return events.filter("event = 'token'").groupBy("query_id").agg(F.array_join(F.transform(said, lambda x: x["data"]), "").alias("answer"))


def sampled(rows: DataFrame, one_in: int = 5, key: str = "query_id") -> DataFrame:
    """A fifth of the rows, the same ones every time, for costly checks."""
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)
