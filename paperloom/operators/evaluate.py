"""Retrieval quality: hits, ranks, faithfulness, by run and by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.operators import retrieve, steps


def first_hits(questions: DataFrame, ranked: DataFrame, depth: int = 10) -> DataFrame:
    """(dataset_id, hit, rank): the best place of an expected chunk among the first `depth`, for every question.

    questions: dataset_id, expected_chunk_ids; ranked: query_id (= dataset_id), chunk_id, rank.
    """
    wanted = questions.select("dataset_id", F.explode(F.array_distinct("expected_chunk_ids")).alias("chunk_id"))
    shown = ranked.filter(F.col("rank") <= depth).select(F.col("query_id").alias("dataset_id"), "chunk_id", "rank")
    best = shown.join(wanted, ["dataset_id", "chunk_id"]).groupBy("dataset_id").agg(F.min("rank").alias("rank"))
    return questions.select("dataset_id").join(best, "dataset_id", "left").withColumn("hit", F.col("rank").isNotNull())


def run(
    questions: DataFrame, chunks: DataFrame, index: DataFrame, version: str, at: Column, rank_with: Callable[[DataFrame], DataFrame] | None = None, answers: DataFrame | None = None,
    check: providers.Ask | None = None, deep: int = 20, depth: int = 10,
) -> DataFrame:
    """Results of an evaluation, one row for each question: hybrid search with a hypothesis to `deep`, reranked to `depth`, and the place of the first
    expected chunk.

    questions: id, question, kb_id, embedding, hyde_embedding, expected_chunk_ids. rank_with adds rerank_score. With answers (query_id, answer) and a
    check, faithfulness is that of the answer against the first five candidates, not the reranked ones.
    """
    asked = questions.select(F.col("id").alias("query_id"), "question", F.array("kb_id").alias("kb_ids"), "embedding", "hyde_embedding")
    found = retrieve.with_hypothesis(asked, chunks, index, deep)
    shown = retrieve.rerank(rank_with(found) if rank_with else found, depth, enabled=rank_with is not None)
    out = first_hits(questions.select(F.col("id").alias("dataset_id"), "expected_chunk_ids"), shown, depth)
    out = out.withColumns({"eval_version": F.lit(version), "eval_at": at})
    if answers is None or check is None:
        return out.withColumns({"actual_answer": F.lit(None).cast("string"), "faithfulness": F.lit(None).cast("double")})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    context = found.filter("rank <= 5").join(chunks.select("chunk_id", "content"), "chunk_id").groupBy("query_id").agg(F.array_join(texts, "\n\n").alias("context"))
    told = answers.select("query_id", "answer").join(context, "query_id", "left").join(asked.select("query_id", "question"), "query_id")
    judged = told.select(F.col("query_id").alias("dataset_id"), F.col("answer").alias("actual_answer"), steps.checked(F.col("question"), F.col("answer"), F.col("context"), check)["score"].alias("faithfulness"))
    return out.join(judged, "dataset_id", "left")


def run_report(results: DataFrame) -> DataFrame:
    """One row for a run: every question counts in hit rate and MRR, only those with a score in faithfulness."""
    return results.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0)).cast("long").alias("hits"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("faithfulness"), F.lit(0.0)).alias("faithfulness"),
    )


def history(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row for each (knowledge base, version), where a missing faithfulness counts as 0."""
    joined = results.join(dataset.select(F.col("id").alias("dataset_id"), "kb_id"), "dataset_id")
    return joined.groupBy("kb_id", "eval_version").agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("hit"), 1).otherwise(0)).cast("long").alias("hits"),
        F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(F.col("rank") > 0, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.avg(F.coalesce("faithfulness", F.lit(0.0))).alias("faithfulness"), F.max("eval_at").alias("eval_at"),
    )


def summary(report: DataFrame) -> DataFrame:
    return report.withColumn("summary", F.format_string("HitRate: %.1f%% / MRR: %.4f", F.col("hit_rate") * 100, F.col("mrr")))
