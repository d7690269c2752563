"""Embedding with a cache: one lookup and at most one model call for each distinct text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import providers, vectors


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(cache_key, text): each distinct text that the cache lacks, once."""
    keyed = texts.select(vectors.embedding_key(F.col(text)).alias("cache_key"), F.col(text).alias("text"))
    return keyed.groupBy("cache_key").agg(F.min("text").alias("text")).join(cache.select("cache_key"), "cache_key", "left_anti")


def live(cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Entries not older than their time to live at `now`."""
    return cache.filter(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed: providers.Embed, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, the cache with what was missing). Only misses reach the model, each once."""
    new = cache_misses(texts, cache, text).withColumn("embedding", providers.embedding(F.col("text"), embed)).select("cache_key", "embedding")
    full = cache.select("cache_key", "embedding").unionByName(new)
    keyed = texts.withColumn("cache_key", vectors.embedding_key(F.col(text)))
    return keyed.join(full, "cache_key", "left").drop("cache_key"), full


def answers_cached(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions (question, kb_ids) with the cached answer or null."""
    keyed = questions.withColumn("cache_key", vectors.answer_key(F.col("question"), F.col("kb_ids")))
    return keyed.join(cache.select("cache_key", "answer"), "cache_key", "left")


def answers_to_cache(responses: DataFrame) -> DataFrame:
    """What an answer cache keeps: new responses that found something, by their question as the cache knows it."""
    question = F.col("cache_question") if "cache_question" in responses.columns else F.col("question")
    fresh = ~F.col("not_found") & (~F.col("cached") if "cached" in responses.columns else F.lit(True))
    more = ["sources"] if "sources" in responses.columns else []
    return responses.filter(fresh).select(vectors.answer_key(question, F.col("kb_ids")).alias("cache_key"), "answer", *more)


def step_misses(questions: DataFrame, cache: DataFrame, step: str) -> DataFrame:
    """Distinct questions whose reply of a step (route, normalise, guess) is not kept yet; keys are strong hashes, not 32 bits."""
    keyed = questions.select(step_key(F.col("question"), step).alias("cache_key"), "question").dropDuplicates(["cache_key"])
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def step_key(question: Column, step: str) -> Column:
    return F.concat(F.lit(f"{step}:"), F.sha2(question.cast("binary"), 256))
