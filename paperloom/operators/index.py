"""Index runs: pending documents to chunks, and what documents and tasks look like afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.operators import chunk, embed, library, parse


def started(documents: DataFrame, tasks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents in work, tasks running): what is pending of both, before a run."""
    due = F.col("status") == "PENDING"
    return (
        documents.withColumn("status", F.when(due, "PROCESSING").otherwise(F.col("status"))),
        tasks.withColumns({"started_at": F.when(due, now).otherwise(F.col("started_at")), "status": F.when(due, "RUNNING").otherwise(F.col("status"))}),
    )


def indexed(documents: DataFrame, pages: DataFrame, now: Column, papers: DataFrame | None = None, structure_aware: bool = True) -> DataFrame:
    """Chunks of the documents in work, with doc_version and embedding_text: structured, without reference lists, and one
    about the paper itself."""
    work = documents.filter("status = 'PROCESSING'").select(F.col("id").alias("doc_id"), "kb_id", F.col("version").alias("doc_version"), "file_name")
    parsed = parse.parse_pages(pages.join(work.select("doc_id"), "doc_id", "left_semi"))
    cut = chunk.chunk(parsed, structure_aware)
    about = work.select("doc_id", "file_name") if papers is None else work.select("doc_id", "file_name").join(papers, "doc_id", "left")
    texts = chunk.with_embedding_text(cut, about)
    every = texts.unionByName(chunk.metadata_chunks(texts, about.join(texts.select("doc_id").dropDuplicates(), "doc_id", "left_semi")))
    return every.join(work.drop("file_name"), "doc_id").withColumns({"created_at": now, "chunk_id": F.xxhash64("doc_id", "doc_version", "content_type", "chunk_index")})


def embedded(chunks: DataFrame, cache: DataFrame, model: providers.Embed) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors of their embedding texts, the cache with the new ones)."""
    return embed.embed_with_cache(chunks, cache, model, "embedding_text")


def finished(documents: DataFrame, tasks: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, tasks) after a run: DONE with counts where there are chunks, FAILED with the reason where there is no text."""
    counts = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").cast("int").alias("_chunks"), F.sum("token_count").cast("int").alias("_tokens"))
    run, ok = F.col("status") == "PROCESSING", F.col("_chunks").isNotNull()
    docs = documents.join(counts, "id", "left").withColumns(
        {
            "chunk_count": F.when(run, F.col("_chunks")).otherwise(F.col("chunk_count")), "token_count": F.when(run, F.col("_tokens")).otherwise(F.col("token_count")),
            "indexed_at": F.when(run & ok, now).otherwise(F.col("indexed_at")), "error_msg": F.when(run & ~ok, parse.NEEDS_OCR).when(run, None).otherwise(F.col("error_msg")),
            "status": F.when(run & ok, "DONE").when(run, "FAILED").otherwise(F.col("status")),
        }
    ).select(*documents.columns)
    known = counts.select(F.col("id").alias("doc_id"), F.lit(True).alias("_ok"))
    running, fine = F.col("status") == "RUNNING", F.col("_ok").isNotNull()
    done = tasks.join(known, "doc_id", "left").withColumns(
        {
            "finished_at": F.when(running, now).otherwise(F.col("finished_at")), "error_msg": F.when(running & ~fine, parse.NEEDS_OCR).otherwise(F.col("error_msg")),
            "status": F.when(running & fine, "DONE").when(running, "FAILED").otherwise(F.col("status")),
        }
    ).select(*tasks.columns)
    return docs, done


def stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after a run: the new ones take the place of older versions of their documents."""
    return library.latest_versions(old.unionByName(new, allowMissingColumns=True))
