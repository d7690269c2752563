"""Documents to training sequences: quality rules, toxicity, near-duplicate removal, packing.

Each stage takes the documents that its predecessor kept and, but for the last, returns rows with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import neardup, packing, quality, toxicity
from paperloom.llm.common import Scratch
from paperloom.llm.queries import table, tokenizer_path
from paperloom.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps: all but those too short, repeating themselves, or full of symbols, doubled lines, very long
    words or exclamations. A null text counts as empty and goes; rows without an id and repeated ones are judged like others."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labelled ones among them does not call toxic: all of them where no label or only one kind
    is left. Rows without an id are judged but not fitted on; a null text stays."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id. Rows without an id, and other texts of a repeated id, are
    documents of their own; of equal rows one stays."""
    ship_package(spark)
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Rows without an id have none; a null text is the end-of-document id alone."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL expresses neither the toxicity model nor signatures and tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on a stored table of what its predecessor kept; a table goes once the next one is there."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.table(stage(spark, docs, sf_dir), name)
        if held:
            held.drop()
        held = own
    packed = STAGES[-1][1](spark, docs, sf_dir)
    held.drop()  # packing has stored the pieces
    return packed
