"""A folder of arriving texts, chunked and appended as they come; a bounded number of files makes the back-pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import chunk, parse
from paperloom.operators.answer import events


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_each: int = 200):
    """Start a query over Parquet files of (doc_id, text): all that is there, then it ends. Each batch is one append.

    A batch that is run again after a failure overwrites its own folder, so no chunk is stored twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        chunk.chunk(parse.parse_pages(parse.plain_pages(batch))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(arriving: DataFrame, answer_batch, target: str, checkpoint: str):
    """Answer questions as they arrive: each batch goes through answer_batch (questions to answers, operators.answer.ask with its
    tables bound) and its events are written, status first, then the text in pieces, then done with the sources."""

    def tell(batch: DataFrame, number: int) -> None:
        events(answer_batch(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
