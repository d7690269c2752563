"""Functions for SQL users: register(spark), then SELECT ... FROM t, LATERAL chunk_text(t.text, 512, 64)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf


def register(spark: SparkSession) -> None:
    """chunk_text(text, size, overlap), a table function, and heading_type(line)."""
    from paperloom.operators import chunk, parse

    @udtf(returnType="pos int, start int, end int, content string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for pos, (start, end, content) in enumerate(chunk.windows(text, size, overlap)):
                yield pos, start, end, content

    @pandas_udf("string")
    def heading_type(lines: pd.Series) -> pd.Series:
        return lines.map(parse.heading_type, na_action="ignore")

    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("heading_type", heading_type)
