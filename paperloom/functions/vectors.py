"""Column functions on vectors, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its norm, as doubles, so that a cosine is one dot product."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def to_literal(v: Column) -> Column:
    """[a,b,...]"""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def to_csv(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def from_text(text: Column) -> Column:
    """Either form back to a vector; blank gives an empty one."""
    bare = F.regexp_replace(text, r"[\[\] ]", "")
    return F.when(bare == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(bare, ","), lambda x: x.cast("float")))


def embedding_key(text: Column) -> Column:
    return F.concat(F.lit("emb:v1:"), F.md5(text.cast("binary")))


def answer_key(question: Column, kb_ids: Column) -> Column:
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(kb_ids), lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.md5(F.concat(question, F.lit(":"), listed).cast("binary"))
