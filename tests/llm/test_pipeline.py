import os

import pytest

import corpus_pipeline as pipeline
from paperloom.llm.common import materialize

DIR = "/root/testdata/sf0.001"
PROSE = "plain words number {0} make up this document and every one of them differs {0}x {0}y {0}z from those of others {0}a {0}b {0}c {0}d"


def test_stages(spark, tmp_path):
    rows = [(k, PROSE.format(k)) for k in range(60)]
    rows += [(100 + k, PROSE.format(k).replace("every", "each") if k else PROSE.format(k)) for k in range(3)]
    rows += [(200, "too short"), (201, "$$$ " * 40), (202, None)]
    rows += [(300 + k, PROSE.format(300 + k) + " you moron") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    spark.createDataFrame([(k, 0) for k in range(60)] + [(300 + k, 1) for k in range(35)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang"]
    kept = sorted(r["doc_id"] for r in docs.collect())
    assert [k for k in kept if k >= 200] == [] and set(range(60)) <= set(kept) and 100 not in kept
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in packed.select("doc_id").distinct().collect()) == kept


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run(spark):
    out = pipeline.run(spark, DIR).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 1024).all()
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "packing"]


def chain(spark, docs, folder):
    """The four stages on given documents, each written and read again."""
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return docs, pipeline.STAGES[-1][1](spark, docs, folder)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_no_documents(spark, labels):
    kept, packed = chain(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), labels)
    assert kept.count() == 0 and packed.count() == 0 and kept.columns == ["doc_id", "text", "lang"]


def test_odd_rows_through_all_stages(spark, labels):
    """Null and repeated ids, null texts, equal rows, a very long text, and columns with names that the stages use."""
    long = " ".join(f"long{k}" for k in range(50_000))
    rows = [(1, PROSE.format(1)), (1, PROSE.format(2)), (1, PROSE.format(1)), (None, PROSE.format(3)), (None, PROSE.format(3)), (4, None), (5, ""), (6, long), (7, PROSE.format(4))]
    schema = "doc_id long, text string, key string, `group` string, row string, draw string, n_words string, kept string"
    docs = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema)
    kept, packed = chain(spark, docs, labels)
    assert kept.columns == docs.columns and all(r["key"] == r["kept"] == "x" for r in kept.collect())
    got = sorted((str(r["doc_id"]), r["text"][:60]) for r in kept.collect())
    assert got == sorted((str(i), t[:60]) for i, t in {(i, t) for i, t in rows if t})
    sizes = packed.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in sizes} == {1, 6, 7} and packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
