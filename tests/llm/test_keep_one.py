"""The filter for near-duplicates drops nothing else."""

from paperloom.llm import neardup


def words(name):
    return " ".join(f"{name}{k}" for k in range(30))


def test_rows_without_an_id_and_repeated_ids(spark):
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (1, words("c")), (1, words("d")), (1, words("c")), (2, words("c")), (3, words("e")), (4, words("d"))]
    docs = spark.createDataFrame([(t, k, "x") for k, t in rows], "text string, doc_id long, lang string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["text"][0], r["doc_id"]) for r in kept.collect())
    assert [g[0] for g in got] == ["a", "b", "c", "d", "e"]
    assert [g[1] for g in got][:3] == [None, None, 1] and got[3][1] in (1, 4) and got[4][1] == 3


def test_an_id_with_two_texts_keeps_both(spark):
    docs = spark.createDataFrame([(7, words("a")), (7, words("b")), (7, words("b"))], "doc_id int, text string")
    assert sorted((r["doc_id"], r["text"][0]) for r in neardup.keep_one(docs).collect()) == [(7, "a"), (7, "b")]
