"""Steps whose rows or bytes must not outgrow their input."""

import random

from pyspark.sql import functions as F

from paperloom.functions import nearest
from paperloom.operators import parse, retrieve


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_more_questions_than_stored_vectors_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(nearest, "search", None)
    asked = spark.createDataFrame([(k, [1.0, k / 9.0], [0, 1]) for k in range(9)], "query_id long, embedding array<float>, kb_ids array<long>")
    stored = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0])], "chunk_id long, kb_id long, embedding array<float>")
    found = {(r["query_id"], r["kb_id"], r["kb_rank"]): r["chunk_id"] for r in retrieve.vector_topk(asked, stored, 2).collect()}
    assert found == {(k, kb, rank): c for k in range(9) for kb, rank, c in ((0, 1, 1), (0, 2, 2), (1, 1, 3))}


def test_terms_are_made_of_asked_texts_alone(spark):
    ids = spark.range(3).withColumnRenamed("id", "query_id")
    texts = spark.range(9).select(F.col("id").alias("query_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("question"))
    filters = [x for x in plan(retrieve.question_terms(ids.join(texts, "query_id", "left"))).splitlines() if "Filter" in x]
    assert not [x for x in filters if "regexp_extract_all" in x]


def test_words_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, 0, "b a b"), (2, 0, ""), (3, 0, None), (4, 1, "a b"), (4, 1, "b")], "chunk_id long, kb_id long, content string")
    got = sorted(map(tuple, retrieve.postings(rows, positions=True).select("chunk_id", "term", "tf", "places").collect()))
    assert got == [(1, "a", 1, [2]), (1, "b", 2, [1, 3]), (4, "a", 1, [1]), (4, "b", 2, [1, 2])]
    words = F.transform(F.split("content", " "), lambda w: F.struct(w.alias("term")))
    assert "Aggregate" not in plan(retrieve._runs(rows.select("chunk_id", "kb_id", F.sort_array(words).alias("w")), False))


def test_pages_of_one_large_document_are_cleaned_in_many_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        said = F.concat(F.lit("Running Head\npage text "), F.col("id").cast("string"))
        pages = spark.range(5000).select(F.lit("one").alias("doc_id"), F.col("id").alias("page_num"), said.alias("text"))
        out = parse.drop_noise(pages).withColumn("task", F.spark_partition_id())
        rows = out.agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n"), F.max(F.col("text").contains("Running")).alias("heads")).first()
        assert rows["tasks"] > 1 and rows["n"] == 5000 and not rows["heads"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def indexed(spark, texts):
    return retrieve.postings(spark.createDataFrame([(k, k % 2, x) for k, x in enumerate(texts)], "chunk_id long, kb_id long, content string"))


def asked(spark, texts):
    return spark.createDataFrame([(k, x, [1, 0]) for k, x in enumerate(texts)], "query_id long, question string, kb_ids array<long>")


def test_questions_of_the_same_terms_are_sought_once(spark, monkeypatch):
    sizes, kept = {}, retrieve.materialize

    def noted(df, name):
        out = kept(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(retrieve, "materialize", noted)
    found = retrieve.term_topk(asked(spark, ["red fox", "Fox, red!"] * 20), indexed(spark, ["a red fox", "red fox red"] * 30), 3)
    rows = {(r["query_id"], r["kb_pos"], r["kb_rank"]): (r["chunk_id"], r["tf"]) for r in found.collect()}
    assert rows == {(q, pos, rank + 1): (2 * rank + 1 - pos, 3 - pos) for q in range(40) for pos in (0, 1) for rank in range(3)}
    assert sizes["named"] == 60


def test_candidates_meet_their_postings_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TASK_ROWS", 20, raising=False)
    found = retrieve.term_topk(asked(spark, ["red fox", "red hen", "red"]), indexed(spark, ["a red fox", "a red hen"] * 30))
    # 30 candidates of 2 terms and twice 60 of 1 or 2 against 60 chunks of 2 asked terms
    assert found.count() == 2 * 20 + 2 * 20 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_term_search_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 10, raising=False)
    draw, words = random.Random(7), [f"w{k}" for k in range(12)]
    texts = [" ".join(draw.choices(words, range(12, 0, -1), k=draw.randrange(0, 30))) for _ in range(150)]
    questions = [" ".join(draw.sample(words, draw.randrange(0, 8))) for _ in range(40)] + ["w0 nowhere", "w3", "w3 w3", "w1 w0", "w0 w1"]
    want = set()
    for q, question in enumerate(questions):
        terms = set(question.split())
        for pos, kb in enumerate((1, 0)):
            hits = [(-sum(x.split().count(t) for t in terms), k) for k, x in enumerate(texts) if k % 2 == kb and terms and terms <= set(x.split())]
            want |= {(q, kb, pos, k, -tf, rank + 1) for rank, (tf, k) in enumerate(sorted(hits)[:5])}
    found = retrieve.term_topk(asked(spark, questions), indexed(spark, texts), 5).select("query_id", "kb_id", "kb_pos", "chunk_id", "tf", "kb_rank").collect()
    assert set(map(tuple, found)) == want and len(found) == len(want)
