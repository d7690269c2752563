import pytest
from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.operators import answer, embed, evaluate, retrieve


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")


def test_fusion_golden(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 10, 2)], "query_id long, chunk_id long, rank int")
    got = [(r["chunk_id"], r["score"]) for r in retrieve.fuse(a, b).orderBy("rank").collect()]
    assert got == [(10, 0.032522), (30, 0.032266), (20, 0.016129)]
    swapped = [(r["chunk_id"], r["score"]) for r in retrieve.fuse(b, a).orderBy("rank").collect()]
    assert sorted(swapped) == sorted(got)


def test_fusion_ties_go_to_the_first_list(spark):
    one = spark.createDataFrame([(1, 5, 1)], "query_id long, chunk_id long, rank int")
    two = spark.createDataFrame([(1, 3, 1)], "query_id long, chunk_id long, rank int")
    assert [r["chunk_id"] for r in retrieve.fuse(one, two).orderBy("rank").collect()] == [5, 3]


def test_confidence_keeps_the_best(spark):
    rows = ranked(spark, [(1, 1, 1.0, 1), (1, 2, 0.5, 2), (1, 3, 0.333, 3), (2, 1, 0.0325, 1), (2, 2, 0.0323, 2)])
    assert sorted((r["query_id"], r["chunk_id"]) for r in retrieve.confident(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_budget_stops_at_the_first_overflow(spark):
    rows = ranked(spark, [(1, k, 1.0, k) for k in range(1, 5)]).join(spark.createDataFrame([(1, 1000), (2, 1500), (3, 800), (4, 10)], "chunk_id long, tokens int"), "chunk_id")
    assert sorted(r["chunk_id"] for r in retrieve.within_budget(rows).collect()) == [1, 2]


def test_budget_cuts_a_first_row_after_sentences(spark):
    rows = ranked(spark, [(1, 1, 1.0, 1)]).withColumns({"content": F.lit("一二三四。五六七八。九"), "tokens": F.lit(20)})
    got = retrieve.within_budget(rows, 8).collect()
    assert [(r["content"], r["tokens"]) for r in got] == [("一二三四。", 6)]
    assert retrieve.within_budget(rows, 2).count() == 0


def vectors(spark):
    rows = [(k, 1 + k % 2, [float(k), 1.0]) for k in range(1, 9)]
    return spark.createDataFrame(rows, "chunk_id long, kb_id long, embedding array<float>")


@pytest.mark.parametrize("block", [1, 2000])
def test_blocks_of_questions_find_the_same(spark, block):
    q = spark.createDataFrame([(k, [1.0, k / 3.0], [1, 2]) for k in range(4)], "query_id long, embedding array<float>, kb_ids array<bigint>")
    got = sorted(tuple(r) for r in retrieve.vector_topk(q, vectors(spark), 3, block).collect())
    assert len(got) == 24 and got == sorted(tuple(r) for r in retrieve.vector_topk(q, vectors(spark), 3).collect())


def test_first_knowledge_base_wins(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], [1, 2])], "query_id long, embedding array<float>, kb_ids array<bigint>")
    top = retrieve.vector_topk(q, vectors(spark), 3)
    assert top.count() == 6
    got = retrieve.vector_only(q, vectors(spark), 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(8, 1.0), (6, 0.5), (4, 0.333333)]


def test_terms_all_or_any(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox red"), (2, 1, "red hen"), (3, 2, "fox")], "chunk_id long, kb_id long, content string")
    q = spark.createDataFrame([(1, "the red fox?", [1, 2]), (2, " ", [1])], "query_id long, question string, kb_ids array<bigint>")
    index = retrieve.postings(chunks)
    assert [(r["chunk_id"], r["tf"]) for r in retrieve.term_topk(q, index).collect()] == [(1, 3)]
    assert sorted(r["chunk_id"] for r in retrieve.term_topk(q, index, any_term=True).collect()) == [1, 2, 3]


def test_rerank_falls_back(spark):
    rows = ranked(spark, [(1, k, 1.0 / k, k) for k in range(1, 8)])
    good = rows.withColumn("rerank_score", F.col("chunk_id").cast("double"))
    assert [r["chunk_id"] for r in retrieve.rerank(good, 2, True).orderBy("rank").collect()] == [7, 6]
    broken = rows.withColumn("rerank_score", F.lit(None).cast("double"))
    assert [r["chunk_id"] for r in retrieve.rerank(broken, 2, True).orderBy("rank").collect()] == [1, 2]
    assert [r["chunk_id"] for r in retrieve.rerank(good, 2, False).orderBy("rank").collect()] == [1, 2]


def test_permissions_cut_knowledge_bases(spark):
    q = spark.createDataFrame([(1, 7, [3, 1, 2]), (2, 8, [1])], "query_id long, user_id long, kb_ids array<bigint>")
    seen = spark.createDataFrame([(7, 2), (7, 3)], "user_id long, kb_id long")
    got = {r["query_id"]: (r["kb_ids"], r["denied"]) for r in retrieve.allowed_only(q, seen).collect()}
    assert got == {1: ([3, 2], False), 2: ([], True)}


def test_sources(spark):
    chosen = spark.createDataFrame([(1, k, k * 10, 5, 1, "s", "text", 0.5) for k in (1, 2, 4)], "query_id long, rank int, chunk_id long, doc_id long, page_num int, section_title string, content string, score double")
    docs = spark.createDataFrame([(9, "f")], "doc_id long, file_name string")
    ask = lambda text: answer.sources(spark.createDataFrame([(1, text)], "query_id long, answer string"), chosen, docs)
    assert ask("nothing cited").count() == 3
    assert ask("[ref9]").count() == 0
    got = ask("[ref3] [ref1]").orderBy("source_no").collect()
    assert [(r["chunk_id"], r["doc_name"]) for r in got] == [(40, "未知文档"), (10, "未知文档")]


def test_ask_reports_what_it_does_not_find(spark):
    q = spark.createDataFrame([(1, "what is it here", [1], [1.0, 0.0], [0.0, 1.0]), (2, "nothing there", [9], [1.0, 0.0], [0.0, 1.0])], "query_id long, question string, kb_ids array<bigint>, embedding array<float>, hyde_embedding array<float>")
    chunks = spark.createDataFrame([(1, 5, 1, [1.0, 0.0], "it is here", 1, "s")], "chunk_id long, doc_id long, kb_id long, embedding array<float>, content string, page_num int, section_title string")
    docs = spark.createDataFrame([(5, "f.pdf")], "doc_id long, file_name string")
    got = {r["query_id"]: r for r in answer.ask(q, chunks, docs).collect()}
    assert not got[1]["not_found"] and "f.pdf" in got[1]["sources"]
    assert got[2]["not_found"] and got[2]["sources"] == "[]" and got[2]["answer"] == answer.NOT_FOUND


def test_cache_asks_the_model_once_for_each_text(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, text string")
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    _, cache = embed.embed_with_cache(texts.filter("text = 'b'"), empty, providers.hashing_embedder(8))
    assert cache.count() == 1 and embed.cache_misses(texts, cache).count() == 2
    full, after = embed.embed_with_cache(texts, cache, providers.hashing_embedder(8))
    rows = {r["id"]: r["embedding"] for r in full.collect()}
    assert rows[1] == rows[3] != rows[4] and after.count() == 3


def test_evaluation_golden(spark):
    q = spark.createDataFrame([(1, [7, 7]), (2, [8]), (3, [9])], "dataset_id long, expected_chunk_ids array<long>")
    shown = ranked(spark, [(1, 7, 1.0, 1), (2, 8, 1.0, 4), (2, 8, 1.0, 5), (3, 9, 1.0, 11)])
    results = evaluate.first_hits(q, shown).withColumn("faithfulness", F.when(F.col("dataset_id") == 1, 0.8))
    r = evaluate.run_report(results).first()
    assert (r["total"], r["hits"], round(r["hit_rate"], 4), round(r["mrr"], 6), r["faithfulness"]) == (3, 2, 0.6667, 0.416667, 0.8)


def test_history_counts_missing_faithfulness_as_zero(spark):
    results = spark.createDataFrame([(1, "v", True, 1, 0.8, 1), (1, "v", False, None, None, 2)], "dataset_id long, eval_version string, hit boolean, rank int, faithfulness double, eval_at long")
    row = evaluate.history(results, spark.createDataFrame([(1, 4)], "id long, kb_id long")).first()
    assert (row["kb_id"], row["total"], row["hits"], row["faithfulness"], row["mrr"]) == (4, 2, 1, 0.4, 0.5)
    assert evaluate.summary(evaluate.history(results, spark.createDataFrame([(1, 4)], "id long, kb_id long"))).first()["summary"] == "HitRate: 50.0% / MRR: 0.5000"


def test_expansion_keeps_the_question_and_three_rewrites(spark):
    q = spark.createDataFrame([(1, "q", " a \n\nb\nc\nd"), (2, "r", None)], "query_id long, question string, rewrites string")
    got = sorted(tuple(r) for r in retrieve.expanded(q).collect())
    assert got == [(1, 0, "q"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 0, "r")]


def test_samples_repeat(spark):
    rows = spark.range(1000).withColumnRenamed("id", "query_id")
    one, two = (sorted(r[0] for r in answer.sampled(rows).collect()) for _ in range(2))
    assert one == two and 120 < len(one) < 280


def test_answer_cache(spark):
    seen = spark.createDataFrame([("q", [2, 1], "yes", False), ("w", [1], "none", True)], "question string, kb_ids array<long>, answer string, not_found boolean")
    cache = embed.answers_to_cache(seen)
    asked = spark.createDataFrame([("q", [1, 2]), ("q", [1]), ("w", [1])], "question string, kb_ids array<long>")
    assert [r["answer"] for r in embed.answers_cached(asked, cache).orderBy("question", F.size("kb_ids").desc()).collect()] == ["yes", None, None]


def test_cache_entries_age(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:09:30")], "id long, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    assert [r["id"] for r in embed.live(rows, F.expr("TIMESTAMP_NTZ '2024-01-01 00:10:01'"), 600).collect()] == [2]


def test_failing_models_fall_back(spark):
    def broken(*_):
        raise OSError("no service")

    rows = spark.createDataFrame([("a",), ("b",)], "p string")
    assert {r[0] for r in rows.select(providers.answer(F.col("p"), broken, F.lit("else"), delay=0)).collect()} == {"else"}
    assert {r[0] for r in rows.select(providers.relevance(F.col("p"), F.col("p"), broken)).collect()} == {None}
    scores = rows.select(providers.relevance(F.lit("a b"), F.col("p"), providers.overlap_ranker)).collect()
    assert [r[0] for r in scores] == [0.5, 0.5]


def test_each_route_has_its_plan(spark):
    chunks = vectors(spark).withColumn("content", F.concat(F.lit("word "), F.col("chunk_id").cast("string")))
    rows = [(1, "SIMPLE"), (2, "STANDARD"), (3, "COMPLEX")]
    q = spark.createDataFrame([(k, r, "word", [1.0, 0.0], [0.0, 1.0], [1, 2]) for k, r in rows], "query_id long, route string, question string, embedding array<float>, hyde_embedding array<float>, kb_ids array<bigint>")
    got = retrieve.by_route(q, chunks, retrieve.postings(chunks)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 5, 2: 8, 3: 5}


def test_rank_by_places(spark):
    near = lambda *p: retrieve.nearness(list(p))
    assert near([1]) == pytest.approx(0.1 / 1.64493406685) and near([1, 9]) == pytest.approx(0.125 / 1.64493406685)
    assert near([1], [2]) == pytest.approx(0.0991, abs=2e-4) and near([1], [2]) > near([1], [8]) > near([1], [60]) > 0
    assert near([1, 5], [2]) > near([1], [2]) and near([1], [2], [3]) > near([1], [2])
    chunks = spark.createDataFrame([(1, 1, "red one two three fox"), (2, 1, "a red fox"), (3, 1, "red hen")], "chunk_id long, kb_id long, content string")
    q = spark.createDataFrame([(1, "red fox", [1])], "query_id long, question string, kb_ids array<bigint>")
    assert [r["chunk_id"] for r in retrieve.term_ranked(q, retrieve.stored_postings(chunks, positions=True)).orderBy("kb_rank").collect()] == [2, 1]
    assert [r["chunk_id"] for r in retrieve.term_ranked(q, retrieve.stored_postings(chunks, positions=True), 1).collect()] == [2]


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 1, [1.0]), (5, 1, [1.0, 0.0, 0.0]), (6, 1, [0.9, 0.1])]
    chunks = spark.createDataFrame(rows, "chunk_id long, kb_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0], [1]), ("b", [0.0, 0.0], [1]), ("c", None, [1])], "query_id string, embedding array<float>, kb_ids array<bigint>")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieve.vector_topk(q, chunks).orderBy("kb_rank").collect()] == [("a", 1), ("a", 6)]
    assert retrieve.vector_topk(q.limit(0), chunks).count() == 0 and retrieve.vector_topk(q, chunks.limit(0)).count() == 0


def test_nearest_equals_brute_force(spark):
    """Ties, repeated knowledge bases and many questions against plain sorting."""
    import random

    rng = random.Random(4)
    stored = [(k, k % 3, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(300)]
    asked = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)], [2, 0, 2]) for k in range(25)]
    found = retrieve.vector_topk(
        spark.createDataFrame(asked, "query_id long, embedding array<float>, kb_ids array<bigint>"), spark.createDataFrame(stored, "chunk_id long, kb_id long, embedding array<float>").repartition(5), 7
    )
    got = sorted((r["query_id"], r["kb_pos"], r["kb_rank"], r["chunk_id"], r["distance"]) for r in found.collect())
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for i, v, kbs in asked:
        for pos, kb in enumerate(kbs):
            rows = sorted((round(1 - sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 6), j) for j, home, w in stored if home == kb and norm(w) and norm(v))
            want += [(i, pos, n, j, d) for n, (d, j) in enumerate(rows[:7], 1)]
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and all(abs(g[4] - w[4]) < 2e-6 for g, w in zip(got, sorted(want), strict=True))


def test_inverted_file(spark):
    """Exact where all cells are looked into; nine of ten and more where an eighth is; every comparable vector has a cell."""
    import random

    from paperloom.operators import ivf

    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    point = lambda: [x + rng.gauss(0, 0.35) for x in rng.choice(middles)]
    chunks = spark.createDataFrame([(k, k % 2, point()) for k in range(3000)] + [(9000, 0, None), (9001, 0, [0.0] * 16), (9002, 1, [1.0])], "chunk_id long, kb_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(k, point(), [1, 0]) for k in range(40)], "query_id long, embedding array<float>, kb_ids array<bigint>")
    centres = ivf.fit(chunks, 32)
    stored = ivf.indexed(chunks, centres)
    assert stored.count() == 3000 and stored.select("cell").distinct().count() > 20
    rows = lambda df: {tuple(r) for r in df.select("query_id", "kb_id", "kb_pos", "kb_rank", "chunk_id").collect()}
    exact = rows(retrieve.vector_topk(asked, chunks, 10))
    assert rows(ivf.search(asked, stored, centres, 10)) == exact and len(exact) == 800
    probe = ivf.tuned(asked, stored, centres, 10)
    assert 1 <= probe <= 8
    near = {(r[0], r[1], r[4]) for r in rows(ivf.search(asked, stored, centres, 10, probe))}
    assert len(near & {(r[0], r[1], r[4]) for r in exact}) >= 0.9 * len(exact)
    none = ivf.fit(chunks.limit(0))
    assert ivf.search(asked, ivf.indexed(chunks.limit(0), none), none).count() == 0
