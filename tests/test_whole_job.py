"""Registered queries do the whole job that their operators can do."""

import __spark_entry__ as entry


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_entry_finds_what_only_the_text_has(spark, tmp_path, monkeypatch):
    vectors = [(k, [1.0, k / 1000.0], 0) for k in range(30)]
    docs = [(0, "crimson walrus lantern"), (1, "crimson walrus"), (700, "one crimson lantern, one walrus")]
    write(spark, tmp_path, embeddings=(vectors, "vec_id long, embedding array<float>, label int"), documents=(docs, "doc_id long, text string"))
    monkeypatch.setattr(entry, "SMALL", str(tmp_path))
    assert 700 in {r["chunk_id"] for r in entry.entry(spark).collect()}
    found = {r["chunk_id"] for r in entry.queries()["hyde_fusion"](spark, str(tmp_path)).collect()}
    assert 700 in found and 1 in found


def test_full_text_asks_with_every_word(spark, tmp_path):
    passage = "crimson walrus lantern beside seven frozen harbours"
    docs = [(4, passage), (8, "crimson walrus lantern and nothing else"), (12, "frozen harbours, frozen harbours")]
    write(spark, tmp_path, benchmark=([(1, passage)], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    found = {n: {r["chunk_id"]: r["tf"] for r in entry.queries()[n](spark, str(tmp_path)).collect()} for n in ("fulltext_topk", "fulltext_any_term")}
    assert found == {"fulltext_topk": {4: 7}, "fulltext_any_term": {4: 7, 8: 3, 12: 4}}


def test_ask_batch_asks_whole_texts_by_every_route(spark, tmp_path):
    texts = ["red walrus", "which walrus has the crimson lantern", "crimson walrus lantern " * 9]
    turns = [(k, t, "user", text) for k in range(2) for t, text in enumerate(texts)]
    write(
        spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"),
        embeddings=([(k, [1.0, k / 9.0], 0) for k in range(4)], "vec_id long, embedding array<float>, label int"),
        documents=([(k, f"the red walrus {k} has a crimson lantern", "en", "s") for k in range(4)], "doc_id long, text string, lang string, source string"),
    )
    rows = {r["query_id"]: r for r in entry.queries()["ask_batch"](spark, str(tmp_path)).collect()}
    assert {k: r["question"] for k, r in rows.items()} == {100 * k + t: text for k, t, _, text in turns}
    assert [rows[k]["route"] for k in (0, 1, 2)] == ["SIMPLE", "STANDARD", "COMPLEX"]


def test_codec_multiplies_as_floats_and_rounds_halves_away_from_zero(spark, tmp_path):
    # 0.1335 as a float is less than 0.1335, but a thousand times it as a float is 133.5
    write(spark, tmp_path, embeddings=([(1, [-0.1335, 0.1335, 0.0005, -0.0025, 0.0])], "vec_id long, embedding array<float>"))
    found = entry.queries()["vector_codec"](spark, str(tmp_path)).first()
    assert (found["literal"], found["back"]) == ("[-134,134,1,-3,0]", "-134,134,1,-3,0")
