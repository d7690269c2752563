"""Changes, uploads, index runs, chats, evaluation and counters."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.operators import answer, embed, evaluate, index, retrieve, steps
from paperloom.operators import library as L
from paperloom.sources.schema import schema
from paperloom.sources.store import Store
from paperloom.streaming import ingest, meter



def now():
    return F.expr("TIMESTAMP_NTZ '2024-05-01 10:00:00'")


FILES = "id long, kb_id long, file_name string, file_size long, uploaded_by long"


def rows_of(spark, table, rows, columns):
    """Rows of a stored table given by some of its columns."""
    have = spark.createDataFrame(rows, columns)
    return have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def documents(spark):
    return rows_of(
        spark, "document", [(1, 5, "a.pdf", "kb/5/x-a.pdf", "DONE", 1, False), (2, 5, "b.pdf", "kb/5/y-b.pdf", "FAILED", 3, False), (3, 6, "c.pdf", "kb/6/z", "DONE", 1, True)],
        "id long, kb_id long, file_name string, path string, status string, version int, is_deleted boolean",
    )


def test_uploads(spark):
    files = spark.createDataFrame([(10, 5, "New.PDF", 7, 1), (11, 5, "notes.txt", 8, 1)], FILES).withColumn("venue", F.lit("V"))
    docs, tasks, rejected = L.uploaded(files, now())
    one = docs.first()
    assert docs.count() == 1 and one["status"] == "PENDING" and one["path"].startswith("kb/5/") and one["path"].endswith("-New.PDF")
    assert [(r["doc_id"], r["status"], r["retry_count"]) for r in tasks.collect()] == [(10, "PENDING", 0)]
    assert "Only PDF is supported" in rejected.first()["error_msg"]
    paper = L.uploaded_papers(files, now())[2].first()
    assert (paper["title"], paper["venue"], paper["doc_id"], paper["reading_status"]) == ("New", "V", 10, "UNREAD")


def test_replaced_and_deleted_documents(spark):
    docs = documents(spark)
    out, tasks, paths = L.replaced(docs, spark.createDataFrame([(2, "b2.pdf", 9), (3, "c2.pdf", 9), (1, "no.txt", 1)], "id long, file_name string, file_size long"), now())
    got = {r["id"]: r for r in out.collect()}
    assert (got[2]["version"], got[2]["status"], got[2]["file_name"]) == (4, "PENDING", "b2.pdf") and got[2]["path"] != "kb/5/y-b.pdf"
    assert (got[1]["version"], got[3]["version"], got[3]["file_name"]) == (1, 1, "c.pdf")
    assert [r["doc_id"] for r in tasks.collect()] == [2] and [r["path"] for r in paths.collect()] == ["kb/5/y-b.pdf"]
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk_id long, doc_id long")
    after, left, paths = L.deleted_documents(docs, chunks, spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in L.present(after).collect()] == [2] and [r["chunk_id"] for r in left.collect()] == [3] and paths.first()["path"] == "kb/5/x-a.pdf"


def test_an_index_run(spark):
    docs = rows_of(spark, "document", [(1, 5, "a.pdf", "PENDING", 2), (2, 5, "b.pdf", "PENDING", 1), (3, 5, "c.pdf", "DONE", 1)], "id long, kb_id long, file_name string, status string, version int")
    tasks = rows_of(spark, "index_task", [(7, 1, "PENDING"), (8, 2, "PENDING"), (9, 3, "DONE")], "id long, doc_id long, status string")
    pages = spark.createDataFrame([(1, 1, "1. Introduction\nwords that make up the first page of it"), (2, 1, "  "), (3, 1, "not in work, though it has words enough")], "doc_id long, page_num int, text string")
    docs, tasks = index.started(docs, tasks, now())
    assert sorted(r["status"] for r in tasks.collect()) == ["DONE", "RUNNING", "RUNNING"]
    papers = spark.createDataFrame([(1, "On Words")], "doc_id long, title string")
    chunks = index.indexed(docs, pages, now(), papers)
    assert sorted(r["content_type"] for r in chunks.collect()) == ["PAPER_METADATA", "TEXT"]
    assert all("Paper title: On Words" in r["embedding_text"] and r["doc_version"] == 2 for r in chunks.collect())
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    full, cache = index.embedded(chunks, empty, providers.hashing_embedder(8))
    assert cache.count() == 2 and full.filter("size(embedding) = 8").count() == 2
    old = full.withColumn("doc_version", F.lit(1))
    assert {r["doc_version"] for r in index.stored(old, full).collect()} == {2}
    docs, tasks = index.finished(docs, tasks, chunks, now())
    got = {r["id"]: r for r in docs.collect()}
    assert (got[1]["status"], got[1]["chunk_count"], got[2]["status"], got[3]["status"]) == ("DONE", 2, "FAILED", "DONE") and "OCR" in got[2]["error_msg"]
    assert {r["id"]: r["status"] for r in tasks.collect()} == {7: "DONE", 8: "FAILED", 9: "DONE"}


def library(spark):
    chunks = spark.createDataFrame(
        [(k, 5, 1, [1.0, k / 9.0], f"the red walrus number {k} sings", 1, None if k else "s") for k in range(30)],
        "chunk_id long, doc_id long, kb_id long, embedding array<float>, content string, page_num int, section_title string",
    )
    return chunks, spark.createDataFrame([(5, "f.pdf")], "doc_id long, file_name string")


def asked(spark, *texts):
    rows = [(k, t, [1], [1.0, 0.1], [0.1, 1.0], "s1") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, question string, kb_ids array<bigint>, embedding array<float>, hyde_embedding array<float>, session_id string")


def test_a_chat_turn_reranks_and_is_saved(spark):
    chunks, docs = library(spark)
    likes = lambda qs, ts: [float("number 17 " in t) + float("number 15 " in t) / 2 for t in ts]
    models = answer.Models(generate=lambda ps: ["yes [ref1]" for _ in ps], rank=likes)
    answers, messages = answer.chat(asked(spark, "walrus"), chunks, docs, now(), models=models)
    row = answers.first()
    assert row["route"] == "COMPLEX" and "number 17 sings" in row["sources"] and row["sources"].count("chunk_id") == 1
    said = messages.orderBy("position").collect()
    assert [(m["role"], m["content"]) for m in said] == [("user", "walrus"), ("assistant", "yes [ref1]")] and said[1]["sources"] == row["sources"]
    chats = rows_of(spark, "chat_session", [("s1", 1, 4, None), ("s2", 1, 2, "kept")], "id string, user_id long, message_count int, title string")
    after = {r["id"]: (r["message_count"], r["title"]) for r in L.after_turns(chats, messages).collect()}
    assert after == {"s1": (6, "walrus"), "s2": (2, "kept")}


def test_cache_probe_and_check(spark):
    chunks, docs = library(spark)
    calls = answer.Models(generate=lambda ps: ["fresh [ref1]" for _ in ps], normalise=lambda ps: ['" same  thing "' for _ in ps], check=lambda ps: ["忠实性分数：8\n是否忠实：否\n理由：x" for _ in ps])
    first = answer.ask(asked(spark, *[f"what sings {k}" for k in range(40)]), chunks, docs, models=calls)
    rows = first.collect()
    assert {r["cache_question"] for r in rows} == {"same thing"} and not any(r["cached"] for r in rows)
    checks = [r["faithfulness"] for r in rows if r["faithfulness"]]
    assert 0 < len(checks) < 40 and (checks[0]["score"], checks[0]["faithful"]) == (0.8, False)
    cache = spark.createDataFrame(embed.answers_to_cache(first).dropDuplicates(["cache_key"]).collect())
    again = answer.ask(asked(spark, "other words"), chunks, docs, models=calls, cache=cache.withColumn("answer", F.lit("kept")))
    row = again.first()
    assert row["cached"] and row["answer"] == "kept" and row["sources"] != "[]"
    assert embed.answers_to_cache(again).count() == 0


def test_an_index_given_is_the_one_used(spark):
    chunks, docs = library(spark)
    index_ = retrieve.postings(chunks)
    one, two = (sorted(map(str, answer.ask(asked(spark, "which is the red walrus number"), chunks, docs, index=i).collect())) for i in (None, index_))
    assert one == two


def test_model_steps_and_their_fallbacks(spark):
    def broken(*_):
        raise OSError("no service")

    q = spark.createDataFrame([("“ what  is it ”",), (" ",)], "question string")
    text = F.col("question")
    slow = providers.TRIES
    providers_delay = providers.DELAY
    try:
        got = q.select(steps.normalized(text).alias("a"), steps.normalized(text, lambda ps: [" 'x  y' "] * len(ps)).alias("b"), steps.routed(text).alias("c"), steps.routed(text, lambda ps: ["complex!"] * len(ps)).alias("d"), steps.routed(text, enabled=False).alias("e")).collect()
    finally:
        assert (slow, providers_delay) == (3, 1.0)
    assert [tuple(r) for r in got] == [("what is it", "x y", "SIMPLE", "COMPLEX", "STANDARD"), ("", "", "STANDARD", "STANDARD", "STANDARD")]
    one = q.limit(1)
    fell = one.select(steps.normalized(text, broken).alias("a"), steps.hypothesis(text, broken).alias("b"), steps.rewrites(text, broken).alias("c"), steps.checked(text, text, text, broken).alias("d"), steps.routed(text, broken).alias("e")).first()
    assert fell["a"] == "“ what  is it ”" and fell["b"] == "“ what  is it ”" and fell["c"] is None and fell["e"] == "SIMPLE"
    assert (fell["d"]["score"], fell["d"]["faithful"]) == (0.5, True)
    told = one.select(steps.hypothesis(text, providers.echo)).first()[0]
    assert told.endswith("问题：“ what  is it ”\n")


def test_one_bad_row_spoils_no_other():
    def picky(rows):
        if "bad" in rows:
            raise ValueError
        return [r.upper() for r in rows]

    assert providers.patient(picky, ["a", "bad", "b"], 2, 0) == ["A", None, "B"]
    calls = []
    assert providers.in_batches(lambda r: calls.append(len(r)) or r, list("abcdefghijkl"), 5, 1, 0) == list("abcdefghijkl") and calls == [5, 5, 2]
    with pytest.raises(Exception):  # noqa: B017  the pool's own error
        providers.timed(lambda q, t: __import__("time").sleep(1), 0.05)([], [])
    response = {"output": {"results": [{"index": 2, "relevance_score": 0.5}, {"index": 0, "relevance_score": 1}]}}
    assert providers.rerank_scores(response, 3) == [1.0, None, 0.5]
    assert providers.rerank_request("m", "q", ("a",), 5)["parameters"]["top_n"] == 5


def test_events_of_an_answer(spark):
    answers = spark.createDataFrame([(1, "a long answer of some words", "[]"), (2, "", "[1]")], "query_id long, answer string, sources string")
    told = answer.events(answers, 5)
    assert [r["event"] for r in told.filter("query_id = 1").orderBy("n").collect()] == ["status", *["token"] * 6, "done"]
    assert {r["query_id"]: r["answer"] for r in answer.told_in_full(told).collect()} == {1: "a long answer of some words", 2: ""}


def test_answers_stream(spark, tmp_path):
    spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, question string").write.parquet(str(tmp_path / "in"))
    said = lambda batch: batch.select("query_id", F.upper("question").alias("answer"), F.lit("[]").alias("sources"))
    arriving = spark.readStream.schema("query_id long, question string").parquet(str(tmp_path / "in"))
    ingest.answer_stream(arriving, said, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert {r["answer"] for r in answer.told_in_full(spark.read.parquet(str(tmp_path / "out"))).collect()} == {"Q ONE", "Q TWO"}


def test_evaluation_run(spark):
    chunks, docs = library(spark)
    sets = spark.createDataFrame(
        [(1, "red walrus number 3", 1, [1.0, 0.3], [1.0, 0.3], [3, 3]), (2, "nothing", 1, [1.0, 3.0], [1.0, 3.0], [900]), (3, "none expected", 1, [1.0, 0.0], [1.0, 0.0], None)],
        "id long, question string, kb_id long, embedding array<float>, hyde_embedding array<float>, expected_chunk_ids array<long>",
    )
    answers = spark.createDataFrame([(1, "it is 3")], "query_id long, answer string")
    out = evaluate.run(sets, chunks, retrieve.postings(chunks), "v1", now(), answers=answers, check=lambda ps: ["忠实性分数：9" for _ in ps])
    got = {r["dataset_id"]: r for r in out.collect()}
    assert got[1]["hit"] and got[1]["rank"] >= 1 and got[1]["faithfulness"] == 0.9 and not got[2]["hit"] and not got[3]["hit"]
    report = evaluate.run_report(out).first()
    assert report["total"] == 3 and report["hits"] == 1 and report["faithfulness"] == 0.9


def test_hour_is_compacted_once(spark):
    hours = spark.createDataFrame([(1, "a", "2024-05-01 09:00:00", 5), (1, "b", "2024-05-01 09:00:00", 6), (1, "a", "2024-05-01 10:00:00", 7)], "user_id long, field string, h string, tokens long")
    hours = hours.withColumn("hour", F.col("h").cast("timestamp_ntz")).drop("h")
    days = spark.createDataFrame([(1, "2024-05-01", 100)], "user_id long, d string, tokens long").select("user_id", F.col("d").cast("timestamp_ntz").alias("day"), "tokens")
    done = spark.createDataFrame([], "user_id long, hour timestamp_ntz")
    for _ in range(2):
        days, done = meter.compacted(hours, days, done, F.expr("TIMESTAMP_NTZ '2024-05-01 09:30:00'"))
        assert [r["tokens"] for r in days.collect()] == [111] and done.count() == 1


def test_counters(spark):
    seen = Observation("tokens")
    rows = meter.counted(spark.createDataFrame([(1, 5), (2, None)], "id long, n long"), seen, generation=F.col("n"))
    assert rows.count() == 2 and seen.get == {"rows": 2, "generation": 5}


def test_lists_and_rights(spark):
    note = rows_of(spark, "paper_note", [(1, 9, "a", False), (2, 9, "b", True), (3, 8, "c", False)], "id long, paper_id long, content string, is_deleted boolean")
    assert [r["id"] for r in L.notes(note, 9).collect()] == [1] and len(L.view(note, "paper_note").columns) == 10
    assert [len(L.view(rows_of(spark, t, [(1, False)], "id long, is_deleted boolean"), t).columns) for t in ("paper", "paper_relation", "knowledge_base")] == [20, 7, 8]
    ask = spark.createDataFrame([(5, 1), (6, 1), (6, 3)], "kb_id long, doc_id long")
    assert sorted((r["kb_id"], r["doc_id"], r["allowed"]) for r in L.belongs(ask, documents(spark)).collect()) == [(5, 1, True), (6, 1, False), (6, 3, False)]
    chats = rows_of(spark, "chat_session", [("s", 1, False), ("t", 2, False)], "id string, user_id long, is_deleted boolean")
    messages = spark.createDataFrame([("s", 1, 1), ("t", 2, 1), ("s", 3, 0)], "session_id string, id long, created_at long")
    assert [r["id"] for r in L.messages_for(messages, chats, 1).orderBy("position").collect()] == [3, 1] and L.messages_for(messages, chats, 7, "admin").count() == 3
    kbs = rows_of(spark, "knowledge_base", [(4, True), (6, True)], "id long, is_deleted boolean")
    made = L.with_default(kbs, "Default", 1)
    assert L.default_kb(made).first()["id"] == 7 and L.with_default(made, "Default", 1).count() == 3


def test_sessions_are_found_or_made(spark):
    chats = rows_of(spark, "chat_session", [("s", 1, False), ("t", 2, False), ("u", 1, True)], "id string, user_id long, is_deleted boolean")
    ask = spark.createDataFrame([(1, 1, "user", "s"), (2, 1, "user", "t"), (3, 9, "admin", "t"), (4, 1, "user", None), (5, 1, "user", "u")], "ask_id long, user_id long, role string, session_id string").withColumn("kb_ids", F.array(F.lit(1)))
    out, new = L.sessions_for(ask, chats, now())
    got = {r["ask_id"]: (r["session_id"], r["is_new"]) for r in out.collect()}
    assert got[1] == ("s", False) and got[3] == ("t", False) and all(got[k][1] for k in (2, 4, 5)) and len({got[k][0] for k in (2, 4, 5)}) == 3
    assert new.count() == 3 and sorted(map(str, new.collect())) == sorted(map(str, L.sessions_for(ask, chats, now())[1].collect()))


def test_relations_need_their_source(spark):
    edges = rows_of(spark, "paper_relation", [(1, 10, 11, False), (2, 12, 11, False)], "id long, source_paper_id long, target_paper_id long, is_deleted boolean")
    after, refused = L.without_relations(edges, spark.createDataFrame([(1, 10), (2, 10)], "id long, source_paper_id long"))
    assert [r["id"] for r in L.present(after).collect()] == [2] and [r["id"] for r in refused.collect()] == [2]


def test_a_table_survives_a_crash_at_any_point(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    grants = lambda n: spark.createDataFrame([(k, k) for k in range(n)], "id long, kb_id long")
    assert store.read("permission").count() == 0
    store.replace("permission", grants(3))
    store.append("permission", grants(2))
    assert store.read("permission").count() == 5

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(Store, "_put", crash)
        with pytest.raises(OSError):
            store.replace("permission", grants(9))
    assert store.read("permission").count() == 5
    store.replace("permission", L.without_rows(store.read("permission"), spark.createDataFrame([(0,)], "id long")))
    assert store.read("permission").count() == 3
    store.clean("permission")
    assert store.read("permission").count() == 3 and len(list((tmp_path / "permission").glob("snapshot-*"))) == 1


def test_stored_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    path = store.put_file(3, "a b.pdf", b"\x00\xff1")
    assert store.put_file(3, "a b.pdf", b"\x00\xff2") == path
    want = spark.range(1).select(__import__("paperloom.sources.store", fromlist=["file_path"]).file_path(F.lit(3), F.lit("a b.pdf"))).first()[0]
    assert path == want and [bytes(r["content"]) for r in store.files("*.pdf").collect()] == [b"\x00\xff2"]
    assert store.delete_file(path) and not store.delete_file(path)
