import pytest
from pyspark.sql import functions as F

from paperloom.operators import library as L
from paperloom.operators import parse
from paperloom.sources.store import Store
from paperloom.streaming import ingest, meter


def test_accessible(spark):
    kbs = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True), (4, False, False)], "id long, is_public boolean, is_deleted boolean")
    grants = spark.createDataFrame([(1, "DEPARTMENT", "d", "READ"), (1, "USER", "7", "WRITE"), (3, "USER", "7", "ADMIN"), (4, "USER", "8", "READ")], "kb_id long, subject_type string, subject_id string, permission string")
    got = lambda *a: sorted((r["kb_id"], r["permission"]) for r in L.accessible(kbs, grants, *a).collect())
    assert got(7, "d") == [(1, "WRITE"), (2, "READ")]
    assert got(1, None, "admin") == [(1, "ADMIN"), (2, "ADMIN"), (4, "ADMIN")]


def test_bad_choice_is_an_error_or_a_row_apart(spark):
    rows = spark.createDataFrame([(1, " read "), (2, None), (3, "odd")], "id long, s string")
    good, bad = L.valid(rows, "s", "reading_status")
    assert sorted(r[0] for r in good.select(L.choice(F.col("s"), "reading_status", "UNREAD")).collect()) == ["READ", "UNREAD"]
    assert [r["id"] for r in bad.collect()] == [3]
    with pytest.raises(Exception, match="unknown reading_status"):
        rows.select(L.choice(F.col("s"), "reading_status")).collect()


def test_history_of_thirteen(spark):
    rows = spark.createDataFrame([("s", k, k) for k in range(13)], "session_id string, id long, created_at long")
    got = L.history(rows).orderBy("position").collect()
    assert [r["id"] for r in got] == list(range(3, 13)) and got[0]["position"] == 1


def test_meter_keeps_the_sum(spark):
    rows = [(1, f"2024-01-{d:02d} {h:02d}:10:00", "embedding", d * 100 + h) for d in (1, 20, 23, 24, 30) for h in (0, 11, 13)]
    events = spark.createDataFrame(rows, "user_id long, ts string, field string, tokens long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    at = F.expr("TIMESTAMP_NTZ '2024-01-31 12:00:00'")
    row = meter.stats(events, at).first()
    total = sum(r[3] for r in rows)
    assert row["embedding_7d"] + row["days_7_to_30"] + row["archived"] == total
    twice = meter.stats(events, at, compat=True).first()
    assert twice["days_7_to_30"] > row["days_7_to_30"]
    assert meter.daily(meter.hourly(events)).agg(F.sum("tokens")).first()[0] == total


def test_cost(spark):
    assert spark.range(1).select(meter.cost(F.lit(1000), F.lit(2000), F.lit(500))).first()[0] == 0.0033


def test_hourly_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(u, f"2024-01-01 0{h}:1{u}:00", "f", h + u) for u in (1, 2) for h in range(5)], "user_id long, ts string, field string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = meter.hourly_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda rows: sorted((r["user_id"], r["field"], r["hour"], r["tokens"]) for r in rows)
    assert key(spark.table("hours").collect()) == key(meter.hourly(events).collect())


def test_ingest_stores_each_text_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k} with enough words to keep") for k in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("paper").count() == 0
    store.append("paper", spark.createDataFrame([(1, "a")], "id long, title string"))
    store.append("paper", spark.createDataFrame([(2, "b")], "id long, title string"))
    store.replace("paper", store.read("paper").filter("id = 2"))
    assert [r["title"] for r in store.read("paper").collect()] == ["b"]
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "x.pdf").write_bytes(b"%PDF")
    assert store.files().select("content").first()["content"] == b"%PDF"
    assert store.delete_file("kb/x.pdf") and not store.delete_file("kb/x.pdf")


def test_other_types_fail_as_data(spark):
    rows = parse.by_type(spark.createDataFrame([("a.PDF",), ("test.txt",), (None,)], "file_name string")).collect()
    assert [r["success"] for r in rows] == [True, False, False] and "Only PDF is supported" in rows[1]["error_msg"]


def test_changes(spark):
    tasks = spark.createDataFrame([(1, "FAILED", 0, 3), (2, "FAILED", 3, 3), (3, "DONE", 0, 3)], "id long, status string, retry_count int, max_retry int")
    assert [(r["id"], r["retry_count"], r["delay_seconds"]) for r in L.retried(tasks).collect()] == [(1, 1, 1)]
    kbs, grants = L.created(spark.createDataFrame([], "id long, created_by long"), spark.createDataFrame([], "kb_id long, subject_type string, subject_id string, permission string"), spark.createDataFrame([(5, 9)], "id long, created_by long"))
    assert kbs.count() == 1 and tuple(grants.first()) == (5, "USER", "9", "ADMIN")
