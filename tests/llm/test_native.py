"""Quality rules, shards and the archive against brute force."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib
from functools import partial

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import quality, sharding, warc

RNG = random.Random(5)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = collections.Counter(windows)
    covered = {p for k, w in enumerate(windows) if counts[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def measured(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.apply_policy(quality.measure(docs)).collect()
    return {r["doc_id"]: r for r in rows}


def check(spark, texts):
    got = measured(spark, texts)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r = got[k]
        want = expected(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_edge_texts(spark):
    check(spark, [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 3000, "😀 ñ \x0b漢字\x0c#|<", "l\nl\n\nl", "a b c d e f " * 40 + "tail"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n#é", max_size=80), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize("weak", ["CAST(i % 3 AS BIGINT)", "0L", "pmod(xxhash64(_words[i], _words[i + 4]), 7)"])
def test_repeats_are_exact_whatever_the_hash(spark, weak, monkeypatch):
    """Windows that differ but share a hash interleave by position."""
    monkeypatch.setattr(quality, "_repeat_words", partial(quality._repeat_words, window_hash=weak))
    check(spark, ["a b c d e f g h i a b c d e k l m n f g h i a", "a b c d e " * 9, " ".join(RNG.choice("ab") for _ in range(60)), "p q r s t u v", "p q r s t p q r s t"])


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string, _words string")
    assert quality.measure(docs).count() == 0 and quality.keep_good(docs).count() == 0
    one = spark.createDataFrame([(1, "some plain words that make up one line of ten or more words", "x", None)], "doc_id long, text string, n_words string, _words string")
    assert quality.keep_good(one).columns == one.columns and quality.keep_good(one).first()["n_words"] == "x"


def test_policies_and_ablations_read_the_ledger(spark):
    texts = ["one two", "$ " * 30, "a b c d e " * 5, "words " + " ".join(f"w{k}" for k in range(20))]
    ledger = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {p: sorted(r["doc_id"] for r in quality.apply_policy(ledger, p).filter("kept").collect()) for p in ("base", "default")}
    assert kept == {"base": [3], "default": [3]}
    table = {r["rule"]: r for r in quality.ablations(ledger).collect()}
    assert table["too_few_words"]["n_failed"] == 1 and table["too_few_words"]["n_failed_alone"] == 1
    assert table["repeated_windows"]["n_kept_without"] == 2


def test_the_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality.apply_policy(quality.measure(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [0, 1, 5, 400])
def test_shards(spark, rows):
    texts = [None if k % 50 == 7 else "" if k % 50 == 9 else "é" * (k * 37 % 101) for k in range(rows)]
    if rows == 400:
        texts[200] = "x" * 9000
    docs = spark.createDataFrame([(k * 3, t, "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, size string, shard int")
    got = sharding.assign_shards(docs, 16).orderBy("doc_id").collect()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in got] == sizes and [r["text_crc32"] for r in got] == [zlib.crc32((t or "").encode()) for t in texts]
    shards = [r["shard"] for r in got]
    assert shards == sorted(shards)
    seen = collections.Counter()
    for r in got:
        assert r["slot"] == seen[r["shard"]]
        seen[r["shard"]] += 1
    if rows == 400:
        per = collections.Counter()
        for r in got:
            per[r["shard"]] += r["size"]
        assert all(abs(per[s] - sum(sizes) / 16) <= max(sizes) for s in range(16))


def test_shards_of_one_id(spark):
    docs = spark.createDataFrame([(7, f"{k:04d}") for k in range(64)] + [(None, "lost")], "doc_id long, text string")
    got = sharding.assign_shards(docs, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(16)]


def test_shards_of_equal_rows(spark):
    docs = spark.createDataFrame([(7, "same")] * 64, "doc_id long, text string")
    got = sharding.assign_shards(docs, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(16)]


def test_written_shards(spark, tmp_path):
    rows = [(1, "a", "x", 5, 6), (1, "b", "y", 5, 6), (1, "b", "z", 5, 6), (2, None, "n", 5, 6), (None, "lost", "l", 5, 6)] + [(k, "t" * (k * 7 % 50), "w", 0, 0) for k in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, note string, shard int, `row` int").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == [*docs.columns, "shard_number"]
    assert sorted(tuple(r)[:5] for r in back.drop("shard_number").fillna("?").collect()) == sorted(r if r[1] is not None else (*r[:1], "?", *r[2:]) for r in rows if r[0] is not None)
    want = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 4).collect()}
    for k in range(4):
        files = list((tmp_path / "s" / f"shard_number={k}").glob("*.parquet"))
        assert len(files) == 1
        own = [(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(str(files[0])).collect()]
        slots = [want[x][1] for x in own]
        assert {want[x][0] for x in own} == {k} and (slots == sorted(slots))
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4)


def test_archive_round_trip(spark, tmp_path):
    payloads = ["same", "other", "same", None, "", "same", "é\r\n\r\nWARC/1.1", "x" * 300_000]
    rows = [(k, None if k == 4 else f"http://h/{k}\r\nX: y", p, "clash") for k, p in enumerate(payloads)]
    pages = spark.createDataFrame(rows + [(None, "u", "no id", "c")], "page_id long, url string, html string, payload string")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 5
    records = warc.read_archive(spark, str(tmp_path / "a"))
    got = {r["page_id"]: r for r in warc.describe(records).collect()}
    for k, p in enumerate(payloads):
        data = (p or "").encode()
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        head = min(j for j, q in enumerate(payloads) if (q or "") == (p or ""))
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if head == k else ("revisit", head))
    raw = {r["page_id"]: bytes(r["b"]) for r in records.select("page_id", warc.record_bytes().alias("b")).collect()}
    head, _, rest = raw[6].partition(b"\r\n\r\n")
    assert rest == payloads[6].encode() + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: response") and b"\r\nX: y" not in raw[0]
    assert raw[2].endswith(b"\r\n\r\n\r\n\r\n") and b"WARC-Refers-To" in raw[2]


def test_archive_of_nothing_and_small_payloads(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(none, str(tmp_path / "n"))
    assert warc.read_archive(spark, str(tmp_path / "n")).count() == 0
    two = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(two, str(tmp_path / "t"), least_bytes=4)
    assert {r["record_type"] for r in warc.describe(warc.read_archive(spark, str(tmp_path / "t"))).collect()} == {"response"}


def test_a_changed_payload_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"abd"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="does not match"):
        warc.describe(warc.read_archive(spark, str(tmp_path / "b"))).collect()


def test_a_repeated_id_with_another_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "v" * 70_000, "b"), (2, "w", "b")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.describe(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got) == [(1, 1, "response", 0), (1, 1, "response", 0), (2, 1, "revisit", 1)]


def test_files_round_trip(spark, tmp_path):
    payloads = ["same", "same", "é\r\n\r\nWARC/1.1\r\n\r\n", "", "x" * 100_000]
    pages = spark.createDataFrame([(k, f"http://h/{k}/é", p) for k, p in enumerate(payloads)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    raw = {bytes(r["b"]) for r in records.select(warc.record_bytes().alias("b")).collect()}
    for kind in ("none", "gzip"):
        warc.write_warc(records, str(tmp_path / kind), kind)
        back = warc.read_warc(spark, str(tmp_path / kind))
        assert {bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n" for r in back.collect()} == raw


def test_given_headers_are_kept_byte_for_byte(spark, tmp_path):
    heads = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length:  5 \r\n\r\n", b"WARC/1.1\r\nX-Odd: \xff\xfe\r\nContent-Length: 5\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"]
    blocks = [b"ab\x00\xffe", b"ab\x00\xffe", b""]
    data = b"".join(h + b + b"\r\n\r\n" for h, b in zip(heads, blocks, strict=True))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/plain.warc").write_bytes(data)
    (tmp_path / "in/members.warc.gz").write_bytes(b"".join(gzip.compress(h + b + b"\r\n\r\n") for h, b in zip(heads, blocks, strict=True)))
    warc.store_records(warc.read_warc(spark, str(tmp_path / "in")), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    rows = warc.read_archive(spark, str(tmp_path / "a"), "file string, place long").orderBy("file", "place").collect()
    for name in ("plain.warc", "members.warc.gz"):
        own = [r for r in rows if r["file"].endswith(name)]
        assert b"".join(bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n" for r in own) == data
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_of(data[: len(heads[0]) + 2]))


def test_filters_on_the_ledger_plan_fast(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "plain words that make up one line of more than ten words in all")], "doc_id long, text string")
    ledger = quality.apply_policy(quality.measure(docs))
    assert [r["doc_id"] for r in ledger.filter("kept AND n_repeat_words = 0").collect()] == [2]
    assert ledger.filter("NOT kept AND n_dup_lines = 0").select("doc_id").count() == 1
