import time

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import chunk, parse

PAGES = "doc_id long, page_num int, text string, section_title string, section_type string, content_type string"
TABLE = "[TABLE_CAPTION]Table 1: ablation[/TABLE_CAPTION]\n[TABLE]\n| Method | MRR |\n| --- | --- |\n| A* | 0.5 |\n[/TABLE]"


def test_windows_golden():
    text = "这是一段测试文本。" * 200
    got = chunk.windows(text)
    assert [(a, b) for a, b, _ in got] == [(0, 513), (449, 954), (890, 1395), (1331, 1800)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1.\n。", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_windows_cover_and_advance(text, size, overlap):
    got = chunk.windows(text, size, overlap)
    starts = [a for a, _, _ in got]
    assert starts == sorted(set(starts))
    assert all(b - a <= size + 2 for a, b, _ in got)
    if text.strip():
        assert got and all(c == c.strip() for _, _, c in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\t1.\n 。?)", max_size=700), st.integers(130, 300), st.integers(0, 80))
def test_windows_follow_their_specification(text, size, overlap):
    """Every end and start is checked against the rules one by one, on the text itself."""
    spaces = "\t\n "
    spans = [(a, b) for a, b, _ in chunk.windows("x" + text, size, overlap)]
    text = "x" + text
    for start, end in spans:
        full = start + size
        if full >= len(text):
            assert end == len(text)
            continue
        low = max(start + max(1, overlap), full - max(120, 2 * overlap))
        by_mark = [[k + len(m) for k in range(low, full + 1) if text.startswith(m, k)] for m in chunk.SEPARATORS]
        beside = [k for k in range(low, full + 1) if text[k - 1] in spaces or text[k] in spaces]
        assert end == next((m[-1] for m in by_mark if m), beside[-1] if beside else full)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        wanted = end - overlap
        torn = text[wanted - 1] not in ".?)。" + spaces and text[wanted] not in ".?)。" + spaces
        near = [k for k in range(wanted, min(len(text), wanted + 40)) if text[k] in spaces]
        back = [k for k in range(wanted - 40, wanted) if text[k] in spaces]
        assert start == (wanted if not torn else near[0] + 1 if near else back[-1] + 1 if back else wanted) or not text[wanted:start].strip()


def test_long_windows_take_linear_time():
    start = time.process_time()
    assert len(chunk.windows("ab" * 1_000_000)) > 4000
    assert time.process_time() - start < 10
    assert [p[2] for p in chunk.windows("one " + "x" * 30, 5, 0)][0] == "one"


def test_sliding_chunks_number_before_dropping(spark):
    pages = spark.createDataFrame([(1, 1, "short", None, None, None), (1, 2, "x" * 30, None, None, None)], PAGES)
    rows = chunk.sliding_chunks(pages).collect()
    assert [(r["chunk_index"], r["content"]) for r in rows] == [(1, "x" * 30)]


def test_sliding_token_estimates(spark):
    pages = spark.createDataFrame([(1, 1, "这是一段测试文本。" * 200, None, None, None)], PAGES)
    assert [r["token_count"] for r in chunk.sliding_chunks(pages).orderBy("chunk_index").collect()] == [701, 689, 689, 639]


def test_structured_chunks(spark):
    body = "plain words of a method section"
    pages = spark.createDataFrame(
        [
            (1, 1, body, "Method", "METHOD", "TEXT"),
            (1, 2, f"second page of it\n{TABLE}\nafter the table comes more", None, None, "MIXED"),
            (1, 3, "results are given here in full", "Results", "RESULTS", "TEXT"),
        ],
        PAGES,
    )
    rows = chunk.structured_chunks(pages).orderBy("chunk_index").collect()
    assert [r["content_type"] for r in rows] == ["TEXT", "TABLE", "TEXT", "TEXT"]
    assert rows[0]["content"] == f"{body}\n\nsecond page of it" and rows[0]["page_num"] == 1
    assert rows[1]["raw_content"].startswith("| Method |") and rows[1]["table_caption"] == "Table 1: ablation" and rows[1]["page_num"] == 2
    assert "Metrics mentioned: MRR." in rows[1]["content"] and "Methods or variants mentioned: A." in rows[1]["content"]
    assert "ablation study" in rows[1]["content"] and rows[1]["section_type"] == "METHOD"
    assert rows[3]["section_type"] == "RESULTS"


def test_reference_chunks_are_skipped(spark):
    pages = spark.createDataFrame([(1, 1, "a reference to some paper", "References", "REFERENCES", "TEXT")], PAGES)
    papers = spark.createDataFrame([(1, "T", 2020)], "doc_id long, title string, year int")
    chunks = chunk.structured_chunks(pages)
    assert chunks.count() == 1 and chunk.with_embedding_text(chunks, papers).count() == 0
    meta = chunk.metadata_chunks(chunks, papers).first()
    assert meta["content"] == "Paper title: T\nYear: 2020" and meta["chunk_index"] == 1


def test_mark_tables():
    text = "Table 2. Scores\nname  mrr  hits\nours  0.5  0.7\nplain text\n\nlonely  0.1  row"
    out = parse.mark_tables(text)
    assert out.startswith("[TABLE_CAPTION]Table 2. Scores[/TABLE_CAPTION]\n[TABLE]\n| name | mrr | hits |\n| --- | --- | --- |")
    assert out.endswith("[/TABLE]\nplain text\nlonely 0.1 row")


def test_title():
    assert parse.title_of("\nA Study of\nThings\nJane Doe, University X\n\nAbstract") == "A Study of Things"
    assert parse.title_of("Abstract\nwords of it") is None


def test_noise_needs_enough_pages(spark):
    pages = spark.createDataFrame([(1, k, f"Running  Title\nbody {k}\n{k}") for k in range(1, 5)], "doc_id long, page_num int, text string")
    got = {r["page_num"]: r["text"] for r in parse.drop_noise(pages).collect()}
    assert got == {k: f"body {k}\n" for k in range(1, 5)}
