"""Documents to clean pages: noise lines, tables, sections, titles.

Pages are rows (doc_id, page_num, text, ...). Line-level work explodes pages, and puts lines back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.functions import text as T

ONLY_PDF = "Only PDF is supported."
NEEDS_OCR = "No extractable text; scanned documents require OCR."
SHORT = 140  # characters of a line that can be a repeated one
MANY = 1000  # pages of a document that are cleaned in one task
SLICE = 256  # pages that a worker unpacks at a time


def by_type(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds success and error_msg: other types than .pdf fail as data, not as an exception."""
    ok = F.lower(F.coalesce(F.col(name), F.lit(""))).endswith(".pdf")
    said = F.concat(F.lit("Unsupported file type: "), F.coalesce(F.col(name), F.lit("null")), F.lit(f". {ONLY_PDF}"))
    return files.withColumns({"success": ok, "error_msg": F.when(~ok, said)})


def plain_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as one page numbered 1."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.lit(1).alias("page_num"), F.col(text).alias("text"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, pos, line) with positions from 0."""
    return pages.select("doc_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_key, pages): on how many pages of a document a short line occurs, whatever its case and spacing."""
    keyed = lines.withColumn("line_key", T.noise_key(F.col("line"))).filter((F.col("line_key") != "") & (F.length("line_key") <= 140))
    return keyed.groupBy("doc_id", "line_key").agg(F.count_distinct("page_num").alias("pages"))


def _keys(text: Column) -> Column:
    """The distinct keys of a page's short lines."""
    short = F.filter(T.lines(text), lambda x: T.may_be_short(x, SHORT))
    return F.array_distinct(F.filter(F.transform(short, T.noise_key), lambda x: (x != "") & (F.length(x) <= SHORT)))


def frequent_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, frequent): keys of the short lines that stand on too many pages of their document, which has three pages at least.

    Keys alone are moved, counted where they are first, so neither texts nor a document of very many pages meet in one task.
    """
    totals = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages")).filter("total_pages >= 3")
    # outer: of an inner one the optimiser filters by the array first, which makes it twice
    each = pages.select("doc_id", F.explode_outer(_keys(F.col("text"))).alias("line_key")).filter("line_key IS NOT NULL")
    counts = each.groupBy("doc_id", "line_key").agg(F.count("*").alias("pages")).filter("pages >= 3")
    often = counts.join(totals, "doc_id").filter(F.col("pages") >= T.repeat_threshold(F.col("total_pages")))
    return often.groupBy("doc_id").agg(F.collect_set("line_key").alias("frequent"))


def drop_noise(pages: DataFrame) -> DataFrame:
    """pages without page numbers, running heads, and lines on too many pages of their document; blank lines stay.

    Only the keys of lines are counted across pages; each page then loses its lines in its own row, so texts are not taken apart and
    put together again. A document's frequent lines are few: each stands on a third of its pages. Pages of a document of more than
    MANY are dealt out, each part with a copy of these lines.
    """
    known = F.coalesce("frequent", F.array().cast("array<string>"))
    often = lambda x: (F.size(known) > 0) & T.may_be_short(x, SHORT) & F.array_contains(known, T.noise_key(x))
    keep = lambda x: (T.strip(x) == "") | ~(T.is_page_number(x) | T.is_running_head(x) | often(x))
    kept = F.transform(F.filter(T.lines(F.col("text")), keep), lambda x: F.when(T.strip(x) == "", "").otherwise(x))
    # at most one row in MANY of all pages
    large = pages.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("doc_id", F.ceil(F.col("n") / MANY).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    lines = frequent_lines(pages).join(F.broadcast(large), "doc_id", "left").select("doc_id", "frequent", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    dealt = pages.join(F.broadcast(large), "doc_id", "left").withColumn("_part", F.pmod(F.xxhash64("page_num"), parts).cast("int"))
    out = dealt.join(lines, ["doc_id", "_part"], "left").withColumn("_kept", kept)
    return out.withColumn("text", F.when(F.size("_kept") > 0, F.concat(F.array_join("_kept", "\n"), F.lit("\n"))).otherwise("")).select(*pages.columns)


def with_sections(pages: DataFrame) -> DataFrame:
    """Section of each page: its own first heading, or else that of the nearest page before it with one."""
    found = pages.withColumn("_found", T.first_section(F.col("text")))
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_found", ignorenulls=True).over(before)
    return found.withColumns({"section_title": last["section_title"], "section_type": last["section_type"]}).drop("_found")


def with_content_type(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content_type", T.page_content_type(F.col("text")))


def drop_blank(pages: DataFrame) -> DataFrame:
    return pages.filter(~T.is_blank(F.col("text")))


def failures(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents without any text left."""
    return docs.join(drop_blank(pages), "doc_id", "left_anti").select("doc_id", F.lit(NEEDS_OCR).alias("error_msg"))


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text): pages that are not blank, in order, with an empty line between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"])
    return drop_blank(pages).groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("full_text"))


# --- scans of a page's lines that stop early or carry state; Arrow-batched ---

_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f              　"
_BREAK = re.compile(r"\r\n|[\n\x0b\x0c\r\x85  ]")
_GAP = re.compile(r"\s\s", re.ASCII)
_CAPTION = re.compile(T.TABLE_CAPTION + r"\Z", re.ASCII)
_PREFIX = re.compile(T.SECTION_PREFIX, re.ASCII)
#: Without any of these a page has neither a row of cells nor a caption.
_TABULAR = re.compile(r"\||\t|  |table\s", re.I)
_KINDS = {key: kind for kind, keys in T.SECTION_TYPES.items() for key in keys}


def heading_type(line: str) -> str | None:
    """The Python twin of text.section_type, for scans."""
    own = line.strip(_SPACES)
    if len(own) > 120 and not _GAP.search(own):
        return None
    own = re.sub(r"\s+", " ", own, flags=re.ASCII).strip(_SPACES)
    if not 2 <= len(own) <= 120:
        return None
    bare = re.sub(r"[^a-z0-9一-鿿 ]", " ", _PREFIX.sub("", own, count=1).lower())
    return _KINDS.get(" ".join(bare.split()))


def caption_of(line: str) -> str | None:
    own = line.strip(_SPACES)
    return own if 8 <= len(own) <= 300 and _CAPTION.match(own) else None


def table_cells(line: str) -> list[str]:
    """Cells of a line that looks like a table row: piped, or in columns set apart by tabs or wide gaps."""
    own = line.strip(_SPACES)
    wide = "  " in own or "\t" in own
    if len(own) < 8 or not (wide or own[0] == own[-1] == "|") or heading_type(own):
        return []
    if own[0] == own[-1] == "|" and own.find("|", 1) > 0:
        parts = own.split("|")
    elif wide and (re.search(r"\d", own, re.ASCII) or re.search("[A-Za-z].*[A-Za-z]", own)):
        parts = re.split(r"\t+| {2,}", own)
    else:
        return []
    return [p.strip(_SPACES).replace("|", "/") for p in parts if p.strip(_SPACES)]


def _markdown(rows: list[list[str]]) -> list[str]:
    width = max(map(len, rows))
    shown = ["|" + "".join(f" {c} |" for c in row + [""] * (width - len(row))) for row in rows]
    return [shown[0], "|" + " --- |" * width, *shown[1:]]


def mark_tables(page: str) -> str:
    """Runs of two or more table rows as Markdown between [TABLE] marks, with the caption that came before.

    A caption that no table follows is held for a later table and otherwise lost.
    """
    if not _TABULAR.search(page):
        return re.sub("[ \t]+", " ", "\n".join(own for x in _BREAK.split(page) if (own := x.strip(_SPACES)))).strip(_SPACES)
    out: list[str] = []
    rows: list[list[str]] = []
    caption: str | None = None

    def close() -> None:
        if len(rows) == 1:
            out.append(" ".join(rows[0]))
        elif rows:
            if caption:
                out.append(f"[TABLE_CAPTION]{caption}[/TABLE_CAPTION]")
            out.extend(["[TABLE]", *_markdown(rows), "[/TABLE]"])
        rows.clear()

    for line in _BREAK.split(page):
        title = caption_of(line)
        if title:
            close()
            caption = title
            continue
        cells = table_cells(line)
        if len(cells) >= 2:
            rows.append(cells)
            continue
        if rows:
            close()
            caption = None
        if line.strip(_SPACES):
            out.append(line.strip(_SPACES))
    close()
    text = re.sub("[ \t]+", " ", "\n".join(out))
    return re.sub("\n{3,}", "\n\n", text).strip(_SPACES)


def with_tables(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(mark_tables, na_action="ignore")

    return pages.withColumn("text", marked("text"))


def first_heading(page: str) -> tuple[str | None, str | None]:
    """(title, type) of the first heading among the first eight lines; the Python twin of text.first_section, for scans."""
    for line in _BREAK.split(page, maxsplit=8)[:8]:
        kind = heading_type(line)
        if kind:
            return re.sub(r"\s+", " ", line, flags=re.ASCII).strip(_SPACES), kind
    return None, None


def _scan(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
        texts = [mark_tables(t or "") for t in batch.column(at).to_pylist()]
        heads = [first_heading(t) for t in texts]
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
        columns += [pa.array([h[k] for h in heads], pa.string()) for k in (0, 1)]
        out = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_title", "_type"])
        yield out.filter(pa.array([t != "" for t in texts], pa.bool_()))


def _tables_and_sections(pages: DataFrame) -> DataFrame:
    """drop_blank(with_tables(pages)) with sections, each page's text read once."""
    read = pages.mapInArrow(partial(_scan, at=pages.columns.index("text")), StructType([*pages.schema, StructField("_title", StringType()), StructField("_type", StringType())]))
    own = F.when(F.col("_type").isNotNull(), F.struct("_title", "_type"))
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(own, ignorenulls=True).over(before)
    found = read.withColumn("_found", last)
    return found.withColumns({"section_title": F.col("_found._title"), "section_type": F.col("_found._type")}).drop("_found", "_title", "_type")


def _is_credit(line: str) -> bool:
    low = line.lower()
    words = ("@", "university", "institute", "department", "arxiv")
    return any(w in low for w in words) or low.startswith("http") or bool(re.search(r"\b20\d{2}\b", low, re.ASCII))


def title_of(page: str) -> str | None:
    """Up to three lines of 6 to 180 characters at the head of the first page, before any heading or credit line."""
    got: list[str] = []
    for line in (x.strip(_SPACES) for x in _BREAK.split(page)):
        if len(got) == 3 or (got and (not line or _is_credit(line))) or (line and heading_type(line)):
            break
        skipped = not line or line in ("[TABLE]", "[/TABLE]") or line.startswith(("|", "[TABLE_CAPTION]")) or _is_credit(line)
        if not skipped and 6 <= len(line) <= 180:
            got.append(line)
    return " ".join(got).strip(_SPACES) or None


def title_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def title(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(title_of)

    return title(text)


def titles(pages: DataFrame) -> DataFrame:
    """(doc_id, title) from each document's first page."""
    first = pages.groupBy("doc_id").agg(F.min_by("text", "page_num").alias("text"))
    return first.select("doc_id", title_column(F.col("text")).alias("title"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Raw pages to clean ones: noise, tables, content type, carried sections; blank pages dropped."""
    tidy = drop_noise(pages.withColumn("text", T.clean_keeping_columns(F.col("text"))))
    return with_content_type(_tables_and_sections(tidy))
