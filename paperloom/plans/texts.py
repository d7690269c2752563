"""Queries on cleaning, parsing, chunking and metadata over the whole documents, pages and conversations.

Documents hold prose alone, so for what papers have besides (headings, tables, running heads, identifiers) each document is set as
a paper of two or three pages around its whole text; the SQL then reads these pages as it finds them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunk, metadata, parse
from paperloom.plans import papersql as S
from paperloom.plans.registry import query, table
from paperloom.sources.scratch import materialize

HEADINGS = ("1. Introduction", "Related Work", "3.2 Experimental Setup", "IV. Results", "Our Results", "mid results", "Discussion")


def _papers(spark, sf_dir):
    """(doc_id, page_num, text) of papers around the documents' texts."""
    d, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (d % 7 + 1).cast("int"))
    said = lambda form, *columns: F.format_string(form, *columns)
    pages = [
        F.concat(said("Collected Papers\nA Study of %s in %s, No %d\n\nJane Doe and John Roe\nDepartment of %s\n\nAbstract\n", source, lang, d, lang), "text", said("\nKeywords: %s, %s", lang, source)),
        F.concat(
            said("Collected  Papers\n%s\n", heading), "text",
            said("\nTable %d: Results on ICEWS14 and GDELT\nModel  MRR  Year\n%s*  0.%d  2020\nBase\t1\t2021  more\n\nAfter the table of %s. It has a tail of words.\n", d % 9 + 1, source, d, source),
            said("doi:10.%d/%s.%d. arXiv: %04d.%05d (c) %d, accepted %d\n%d", d % 9000 + 1000, source, d, d % 10000, d % 100000, d % 60 + 1950, d % 20 + 2001, d % 30),
        ),
        F.when(d % 3 == 0, said("collected papers\nReferences\n[1] A. Author. On %s and %s, found in 2019.\nPreprint of 2019\nlone  row of 1 table", source, lang)),
    ]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*pages)).alias("pos", "text"))
    return rows.filter(F.col("text").isNotNull()).select("doc_id", (F.col("pos") + 1).alias("page_num"), "text")


_PAGES = f"""pages_in AS (SELECT doc_id, 1 AS page_num, printf('Collected Papers\nA Study of %s in %s, No %d\n\nJane Doe and John Roe\nDepartment of %s\n\nAbstract\n', source, lang, doc_id, lang) || text || printf('\nKeywords: %s, %s', lang, source) AS raw FROM documents
UNION ALL SELECT doc_id, 2, printf('Collected  Papers\n%s\n', {S.items(HEADINGS)}[1 + doc_id % 7]) || text || printf('\nTable %d: Results on ICEWS14 and GDELT\nModel  MRR  Year\n%s*  0.%d  2020\nBase\t1\t2021  more\n\nAfter the table of %s. It has a tail of words.\n', doc_id % 9 + 1, source, doc_id, source)
 || printf('doi:10.%d/%s.%d. arXiv: %04d.%05d (c) %d, accepted %d\n%d', doc_id % 9000 + 1000, source, doc_id, doc_id % 10000, doc_id % 100000, doc_id % 60 + 1950, doc_id % 20 + 2001, doc_id % 30) FROM documents
UNION ALL SELECT doc_id, 3, printf('collected papers\nReferences\n[1] A. Author. On %s and %s, found in 2019.\nPreprint of 2019\nlone  row of 1 table', source, lang) FROM documents WHERE doc_id % 3 = 0)"""
_PARSED = f"WITH RECURSIVE {_PAGES}, {S.PARSED}"


def _parsed(spark, sf_dir):
    return parse.parse_pages(_papers(spark, sf_dir))


STRIP_SQL = r"regexp_replace({0}, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP_SQL.replace("{0}", x)


_LINES = r"""WITH l AS (SELECT source, doc_id, unnest(string_split(regexp_replace(text, '\n+$', ''), chr(10))) AS line,
    generate_subscripts(string_split(regexp_replace(text, '\n+$', ''), chr(10)), 1) - 1 AS pos FROM documents WHERE trim(text) <> '')"""


@query(r"SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) * 1.5::DOUBLE + "
       r"length(regexp_replace(text, '[\s\x{4e00}-\x{9fff}]', '', 'g')) * 0.3::DOUBLE) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, " + _strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def _source_pages(spark, sf_dir):
    """Each source as a document whose pages are its texts."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_num"), "text")


@query(_LINES + r""", k AS (SELECT source, doc_id, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line_key FROM l)
SELECT source, line_key, count(DISTINCT doc_id) AS pages FROM k WHERE line_key <> '' AND length(line_key) <= 140 GROUP BY ALL""")
def repeated_lines(spark, sf_dir):
    return parse.repeated_lines(parse.page_lines(_source_pages(spark, sf_dir))).select(F.col("doc_id").alias("source"), "line_key", "pages")


@query(_LINES + r""", k AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line_key FROM l),
t AS (SELECT source, greatest(3, least(count(*), ceil(count(*) * 0.35::DOUBLE))) AS most FROM documents GROUP BY source),
f AS (SELECT source, line_key, count(DISTINCT doc_id) AS n FROM k WHERE line_key <> '' AND length(line_key) <= 140 GROUP BY ALL),
kept AS (SELECT k.doc_id, k.pos, CASE WHEN k.line_key = '' THEN '' ELSE k.line END AS line FROM k JOIN t USING (source) LEFT JOIN f USING (source, line_key)
  WHERE k.line_key = '' OR NOT (coalesce(f.n, 0) >= t.most OR
    regexp_matches(trim(k.line), '^(\d{1,4}|(page|p\.)\s*\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|-\s*\d{1,4}\s*-)$') OR
    (length(lower(trim(k.line))) <= 180 AND (contains(lower(k.line), 'proceedings of') OR contains(lower(k.line), 'conference on neural information processing systems')
      OR contains(lower(k.line), 'copyright') OR contains(lower(k.line), 'all rights reserved')
      OR regexp_matches(lower(trim(k.line)), '^(arxiv:\d{4}\.\d{4,5}|preprint|under review|published as)')))))
SELECT d.doc_id, coalesce(g.kept_text, '') AS kept_text FROM documents d LEFT JOIN
  (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS kept_text FROM kept GROUP BY doc_id) g USING (doc_id)""")
def noise_filter(spark, sf_dir):
    return parse.drop_noise(_source_pages(spark, sf_dir)).select(F.col("page_num").alias("doc_id"), F.col("text").alias("kept_text"))


@query(f"WITH l AS (SELECT doc_id, {S.lines('text')} AS ls FROM documents) SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM l")
def split_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


@query(f"""WITH {_PAGES}, l AS (SELECT doc_id, page_num, {S.lines('raw')} AS ls FROM pages_in), e AS (SELECT doc_id, page_num, unnest(ls) AS line FROM l),
t AS (SELECT *, {S.section_type('line')} AS section_type FROM e) SELECT doc_id, page_num, line, section_type FROM t WHERE section_type IS NOT NULL""")
def section_detect(spark, sf_dir):
    """The headings among all lines of the papers."""
    lines = parse.page_lines(_papers(spark, sf_dir)).withColumn("section_type", T.section_type(F.col("line")))
    return lines.filter(F.col("section_type").isNotNull()).select("doc_id", "page_num", "line", "section_type")


@query(f"""WITH {_PAGES}, h AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '{S.BREAKS}')[1:8], lambda x: struct_pack(title := {S.collapse('x')}, kind := {S.section_type('x')})), lambda h: h.kind IS NOT NULL)[1] AS head FROM pages_in)
SELECT doc_id, page_num, last_value(head.title IGNORE NULLS) OVER w AS section_title, last_value(head.kind IGNORE NULLS) OVER w AS section_type FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page_num ROWS UNBOUNDED PRECEDING)""")
def section_carry_forward(spark, sf_dir):
    return parse.with_sections(_papers(spark, sf_dir)).select("doc_id", "page_num", "section_title", "section_type")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def full_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text")
    return parse.full_text(turns).select(F.col("doc_id").alias("conv_id"), "full_text")


@query(f"{_PARSED} SELECT doc_id, page_num, content_type FROM parsed")
def page_content_type(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "page_num", "content_type")


@query("""SELECT page_id, url, CASE WHEN ends_with(lower(url), '.pdf') THEN NULL ELSE 'Unsupported file type: ' || url || '. Only PDF is supported.' END AS error_msg,
ends_with(lower(url), '.pdf') AS success FROM pages""")
def file_type_dispatch(spark, sf_dir):
    return parse.by_type(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "url", "error_msg", "success")


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) AS n_pages, CAST(greatest(3, least(count(*) OVER (PARTITION BY source), ceil(count(*) OVER (PARTITION BY source) * 0.35::DOUBLE))) AS INTEGER) AS threshold FROM documents")
def repeat_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_pages")).withColumn("threshold", T.repeat_threshold(F.col("n_pages")))
    return docs.select("doc_id", "source").join(sizes, "source").select("doc_id", "n_pages", "threshold")


@query(f"{_PARSED} SELECT * FROM parsed")
def parse_documents(spark, sf_dir):
    """The papers through the whole parse: noise, tables, sections, types."""
    return _parsed(spark, sf_dir)


@query(f"{_PARSED}, {S.TITLES} SELECT * FROM titled")
def extract_titles(spark, sf_dir):
    return parse.titles(_parsed(spark, sf_dir))


@query(f"WITH RECURSIVE plain AS (SELECT doc_id, 1 AS page_num, text FROM documents), {S.SLIDING} SELECT * FROM chunked")
def chunk_sliding(spark, sf_dir):
    """Windows over the whole documents, each as one page."""
    return chunk.sliding_chunks(parse.plain_pages(table(spark, sf_dir, "documents")))


@query(f"{_PARSED}, {S.STRUCTURED} SELECT * FROM chunked")
def chunk_structured(spark, sf_dir):
    return chunk.structured_chunks(_parsed(spark, sf_dir))


@query(f"""{_PARSED}, {S.STRUCTURED}, {S.METADATA}, k AS (SELECT c.*, m.title, m.authors, m.year, d.source AS file_name FROM chunked c LEFT JOIN metadata m USING (doc_id) LEFT JOIN documents d USING (doc_id) WHERE NOT (upper(coalesce(section_type, '')) = 'REFERENCES' AND content_type <> 'TABLE'))
SELECT doc_id, chunk_index, content, raw_content, table_caption, page_num, section_title, section_type, content_type, token_count, concat_ws(chr(10), {S.field("Paper title", "title")}, {S.field("Authors", "authors")}, {S.field("Year", "year")},
{S.field("Source file", "file_name")}, {S.field("Section", "section_title")}, {S.field("Section type", "section_type")}, {S.field("Page", "page_num")}, {S.field("Table caption", "table_caption")}, {S.field("Content type", "content_type")}, {S.field("Content", "content")}) AS embedding_text FROM k""")
def embedding_texts(spark, sf_dir):
    pages = materialize(_parsed(spark, sf_dir), "parsed")  # both branches read it
    names = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"))
    papers = metadata.extract(pages, 2025).select("doc_id", "title", "authors", "year").join(names, "doc_id")
    return chunk.with_embedding_text(chunk.structured_chunks(pages), papers)


@query(f"""{_PARSED}, {S.METADATA} SELECT m.doc_id, concat_ws(chr(10), {S.field("Paper title", "title")}, {S.field("Authors", "authors")}, {S.field("Year", "year")}, {S.field("DOI", "doi")}, {S.field("arXiv", "arxiv_id")},
{S.field("Keywords", "keywords")}, {S.field("Abstract", "abstract_text")}, {S.field("Source file", "source")}) AS paper_text FROM metadata m JOIN documents d USING (doc_id)""")
def paper_metadata_text(spark, sf_dir):
    found = metadata.extract(_parsed(spark, sf_dir), 2025).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name")), "doc_id")
    return found.select("doc_id", chunk.paper_text({c: F.col(c) for c in found.columns}).alias("paper_text"))


@query(f"WITH {_PAGES} SELECT doc_id, page_num, regexp_replace(nullif(regexp_extract(raw, {S.lit(metadata.DOI)}, 1), ''), '[\\s.,;:]+$', '') AS doi FROM pages_in")
def extract_doi(spark, sf_dir):
    return _papers(spark, sf_dir).select("doc_id", "page_num", metadata.doi(F.col("text")).alias("doi"))


@query(f"WITH {_PAGES} SELECT doc_id, page_num, nullif(regexp_extract(raw, {S.lit(metadata.ARXIV)}, 1), '') AS arxiv_id FROM pages_in")
def extract_arxiv(spark, sf_dir):
    return _papers(spark, sf_dir).select("doc_id", "page_num", metadata.arxiv_id(F.col("text")).alias("arxiv_id"))


@query(f"WITH {_PAGES} SELECT doc_id, page_num, list_filter(list_transform(regexp_extract_all(raw, {S.lit(metadata.YEAR)}, 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2026)[1] AS year FROM pages_in")
def extract_year(spark, sf_dir):
    return _papers(spark, sf_dir).select("doc_id", "page_num", metadata.year(F.col("text"), 2025).alias("year"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Untitled Paper' WHEN doc_id % 4 = 1 THEN source ELSE lang || ' ' || doc_id END AS title FROM documents""")
def default_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 4 >= 2, F.concat(F.lit(" "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")))
    name = F.when(F.col("doc_id") % 4 != 0, F.concat("source", F.lit(".pdf")))
    return docs.select("doc_id", metadata.default_title(given, name).alias("title"))


@query(f"{_PARSED}, {S.METADATA} SELECT * FROM metadata")
def extract_metadata(spark, sf_dir):
    return metadata.extract(_parsed(spark, sf_dir), 2025)


@query(f"""{_PARSED}, {S.SECTIONS}, tables_in AS (SELECT doc_id AS key, text AS raw, table_caption AS caption, section_title AS title, section_type AS kind, page_num AS page FROM sections WHERE content_type = 'TABLE'), {S.FACTS}
SELECT key AS doc_id, array_to_string(datasets, '|') AS datasets, array_to_string(metrics, '|') AS metrics, array_to_string(methods, '|') AS methods, array_to_string(keywords, '|') AS keywords, summary FROM facts""")
def table_facts(spark, sf_dir):
    """What is known of every table of the papers."""
    rows = chunk.sections(_parsed(spark, sf_dir)).filter("content_type = 'TABLE'").withColumn("cells", chunk.parse_table(F.col("text")))
    raw, caption, title, kind, page = (F.col(c) for c in ("text", "table_caption", "section_title", "section_type", "page_num"))
    joined = lambda names: F.array_join(names, "|")
    return rows.select(
        "doc_id", joined(chunk.dataset_names(caption, raw)).alias("datasets"), joined(chunk.metric_names(F.col("cells"), caption, raw)).alias("metrics"),
        joined(chunk.method_names(F.col("cells"))).alias("methods"), joined(chunk.table_keywords(caption, title, kind)).alias("keywords"),
        chunk.table_summary(raw, caption, title, kind, page, F.col("cells")).alias("summary"),
    )
