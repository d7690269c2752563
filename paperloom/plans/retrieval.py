"""Queries on vectors, terms, fusion, routing, answers, evaluation and caches.

Vectors: every vector whose id is divisible by 50 asks, against all vectors; a label is a knowledge base. Terms:
every benchmark item asks with its whole text against all documents; doc_id mod 4 is a knowledge base.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.functions import text as T
from paperloom.functions import vectors as V
from paperloom.operators import answer, embed, evaluate, retrieve
from paperloom.plans import papersql as S
from paperloom.plans.registry import query, table


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("kb_id"), "embedding")


def _askers(spark, sf_dir, kb_ids=None):
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), "embedding", (kb_ids if kb_ids is not None else F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")).alias("kb_ids"))


_DIST = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.query_id, c.label AS kb_id, c.vec_id AS chunk_id, round(1.0 - list_cosine_similarity(q.e, c.embedding::DOUBLE[]), 6) AS distance FROM q, embeddings c),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY distance, chunk_id) AS kb_rank FROM d QUALIFY kb_rank <= 20)"""


@query("WITH " + _DIST + " SELECT query_id, CAST(kb_id AS BIGINT) AS kb_id, chunk_id, distance, CAST(kb_rank AS INTEGER) AS kb_rank FROM v")
def vector_topk(spark, sf_dir):
    found = retrieve.vector_topk(_askers(spark, sf_dir), _chunks(spark, sf_dir))
    return found.select("query_id", "kb_id", "chunk_id", "distance", "kb_rank")


@query("WITH " + _DIST + """, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank FROM v WHERE kb_rank <= 5)
SELECT query_id, chunk_id, round(1.0 / rank, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vector_only(spark, sf_dir):
    return retrieve.vector_only(_askers(spark, sf_dir), _chunks(spark, sf_dir), 5)


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS INTEGER)), ',') || ']' AS literal, array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS INTEGER)), ',') AS back FROM embeddings")
def vector_codec(spark, sf_dir):
    # SQL multiplies a float by an integer as floats and rounds halves away from zero
    thousands = F.transform("embedding", lambda x: x * F.lit(1000).cast("float"))
    whole = F.transform(thousands, lambda x: (F.signum(x) * F.floor(F.abs(x) + F.lit(0.5).cast("double"))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.to_literal(whole).alias("literal"))
    return rows.withColumn("back", V.to_csv(V.from_text(F.col("literal")).cast("array<int>")))


# --- terms ---

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS_SQL = rf"list_filter(regexp_split_to_array(text, '[\s[:punct:]]+'), lambda t: length(t) >= 2 AND lower(t) NOT IN ({_STOP}))"


@query(rf"SELECT item_id, array_to_string(list_slice({_TERMS_SQL}, 1, 1000), ' & ') AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " & ").alias("terms"))


@query(r"SELECT doc_id, len(w) AS n_lexemes, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)")
def lexemes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lexemes(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_lexemes"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _asked(spark, sf_dir):
    """Questions of the whole text of each item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array(*[F.lit(k).cast("long") for k in range(4)]).alias("kb_ids"))


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 4).alias("kb_id"), F.col("text").alias("content"))
    return retrieve.stored_postings(docs)


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_WHOLE_TERMS = rf"list_filter(regexp_split_to_array(text, '[\s\p{{P}}]+'), lambda t: length(t) >= 2 AND lower(t) NOT IN ({_STOP}))"
_WHOLE_LEXEMES = _WORDS.format(f"array_to_string(CASE WHEN len({_WHOLE_TERMS}) > 0 THEN {_WHOLE_TERMS} ELSE [substr(text, 1, 20)] END, ' ')")

_POST = f"""w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents),
p AS (SELECT doc_id AS chunk_id, doc_id % 4 AS kb_id, term, count(*) AS tf FROM w GROUP BY ALL),
a AS (SELECT DISTINCT item_id AS query_id, unnest({_WHOLE_LEXEMES}) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id),
o AS (SELECT query_id, kb_id, chunk_id, sum(tf) AS tf, count(*) AS matched FROM p JOIN a USING (term) GROUP BY ALL)"""
_RANKED = "SELECT query_id, kb_id, chunk_id, CAST(tf AS BIGINT) AS tf, CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY tf DESC, chunk_id) AS INTEGER) AS kb_rank FROM o"


@query(f"WITH {_POST} {_RANKED} JOIN n USING (query_id) WHERE matched = n QUALIFY kb_rank <= 20")
def fulltext_topk(spark, sf_dir):
    return retrieve.term_topk(_asked(spark, sf_dir), _index(spark, sf_dir)).select("query_id", "kb_id", "chunk_id", "tf", "kb_rank")


@query(f"WITH {_POST} {_RANKED} QUALIFY kb_rank <= 20")
def fulltext_any_term(spark, sf_dir):
    return retrieve.term_topk(_asked(spark, sf_dir), _index(spark, sf_dir), any_term=True).select("query_id", "kb_id", "chunk_id", "tf", "kb_rank")


@query(f"""WITH {_POST}, u AS (SELECT doc_id AS chunk_id, unnest(ls) AS term, generate_subscripts(ls, 1) AS at FROM (SELECT doc_id, {_WORDS.format("text")} AS ls FROM documents)),
h AS (SELECT query_id, kb_id, chunk_id, n FROM o JOIN n USING (query_id) WHERE matched = n),
x AS (SELECT h.query_id, h.kb_id, h.chunk_id, h.n, u.term, least(u.at, 16383) AS at, row_number() OVER (PARTITION BY h.query_id, h.chunk_id, u.term ORDER BY u.at) AS nth FROM h JOIN a USING (query_id) JOIN u ON u.chunk_id = h.chunk_id AND u.term = a.term QUALIFY nth <= 256),
y AS (SELECT l.query_id, l.kb_id, l.chunk_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN abs(l.at - r.at) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(l.at - r.at) / 1.5 - 2)) END)))) AS score
 FROM x l JOIN x r ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id AND l.term < r.term AND l.at <> r.at GROUP BY ALL),
z AS (SELECT query_id, kb_id, chunk_id, sum(0.1 / (nth * nth)) / 1.64493406685 AS score FROM x WHERE n = 1 GROUP BY ALL), s AS (SELECT * FROM y UNION ALL SELECT * FROM z)
SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER) AS kb_rank FROM s QUALIFY kb_rank <= 20""")
def fulltext_ranked(spark, sf_dir):
    """Documents that have all words of a passage, ranked by how near to each other they stand."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 4).alias("kb_id"), F.col("text").alias("content"))
    return retrieve.term_ranked(_asked(spark, sf_dir), retrieve.stored_postings(docs, positions=True)).select("query_id", "kb_id", "chunk_id", "score", "kb_rank")


# --- hybrid retrieval: vectors and, as a question, the whole text of the asking vector's document, against all vectors and documents ---

_HYBRID = "WITH " + _DIST + f""", k AS (SELECT d.doc_id AS chunk_id, coalesce(e.label, d.doc_id % 10) AS kb_id, d.text FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
w AS (SELECT chunk_id, kb_id, unnest({_WORDS.format("text")}) AS term FROM k),
p AS (SELECT chunk_id, kb_id, term, count(*) AS tf FROM w GROUP BY ALL),
a AS (SELECT DISTINCT q.query_id, unnest({_WHOLE_LEXEMES}) AS term FROM q JOIN documents ON doc_id = query_id),
n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id),
h AS (SELECT query_id, kb_id, chunk_id, sum(tf) AS tf FROM p JOIN a USING (term) JOIN n USING (query_id) GROUP BY query_id, kb_id, chunk_id, n.n HAVING count(*) = n.n),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY tf DESC, chunk_id) AS kb_rank FROM h QUALIFY kb_rank <= 20),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 0 AS src FROM v
 UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 1 AS src FROM t),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(src * 1000000 + rank) AS first FROM r GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10)"""


def _library(spark, sf_dir):
    """Questions with their texts, all vectors, and the term index of all documents; a document without a vector is in the knowledge base of its id mod 10."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    questions = _askers(spark, sf_dir).join(texts, "query_id", "left").withColumn("hyde_embedding", F.reverse("embedding"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label"))
    kb = F.coalesce("label", F.col("doc_id") % 10).alias("kb_id")
    indexed = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), kb, F.col("text").alias("content"))
    return questions, _chunks(spark, sf_dir), retrieve.stored_postings(indexed)


def _fused(spark, sf_dir, top=10):
    return retrieve.hybrid(*_library(spark, sf_dir), top=top)


@query(_HYBRID + " SELECT * FROM fused")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir)


@query(_HYBRID.replace("rank <= 10", "rank <= 20") + """, hd AS (SELECT q.query_id, c.label AS kb_id, c.vec_id AS chunk_id, round(1.0 - list_cosine_similarity(list_reverse(q.e), c.embedding::DOUBLE[]), 6) AS distance FROM q, embeddings c),
hv AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY distance, chunk_id) AS kb_rank FROM hd QUALIFY kb_rank <= 20),
b AS (SELECT query_id, chunk_id, rank, 0 AS src FROM fused UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 1 AS src FROM hv),
g AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(src * 1000000 + rank) AS first FROM b GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 20""")
def hyde_fusion(spark, sf_dir):
    """The hypothetical answer's vector is the question's reversed."""
    return retrieve.with_hypothesis(*_library(spark, sf_dir), top=20)


@query(_HYBRID + ", s AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fused) SELECT query_id, chunk_id, score, rank FROM s WHERE score >= 0.016 OR (best < 0.016 AND rank = 1)")
def confidence_filter(spark, sf_dir):
    return retrieve.confident(_fused(spark, sf_dir), 0.016)


_TOKENS = (
    r"CAST(floor(length(regexp_replace({0}, '[^\x{4e00}-\x{9fff}]', '', 'g')) * 1.5::DOUBLE + length(regexp_replace({0}, '[\s\x{4e00}-\x{9fff}]', '', 'g')) * 0.3::DOUBLE) AS INTEGER)"
)


@query(_HYBRID + f""", s AS (SELECT f.query_id, f.chunk_id, f.rank, {_TOKENS.replace("{0}", "d.text")} AS tokens FROM fused f JOIN documents d ON d.doc_id = f.chunk_id),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM s) SELECT query_id, chunk_id, rank, tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= 3000""")
def context_trim(spark, sf_dir):
    """The leading chunks of each question whose texts fit the budget."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return retrieve.within_budget(_fused(spark, sf_dir).join(texts, "chunk_id")).select("query_id", "chunk_id", "rank", "tokens", "used")


_SAID = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query(_HYBRID + f""", s AS (SELECT f.*, {_SAID.format("a.text")} AS asked, {_SAID.format("c.text")} AS said, count(*) OVER (PARTITION BY query_id) AS n
FROM fused f JOIN documents a ON a.doc_id = f.query_id JOIN documents c ON c.doc_id = f.chunk_id),
g AS (SELECT *, round(len(list_intersect(asked, said))::DOUBLE / len(asked), 6) AS rs FROM s),
z AS (SELECT query_id, chunk_id, CASE WHEN n > 5 THEN rs ELSE score END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN -rs END, rank) AS INTEGER) AS rank FROM g) SELECT * FROM z WHERE rank <= 5""")
def rerank(spark, sf_dir):
    """The first five by the share of the question's words that a chunk has."""
    docs = table(spark, sf_dir, "documents")
    rows = _fused(spark, sf_dir).join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("said")), "chunk_id")
    rows = rows.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("asked")), "query_id")
    scored = rows.withColumn("rerank_score", F.round(providers.relevance(F.col("asked"), F.col("said"), providers.overlap_ranker), 6)).drop("asked", "said")
    return retrieve.rerank(scored, 5, enabled=True).select("query_id", "chunk_id", "score", "rank")


# --- routing and answers ---


@query("""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'STANDARD' WHEN regexp_matches(text, '\\d+\\s*(天|个月|月|年|小时)') THEN CASE WHEN length(trim(text)) <= 24 THEN 'STANDARD' ELSE 'COMPLEX' END
WHEN length(trim(text)) <= 24 THEN 'SIMPLE' WHEN length(trim(text)) >= 80 THEN 'COMPLEX' ELSE 'STANDARD' END AS route FROM conversations""")
def route_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.route(F.col("text")).alias("route"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM conversations""")
def normalize_question(spark, sf_dir):
    quoted = F.concat(F.lit(" “"), F.regexp_replace("text", "^[\"'“”‘’]+|[\"'“”‘’]+$", ""), F.lit("\"' "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalized_question(quoted).alias("question"))




def _answers(spark, sf_dir):
    said = F.format_string("%s (source: [ref%d][ref1]) and [ref%d] [ref99999999999]", "text", F.col("turn") + 1, F.col("turn") % 3 + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("answer"))


@query("SELECT conv_id, turn, array_to_string(CASE WHEN turn = 0 THEN [1] WHEN turn % 3 = 0 OR turn % 3 = turn THEN [turn + 1, 1] ELSE [turn + 1, 1, turn % 3 + 1] END, ',') AS cited FROM conversations")
def citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(T.cited(F.col("answer")).cast("array<string>"), ",").alias("cited"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text || ' and ', '\s+', ' ', 'g')) AS cleaned FROM conversations")
def clean_citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", T.without_citations(F.col("answer")).alias("cleaned"))


def _chosen(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"),
                       F.lit(1).alias("page_num"), F.col("role").alias("section_title"), F.col("text").alias("content"), (F.lit(1.0) / (F.col("turn") + 1)).alias("score"))


@query(r"""SELECT conv_id AS query_id, regexp_replace(string_agg('[ref' || n || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS context, CAST(count(*) AS INTEGER) AS n_chunks
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def context_build(spark, sf_dir):
    return answer.contexts(_chosen(spark, sf_dir))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ref, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN [2, 1, 9999] WHEN conv_id % 3 = 1 THEN [9999] END AS refs, n FROM c),
x AS (SELECT conv_id, unnest(coalesce(refs, range(1, n + 1))) AS ref, unnest(range(0, len(coalesce(refs, range(1, n + 1))))) AS source_no FROM a)
SELECT x.conv_id AS query_id, CAST(x.source_no AS INTEGER) AS source_no, c.conv_id * 100 + c.turn AS chunk_id, coalesce(d.source, '未知文档') AS doc_name, substr(c.text, 1, 200) AS excerpt
FROM x JOIN c USING (conv_id, ref) LEFT JOIN documents d ON d.doc_id = c.conv_id""")
def build_sources(spark, sf_dir):
    """Answers that cite two chunks and one beyond the list, one beyond alone, and none, which means all."""
    chosen = _chosen(spark, sf_dir)
    said = F.when(F.col("query_id") % 3 == 0, "x [ref2][ref1] y [ref9999]").when(F.col("query_id") % 3 == 1, "z [ref9999]").otherwise("none")
    names = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"))
    rows = answer.sources(chosen.select("query_id").distinct().withColumn("answer", said), chosen, names)
    return rows.select("query_id", "source_no", "chunk_id", "doc_name", "excerpt")


@query(r"SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS score, doc_id % 2 = 0 AS faithful, trim(regexp_replace(text, '\s+', ' ', 'g')) AS reason FROM documents")
def faithfulness_parse(spark, sf_dir):
    """Verdicts whose reason is the whole text of a document."""
    said = F.regexp_replace("text", r"\s+", " ")
    reply = F.format_string("忠实性分数：%d\n是否忠实：%s\n理由： %s ", F.col("doc_id") % 11, F.when(F.col("doc_id") % 2 == 0, "是").otherwise("否"), said)
    return table(spark, sf_dir, "documents").select("doc_id", T.faithfulness(reply).alias("f")).select("doc_id", "f.score", "f.faithful", "f.reason")


@query("""WITH n AS (SELECT *, CAST(greatest(1, ceil(length(text) / 100.0)) AS INTEGER) AS n FROM conversations) SELECT conv_id * 100 + turn AS query_id, 0 AS n, 'status' AS event, 'generating' AS data FROM n
UNION ALL SELECT conv_id * 100 + turn, CAST(k + 1 AS INTEGER), 'token', substr(text, k * 100 + 1, 100) FROM n, unnest(range(n.n)) u(k) UNION ALL SELECT conv_id * 100 + turn, n + 1, 'done', role FROM n""")
def answer_events(spark, sf_dir):
    """Each turn of a conversation as an answer that is told in pieces."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), F.col("role").alias("sources"))
    return answer.events(rows, 100)


def _said(template: str, *values: str) -> str:
    """A format of %d and %s as a concatenation in SQL."""
    parts = re.split("%[ds]", template)
    return " || ".join(x for pair in zip(map(S.lit, parts), (*values, "''"), strict=True) for x in pair)


_FUSE = "round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(src * 1000000 + rank) AS first"
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS INTEGER) AS rank"
_ROUTE = """CASE WHEN trim(text) = '' THEN 'STANDARD' WHEN regexp_matches(text, '\\d+\\s*(天|个月|月|年|小时)') THEN CASE WHEN length(trim(text)) <= 24 THEN 'STANDARD' ELSE 'COMPLEX' END
WHEN length(trim(text)) <= 24 THEN 'SIMPLE' WHEN length(trim(text)) >= 80 THEN 'COMPLEX' ELSE 'STANDARD' END"""
#: q (query_id, e, h, route) and c (chunk_id, kb_id, e, content), with a (query_id, term), to fused (all but SIMPLE), near and wide (COMPLEX)
_PLANS = f"""d AS (SELECT q.query_id, c.kb_id, c.chunk_id, round(1.0 - list_cosine_similarity(q.e, c.e), 6) AS distance FROM q, c),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY distance, chunk_id) AS kb_rank FROM d QUALIFY kb_rank <= 20),
hd AS (SELECT q.query_id, c.kb_id, c.chunk_id, round(1.0 - list_cosine_similarity(q.h, c.e), 6) AS distance FROM q, c WHERE route = 'COMPLEX'),
hv AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY distance, chunk_id) AS kb_rank FROM hd QUALIFY kb_rank <= 20),
w AS (SELECT chunk_id, kb_id, unnest({_WORDS.format("content")}) AS term FROM c), p AS (SELECT chunk_id, kb_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id),
o AS (SELECT query_id, kb_id, chunk_id, sum(tf) AS tf FROM p JOIN a USING (term) JOIN n USING (query_id) GROUP BY query_id, kb_id, chunk_id, n.n HAVING count(*) = n.n),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY tf DESC, chunk_id) AS kb_rank FROM o QUALIFY kb_rank <= 20),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 0 AS src FROM v
 UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 1 AS src FROM t),
f AS (SELECT query_id, chunk_id, {_FUSE} FROM r GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, {_RANK} FROM f QUALIFY rank <= 20),
b AS (SELECT query_id, chunk_id, rank, 0 AS src FROM fused JOIN q USING (query_id) WHERE route = 'COMPLEX' UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank, 1 AS src FROM hv),
g AS (SELECT query_id, chunk_id, {_FUSE} FROM b GROUP BY ALL),
wide AS (SELECT query_id, chunk_id, score, {_RANK} FROM g QUALIFY rank <= 20),
near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY kb_id, kb_rank) AS rank FROM v JOIN q USING (query_id) WHERE route = 'SIMPLE' AND kb_rank <= 5 QUALIFY rank <= 5)"""

_ASK = f"""WITH c AS (SELECT vec_id AS chunk_id, label AS kb_id, embedding::DOUBLE[] AS e, text AS content, lang, source FROM embeddings JOIN documents ON doc_id = vec_id),
q AS (SELECT conv_id * 100 + turn AS query_id, text, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS h, {_ROUTE} AS route FROM conversations JOIN embeddings ON vec_id = conv_id),
a AS (SELECT DISTINCT query_id, unnest({_WHOLE_LEXEMES}) AS term FROM q WHERE route <> 'SIMPLE'), {_PLANS},
ranked AS (SELECT query_id, chunk_id, round(1.0 / rank, 6) AS score, CAST(rank AS INTEGER) AS rank FROM near UNION ALL SELECT query_id, chunk_id, score, rank FROM fused JOIN q USING (query_id) WHERE route = 'STANDARD' AND rank <= 10
 UNION ALL SELECT query_id, chunk_id, score, rank FROM wide WHERE rank <= 5),
sure AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS nth FROM ranked),
picked AS (SELECT query_id, chunk_id, score, rank, content, lang, source, {S.tokens("content")} AS tokens FROM sure JOIN c USING (chunk_id) WHERE score >= 0.5 OR (best < 0.5 AND nth = 1)),
used AS (SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS place FROM picked WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
parts AS (SELECT query_id, chunk_id, unnest(regexp_extract_all(content, '(?s)[^。！？\n]*[。！？\n]|[^。！？\n]+$')) AS part, generate_subscripts(regexp_extract_all(content, '(?s)[^。！？\n]*[。！？\n]|[^。！？\n]+$'), 1) AS k FROM used WHERE place = 1 AND used > 3000),
fit AS (SELECT *, sum({S.tokens("part")}) OVER (PARTITION BY query_id ORDER BY k) AS upto FROM parts), cut AS (SELECT query_id, string_agg(part, '' ORDER BY k) AS part FROM fit WHERE upto <= 3000 GROUP BY query_id),
chosen AS (SELECT query_id, chunk_id, score, lang, source, CASE WHEN used <= 3000 THEN content ELSE part END AS content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS ref FROM used LEFT JOIN cut USING (query_id)
 WHERE used <= 3000 OR (place = 1 AND NOT {S.blank("part")})),
told AS (SELECT query_id, {S.strip("string_agg('[ref' || ref || '] ' || lang || chr(10) || content, chr(10) || chr(10) ORDER BY ref)")} AS context, count(*) AS n FROM chosen GROUP BY query_id),
said AS (SELECT query_id, {_said(answer.PREAMBLE, "n", "n", "context")} || {S.lit(answer.RULES)} AS answer FROM told),
refs AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(answer, '\\[ref(\\d+)\\]', 1), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL) AS refs FROM said),
each AS (SELECT query_id, unnest(list_filter(refs, lambda x, i: list_position(refs, x) = i)) AS ref, generate_subscripts(list_filter(refs, lambda x, i: list_position(refs, x) = i), 1) AS no FROM refs),
src AS (SELECT query_id, to_json(list(struct_pack(chunk_id := chunk_id, doc_id := chunk_id, doc_name := source, page_num := 1, section_title := lang, excerpt := substr(content, 1, 200), score := score) ORDER BY no)) AS sources FROM each JOIN chosen USING (query_id, ref) GROUP BY query_id)
SELECT q.query_id, text AS question, {S.collapse(f"regexp_replace({S.strip('text')}, '^[{T.QUOTES.replace(chr(39), chr(39) * 2)}]+|[{T.QUOTES.replace(chr(39), chr(39) * 2)}]+$', '', 'g')")} AS cache_question, route, coalesce(answer, {S.lit(answer.NOT_FOUND)}) AS answer, answer IS NULL AS not_found, FALSE AS cached, CAST(coalesce(sources, '[]') AS VARCHAR) AS sources
FROM q LEFT JOIN said USING (query_id) LEFT JOIN src USING (query_id)"""


@query(_ASK)
def ask_batch(spark, sf_dir):
    """The whole plan from question to cited answer over the vectors and documents of the same ids.

    Every turn of a conversation asks with its whole text, by the vector of the conversation's id; the model says what it is told.
    """
    docs = table(spark, sf_dir, "documents")
    chunks = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("chunk_id"), "doc_id", F.col("label").cast("long").alias("kb_id"), "embedding", F.col("text").alias("content"), F.lit(1).alias("page_num"), F.col("lang").alias("section_title")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    questions = turns.join(vectors, "conv_id").select(
        "query_id", "question", "embedding", F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>").alias("kb_ids"), F.reverse("embedding").alias("hyde_embedding")
    )
    return answer.ask(questions, chunks, docs.select("doc_id", F.col("source").alias("file_name"))).drop("kb_ids", "faithfulness")


# --- evaluation ---

_HASHED = r"""(SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM {table})"""


def _hashed(name: str, key: str, table_: str) -> str:
    """CTEs from texts to vectors by feature hashing, as lists."""
    words = _HASHED.replace("{key}", key).replace("{table}", table_)
    return f"""{name}h AS (SELECT {key}, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS h FROM {words}),
{name}v AS (SELECT {key}, CAST(h % 64 AS INTEGER) AS k, sum(CASE WHEN h >> 63 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM {name}h GROUP BY ALL),
{name}e AS (SELECT {key}, list(coalesce(x, 0)::DOUBLE ORDER BY g.k) AS e FROM (SELECT {key}, unnest(range(64)) AS k FROM {table_}) g LEFT JOIN {name}v USING ({key}, k) GROUP BY {key})"""


@query(f"""WITH {_hashed("x", "doc_id", "documents")}, {_hashed("y", "item_id", "benchmark")},
c AS (SELECT doc_id AS chunk_id, 0 AS kb_id, e, text AS content FROM xe JOIN documents USING (doc_id)), q AS (SELECT item_id AS query_id, e, list_reverse(e) AS h, 'COMPLEX' AS route FROM ye),
a AS (SELECT DISTINCT item_id AS query_id, unnest({_WHOLE_LEXEMES}) AS term FROM benchmark), {_PLANS},
x AS (SELECT item_id, min(rank) AS rank FROM benchmark i JOIN documents ON contains(documents.text, i.text) JOIN wide ON query_id = item_id AND chunk_id = doc_id WHERE rank <= 10 GROUP BY item_id)
SELECT item_id AS dataset_id, x.rank IS NOT NULL AS hit, CAST(x.rank AS INTEGER) AS rank, 'v1' AS eval_version FROM benchmark LEFT JOIN x USING (item_id)""")
def evaluation_run(spark, sf_dir):
    """Benchmark passages as questions whose expected chunks are the documents that hold them, with vectors by feature hashing."""
    embed_ = providers.hashing_embedder()
    docs = table(spark, sf_dir, "documents")
    vector = providers.embedding(F.col("text"), embed_)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.lit(0).cast("long").alias("kb_id"), F.col("text").alias("content"), vector.alias("embedding"))
    items = table(spark, sf_dir, "benchmark")
    # a passage's documents are among those that have all its words
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array(F.lit(0).cast("long")).alias("kb_ids"))
    index_ = retrieve.stored_postings(chunks.drop("embedding"))
    held = retrieve.term_topk(asked, index_, k=1 << 30).join(docs.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(asked, "query_id")
    expected = held.filter(F.contains("text", "question")).groupBy(F.col("query_id").alias("id")).agg(F.collect_set("chunk_id").alias("expected_chunk_ids"))
    sets = items.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit(0).cast("long").alias("kb_id"), vector.alias("embedding"))
    sets = sets.withColumn("hyde_embedding", F.reverse("embedding")).join(expected, "id", "left")
    return evaluate.run(sets, chunks, index_, "v1", F.lit(0)).select("dataset_id", "hit", "rank", "eval_version")



@query(_HYBRID + """, e AS (SELECT DISTINCT query_id FROM q), x AS (SELECT query_id, query_id - query_id % 7 AS a, query_id AS b FROM e),
b AS (SELECT x.query_id, min(rank) AS rank FROM x JOIN fused f ON f.query_id = x.query_id AND f.chunk_id = x.a GROUP BY ALL)
SELECT count(*) AS total, count(b.rank) AS hits, avg(CASE WHEN b.rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) AS hit_rate, avg(coalesce(1.0::DOUBLE / b.rank, 0)) AS mrr, 0.0::DOUBLE AS faithfulness FROM e LEFT JOIN b USING (query_id)""")
def hit_rate_mrr(spark, sf_dir):
    """Each asking vector expects the nearest lower id divisible by 7 to be found."""
    wanted = F.col("query_id") - F.col("query_id") % 7
    questions = _askers(spark, sf_dir).select(F.col("query_id").alias("dataset_id"), F.array(wanted, wanted).alias("expected_chunk_ids"))
    results = evaluate.first_hits(questions, _fused(spark, sf_dir)).withColumn("faithfulness", F.lit(None).cast("double"))
    return evaluate.run_report(results)


@query("""SELECT d.doc_id % 4 AS kb_id, 'v' || (d.doc_id % 3) AS eval_version, count(*) AS total, CAST(sum(l.quality) AS BIGINT) AS hits, avg(l.quality::DOUBLE) AS hit_rate,
avg(CASE WHEN l.quality = 1 THEN 1.0::DOUBLE / (1 + d.doc_id % 5) ELSE 0 END) AS mrr, avg(CASE WHEN l.toxic = 0 THEN 0.8::DOUBLE ELSE 0 END) AS faithfulness, max(d.doc_id) AS eval_at
FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def eval_by_version(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    results = labels.select(
        F.col("doc_id").alias("dataset_id"), F.concat(F.lit("v"), F.col("doc_id") % 3).alias("eval_version"), (F.col("quality") == 1).alias("hit"),
        F.when(F.col("quality") == 1, F.col("doc_id") % 5 + 1).alias("rank"), F.when(F.col("toxic") == 0, 0.8).alias("faithfulness"), F.col("doc_id").alias("eval_at"),
    )
    dataset = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("kb_id"))
    return evaluate.history(results, dataset)


# --- caches ---


@query("SELECT doc_id, 'emb:v1:' || md5(text) AS cache_key FROM documents")
def embedding_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.embedding_key(F.col("text")).alias("cache_key"))


@query("""SELECT 'emb:v1:' || md5(text) AS cache_key, min(text) AS text FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1""")
def embed_cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = docs.filter("doc_id % 2 = 0").select(V.embedding_key(F.col("text")).alias("cache_key"))
    return embed.cache_misses(docs, cache)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS h FROM w),
v AS (SELECT doc_id, CAST(h % 64 AS INTEGER) AS k, CAST(sum(CASE WHEN h >> 63 = 1 THEN 1 ELSE -1 END) AS INTEGER) AS x FROM h GROUP BY ALL), g AS (SELECT doc_id, unnest(range(64)) AS k FROM documents)
SELECT doc_id, string_agg(coalesce(x, 0), ',' ORDER BY g.k) AS embedding FROM g LEFT JOIN v USING (doc_id, k) GROUP BY doc_id""")
def embed_documents(spark, sf_dir):
    """All documents embedded by feature hashing, each distinct text once; the vectors as text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    full = embed.embed_with_cache(docs, empty, providers.hashing_embedder())[0]
    return full.select("doc_id", V.to_csv(F.transform("embedding", lambda x: x.cast("int"))).alias("embedding"))


@query("SELECT item_id, md5(text || ':[' || (item_id % 3) || ', ' || (item_id % 3 + 5) || ']') AS cache_key FROM benchmark")
def answer_cache_key(spark, sf_dir):
    kbs = F.array(F.col("item_id") % 3 + 5, F.col("item_id") % 3)
    return table(spark, sf_dir, "benchmark").select("item_id", V.answer_key(F.col("text"), kbs).alias("cache_key"))
