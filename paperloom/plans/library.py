"""Queries on lists, permissions, tasks, changes, chats and the token meter.

Documents stand for papers and stored documents (doc_id mod 4 is the knowledge base), orders for index tasks of a
customer, conversations for chats, events for the meter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import index
from paperloom.operators import library as L
from paperloom.plans.registry import query, table
from paperloom.streaming import meter

STATUSES = ("UNREAD", "READING", "READ", "ARCHIVED")
_PAPER_SQL = """p AS (SELECT doc_id AS id, doc_id % 4 AS kb_id, text AS title, ['UNREAD','READING','READ','ARCHIVED'][1 + doc_id % 4] AS reading_status,
n_chars AS updated_at, CASE WHEN doc_id % 11 = 0 THEN TRUE WHEN doc_id % 13 = 0 THEN NULL ELSE FALSE END AS is_deleted FROM documents)"""


def _papers(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 4 + 1).cast("int"))
    gone = F.when(F.col("doc_id") % 11 == 0, True).when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(False)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("kb_id"), F.col("text").alias("title"), status.alias("reading_status"),
        F.col("n_chars").alias("updated_at"), gone.alias("is_deleted"),
    )


def _order(listed):
    """The order of a list as data, so that a comparison sees it; lists are what a reader pages through."""
    return listed.select("id", "title", "kb_id", "reading_status", "updated_at")


_LIST = "SELECT id, title, kb_id, reading_status, updated_at FROM p WHERE is_deleted = FALSE"


@query(f"WITH {_PAPER_SQL} {_LIST}")
def list_papers(spark, sf_dir):
    return _order(L.papers(_papers(spark, sf_dir)))


@query(f"WITH {_PAPER_SQL} {_LIST} AND kb_id = 2")
def list_papers_of_kb(spark, sf_dir):
    return _order(L.papers(_papers(spark, sf_dir), kb_id=2))


@query(f"WITH {_PAPER_SQL} {_LIST} AND reading_status = 'READING'")
def list_papers_by_status(spark, sf_dir):
    return _order(L.papers(_papers(spark, sf_dir), kb_id=2, status=" reading "))


@query(f"WITH {_PAPER_SQL} {_LIST} AND contains(lower(title), 'the')")
def list_papers_by_title(spark, sf_dir):
    return _order(L.papers(_papers(spark, sf_dir), kb_id=2, status="READ", keyword="THE"))


@query(f"WITH {_PAPER_SQL} SELECT id, kb_id FROM p WHERE is_deleted IS DISTINCT FROM TRUE")
def present_null_kept(spark, sf_dir):
    return L.present(_papers(spark, sf_dir), null_is_present=True).select("id", "kb_id")


@query(f"WITH {_PAPER_SQL} SELECT kb_id, min(id) AS id FROM p WHERE is_deleted = FALSE GROUP BY kb_id")
def first_paper_of_kb(spark, sf_dir):
    return L.first_by(L.present(_papers(spark, sf_dir)), ["kb_id"], F.col("id")).select("kb_id", "id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')")
def title_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.lower("p_name").contains("a")).select("p_partkey", "p_name")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def chunk_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UNREAD' ELSE ['UNREAD','READING','READ','ARCHIVED'][1 + doc_id % 4] END AS reading_status FROM documents")
def parse_choice(spark, sf_dir):
    given = F.lower(F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 4 + 1).cast("int")))
    value = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), given))
    return table(spark, sf_dir, "documents").select("doc_id", L.choice(value, "reading_status", "UNREAD").alias("reading_status"))


# --- permissions: nations are knowledge bases, customers' grants name their nation, segments are departments ---

_GRANT_SQL = """g AS (SELECT c_custkey AS kb_key, n_nationkey AS kb_id, CASE WHEN c_custkey % 2 = 0 THEN 'USER' ELSE 'DEPARTMENT' END AS subject_type,
CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 50 AS VARCHAR) ELSE c_mktsegment END AS subject_id, ['READ','WRITE','ADMIN'][1 + c_custkey % 3] AS permission
FROM customer JOIN nation ON n_nationkey = (c_nationkey * 7 + c_custkey) % 25 AND n_nationkey % 5 < 3),
k AS (SELECT n_nationkey AS id, n_nationkey % 6 = 0 AS is_public, n_nationkey % 10 = 9 AS is_deleted FROM nation)"""


def _grants(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    kb = ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).cast("int")
    user = F.col("c_custkey") % 2 == 0
    return customers.filter(kb % 5 < 3).select(
        kb.alias("kb_id"), F.when(user, "USER").otherwise("DEPARTMENT").alias("subject_type"),
        F.when(user, (F.col("c_custkey") % 50).cast("string")).otherwise(F.col("c_mktsegment")).alias("subject_id"),
        F.element_at(F.array(*map(F.lit, L.LEVELS)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("permission"),
    )


def _kbs(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.alias("id"), (key % 6 == 0).alias("is_public"), (key % 10 == 9).alias("is_deleted"))


@query(f"""WITH {_GRANT_SQL}, a AS (SELECT kb_id, list_position(['READ','WRITE','ADMIN'], permission) AS l FROM g WHERE (subject_type = 'USER' AND subject_id = '8') OR (subject_type = 'DEPARTMENT' AND subject_id = 'BUILDING')
UNION ALL SELECT id, 1 FROM k WHERE is_public) SELECT kb_id, ['READ','WRITE','ADMIN'][max(l)] AS permission FROM a JOIN k ON k.id = a.kb_id AND NOT k.is_deleted GROUP BY kb_id""")
def accessible_kbs(spark, sf_dir):
    return L.accessible(_kbs(spark, sf_dir), _grants(spark, sf_dir), 8, "BUILDING")


def _requests(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key, (key % 50).alias("user_id"), F.col("c_mktsegment").alias("dept_id"), F.when(key % 10 == 0, "admin").otherwise("user").alias("role"), (key % 25).cast("int").alias("kb_id"))


_ASK_SQL = "r AS (SELECT c_custkey, CAST(c_custkey % 50 AS VARCHAR) AS u, c_mktsegment AS d, c_custkey % 10 = 0 AS adm, c_custkey % 25 AS kb_id FROM customer)"
_HAS = "EXISTS (SELECT 1 FROM g WHERE g.kb_id = r.kb_id AND ((subject_type = 'USER' AND subject_id = u) OR (subject_type = 'DEPARTMENT' AND subject_id = d)){0})"


@query(f"WITH {_GRANT_SQL}, {_ASK_SQL} SELECT c_custkey, adm OR kb_id % 6 = 0 OR {_HAS.replace('{0}', '')} AS allowed FROM r")
def may_read(spark, sf_dir):
    return L.may_read(_requests(spark, sf_dir), _kbs(spark, sf_dir), _grants(spark, sf_dir)).select("c_custkey", "allowed")


@query(f"WITH {_GRANT_SQL}, {_ASK_SQL} SELECT c_custkey, adm OR {_HAS.replace('{0}', chr(32) + 'AND permission <> ' + chr(39) + 'READ' + chr(39))} AS allowed FROM r")
def may_write(spark, sf_dir):
    return L.may_write(_requests(spark, sf_dir), _grants(spark, sf_dir)).select("c_custkey", "allowed")


# --- tasks and versions ---


@query("""SELECT c_custkey, o_orderstatus AS task_status, coalesce(o_orderkey % 4, 0) AS retry_count FROM customer LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def latest_task(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"), F.col("o_orderdate").alias("created_at"))
    return L.index_status(docs, tasks).select(F.col("doc_id").alias("c_custkey"), "task_status", "retry_count")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)")
def version_supersede(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("doc_version"), "l_partkey")
    return L.latest_versions(rows).select(F.col("doc_id").alias("l_orderkey"), F.col("doc_version").alias("l_linenumber"), "l_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return L.without_documents(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber"), gone).select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id % 11 = 0 AS is_deleted FROM documents")
def soft_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 11 == 0).alias("is_deleted"))
    return L.soft_delete(rows, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@query("""SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN l.doc_id IS NULL THEN 'DONE' ELSE 'PENDING' END AS status,
CASE WHEN l.doc_id IS NULL THEN 'old' END AS error_msg FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0""")
def reindex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("version"), F.lit("DONE").alias("status"), F.lit("old").alias("error_msg"))
    return L.reindexed(docs, table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id")))


@query("SELECT o_orderkey AS id, o_orderkey % 5 + 1 AS retry_count, CAST(power(2, o_orderkey % 5) AS INTEGER) AS delay_seconds FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 3")
def retry_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("DONE").alias("status"), (F.col("o_orderkey") % 5).alias("retry_count"), F.lit(3).alias("max_retry"))
    return L.retried(tasks).select("id", "retry_count", "delay_seconds")


@query("SELECT d.doc_id AS id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.lang) AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patch_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return L.patched(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "flagged").alias("lang")))


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'seed' ELSE d.source END AS name FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) d FULL OUTER JOIN labels l USING (doc_id)""")
def seed_upsert(spark, sf_dir):
    have = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return L.seeded(have, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("seed").alias("name")), ["id"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NOT NULL THEN d.source ELSE 'seed' END AS name FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) d FULL OUTER JOIN labels l USING (doc_id)""")
def seed_if_absent(spark, sf_dir):
    have = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return L.seeded(have, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("seed").alias("name")), ["id"], overwrite=False)


@query("SELECT lang AS status, count(*) AS n FROM documents GROUP BY lang")
def count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS chunk_count, CAST(sum(l_linenumber) AS BIGINT) AS token_count FROM lineitem GROUP BY l_orderkey")
def document_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunk_count"), F.sum("l_linenumber").cast("long").alias("token_count"))


# --- chats ---


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM
(SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)""")
def history_tail(spark, sf_dir):
    return L.history(_messages(spark, sf_dir)).select(F.col("session_id").alias("conv_id"), F.col("id").alias("turn"), "position")


@query("""SELECT conv_id, CAST(count(*) AS INTEGER) AS message_count, substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 50) AS title, max(turn) AS last_active_at FROM conversations GROUP BY conv_id""")
def chat_sessions(spark, sf_dir):
    return L.sessions(_messages(spark, sf_dir)).withColumnRenamed("session_id", "conv_id")


@query("SELECT user_id AS message_id, event_type AS user_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def feedback_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_type").alias("user_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return L.latest_feedback(rows).select("message_id", "user_id", "id")


@query("""SELECT c.conv_id AS id, coalesce(e.f, 0) AS feedback FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN
(SELECT user_id, event_id % 3 - 1 AS f FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON e.user_id = c.conv_id""")
def mirrored_feedback(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("feedback", F.lit(0).cast("long"))
    given = table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 - 1).alias("feedback"))
    return L.with_feedback(messages, given)


_EDGES_SQL = "SELECT l_partkey AS s, l_suppkey AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'CITES' ELSE 'EXTENDS' END AS relation_type FROM lineitem WHERE l_returnflag <> 'R'"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_paper_id"), F.col("l_suppkey").alias("target_paper_id"), F.when(F.col("l_linenumber") % 2 == 0, "CITES").otherwise("EXTENDS").alias("relation_type"), (F.col("l_returnflag") == "R").alias("is_deleted"))


@query(f"SELECT s AS paper_id, t AS other_id, relation_type FROM ({_EDGES_SQL})")
def relations_out(spark, sf_dir):
    return L.relations(_edges(spark, sf_dir))


@query(f"SELECT t AS paper_id, s AS other_id, relation_type FROM ({_EDGES_SQL})")
def relations_in(spark, sf_dir):
    return L.relations(_edges(spark, sf_dir), incoming=True)


# --- notes, rights on documents, messages, datasets ---

_KB_DOCS = """k AS (SELECT doc_id AS id, doc_id % 4 AS kb_id, source || '.pdf' AS file_name, n_chars AS file_size, 1 + doc_id % 3 AS version, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'DONE' END AS status,
CASE WHEN doc_id % 5 = 0 THEN 'why' END AS error_msg, 'kb/' || (doc_id % 4) || '/' || doc_id AS path, doc_id % 11 = 0 AS is_deleted FROM documents)"""


def _documents(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), (d % 4).alias("kb_id"), F.concat("source", F.lit(".pdf")).alias("file_name"), F.col("n_chars").alias("file_size"), (d % 3 + 1).alias("version"),
        F.when(d % 5 == 0, "FAILED").otherwise("DONE").alias("status"), F.when(d % 5 == 0, "why").alias("error_msg"),
        F.concat(F.lit("kb/"), (d % 4).cast("string"), F.lit("/"), d.cast("string")).alias("path"), (d % 11 == 0).alias("is_deleted"),
    )


@query("SELECT conv_id * 100 + turn AS id, conv_id AS paper_id, text AS content FROM conversations WHERE turn % 4 <> 3")
def notes_of_papers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("paper_id"), F.col("text").alias("content"), F.col("turn").alias("updated_at"), (F.col("turn") % 4 == 3).alias("is_deleted"))
    return L.notes(rows).select("id", "paper_id", "content")


@query(f"WITH {_KB_DOCS} SELECT id, file_name, status FROM k WHERE kb_id = 1 AND NOT is_deleted")
def documents_of_kb(spark, sf_dir):
    return L.documents_of(_documents(spark, sf_dir), 1).select("id", "file_name", "status")


@query(f"WITH {_KB_DOCS} SELECT l.doc_id, l.quality AS kb_id, EXISTS (SELECT 1 FROM k WHERE k.id = l.doc_id AND k.kb_id = l.quality AND NOT is_deleted) AS allowed FROM labels l")
def document_in_kb(spark, sf_dir):
    asked = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("kb_id"))
    return L.belongs(asked, _documents(spark, sf_dir)).withColumn("kb_id", F.col("kb_id").cast("int"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM conversations WHERE conv_id % 7 = 3")
def messages_of_owner(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.col("conv_id") % 7).alias("user_id")).distinct().withColumn("is_deleted", F.lit(None).cast("boolean"))
    return L.messages_for(_messages(spark, sf_dir), chats, 3).select(F.col("session_id").alias("conv_id"), F.col("id").alias("turn"), "role", "position")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def chunks_by_document(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("doc_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return L.chunks_by(rows, wanted, "doc_id").withColumnRenamed("doc_id", "l_orderkey")


@query("SELECT item_id, text FROM benchmark WHERE item_id % 4 = 2")
def questions_of_kb(spark, sf_dir):
    return L.of_kb(table(spark, sf_dir, "benchmark").withColumn("kb_id", F.col("item_id") % 4), 2).drop("kb_id")


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> 7")
def grants_without_kb(spark, sf_dir):
    return L.without_kb(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("kb_id")), 7).select("c_custkey")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2 AND n_nationkey % 10 <> 9")
def kbs_of_department(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("department_id"), (F.col("n_nationkey") % 10 == 9).alias("is_deleted"))
    return L.of_department(rows, "2").select("id")


@query("SELECT max(n_nationkey) + 1 AS id, 'Default' AS name FROM nation")
def default_kb_made(spark, sf_dir):
    """All knowledge bases are deleted, so a default one is made after them."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(False).alias("is_public"), F.lit(1).cast("long").alias("created_by"), F.lit(True).alias("is_deleted"))
    return L.default_kb(L.with_default(rows, "Default", 1)).select("id", "name")


# --- uploads, replacement, deletion, turns ---


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-30 12:30:00'")


@query("""SELECT page_id AS id, page_id % 4 AS kb_id, url || '.pdf' AS file_name, 'kb/' || (page_id % 4) || '/' || substr(md5((page_id % 4) || '/' || url || '.pdf'), 1, 8) || '-' || url || '.pdf' AS path, 'PENDING' AS status, 1 AS version FROM pages WHERE page_id % 3 = 0""")
def upload_records(spark, sf_dir):
    """A third of the pages come as PDF files; the others are turned away."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url"))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 4).alias("kb_id"), url.alias("file_name"), F.length("html").cast("long").alias("file_size"), F.lit(1).cast("long").alias("uploaded_by"))
    return L.document_records(files, _now())[0].select("id", "kb_id", "file_name", "path", "status", "version")


@query(f"""WITH {_KB_DOCS}, r AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT id, CASE WHEN r.doc_id IS NOT NULL AND NOT is_deleted THEN 'new-' || id || '.pdf' ELSE file_name END AS file_name,
CASE WHEN r.doc_id IS NOT NULL AND NOT is_deleted THEN version + 1 ELSE version END AS version, CASE WHEN r.doc_id IS NOT NULL AND NOT is_deleted THEN 'PENDING' ELSE status END AS status,
CASE WHEN r.doc_id IS NULL OR is_deleted THEN error_msg END AS error_msg FROM k LEFT JOIN r ON r.doc_id = id""")
def replace_content(spark, sf_dir):
    files = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"), F.format_string("new-%d.pdf", "doc_id").alias("file_name"), F.lit(5).cast("long").alias("file_size"))
    return L.replaced(_documents(spark, sf_dir), files, _now())[0].select("id", "file_name", "version", "status", "error_msg")


@query(f"WITH {_KB_DOCS} SELECT path FROM k WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def files_of_deleted_documents(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return L.deleted_documents(_documents(spark, sf_dir), chunks, gone)[2]


@query("""SELECT conv_id AS id, CAST(5 + count(*) AS INTEGER) AS message_count, CASE WHEN conv_id % 2 = 0 THEN 'old' ELSE substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 50) END AS title, greatest(3, max(turn)) AS last_active_at FROM conversations GROUP BY conv_id""")
def sessions_after_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"), F.lit(0).alias("position"))
    chats = turns.select(F.col("session_id").alias("id")).distinct().select("id", F.lit(5).alias("message_count"), F.when(F.col("id") % 2 == 0, "old").alias("title"), F.lit(3).cast("long").alias("last_active_at"))
    return L.after_turns(chats, turns)


@query("""SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 10 = 0 THEN c_custkey || '-s' END AS session_id, NOT (c_custkey % 3 = 0 OR c_custkey % 10 = 0) AS is_new FROM customer""")
def session_get_or_create(spark, sf_dir):
    """Every customer asks for a session; a third own theirs, others but admins get a new one, whose id is left out here."""
    key = F.col("c_custkey")
    sid = F.concat(key.cast("string"), F.lit("-s"))
    rows = table(spark, sf_dir, "customer")
    chats = rows.select(sid.alias("id"), F.when(key % 3 == 0, key).otherwise(key + 1).alias("user_id"), F.lit(False).alias("is_deleted"))
    asked = rows.select(key.alias("ask_id"), key.alias("user_id"), F.when(key % 10 == 0, "admin").otherwise("user").alias("role"), sid.alias("session_id"), F.array(F.lit(1)).alias("kb_ids"))
    out, _ = L.sessions_for(asked, chats, _now())
    return out.select("ask_id", F.when(~F.col("is_new"), F.col("session_id")).alias("session_id"), "is_new")


@query("SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_linenumber <> 2 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 2 = 0)")
def relations_left(spark, sf_dir):
    """Relations are taken back only by requests that name their source."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    edges = rows.select("l_orderkey", "l_linenumber", key.alias("id"), F.col("l_suppkey").alias("source_paper_id"), F.lit(False).alias("is_deleted"))
    asked = rows.filter("l_linenumber = 2").select(key.alias("id"), (F.col("l_suppkey") + F.col("l_suppkey") % 2).alias("source_paper_id"))
    return L.present(L.without_relations(edges, asked)[0]).select(F.col("l_orderkey").alias("id"), "l_linenumber")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'PENDING' WHEN doc_id % 3 = 1 AND trim(text) <> '' THEN 'DONE' WHEN doc_id % 3 = 1 THEN 'FAILED' ELSE 'DONE' END AS status,
CAST(CASE WHEN doc_id % 3 = 1 THEN CASE WHEN trim(text) <> '' THEN length(text) - length(replace(text, chr(10), '')) + 1 END ELSE -1 END AS INTEGER) AS chunk_count FROM documents""")
def index_states(spark, sf_dir):
    """After a run over a third of the documents, whose chunks are the lines of their texts."""
    d = F.col("doc_id")
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(
        d.alias("id"), F.when(d % 3 == 0, "PENDING").when(d % 3 == 1, "PROCESSING").otherwise("DONE").alias("status"), F.lit(-1).alias("chunk_count"), F.lit(-1).alias("token_count"), none.alias("indexed_at"), none.alias("error_msg"), F.col("text"),
    )
    lines = docs.filter("status = 'PROCESSING'").filter(~T.is_blank(F.col("text"))).select(F.col("id").alias("doc_id"), F.explode(F.split("text", "\n")).alias("content"), F.lit(1).alias("token_count"))
    tasks = docs.select(F.col("id"), F.col("id").alias("doc_id"), F.lit("RUNNING").alias("status"), none.alias("error_msg"), none.alias("finished_at"))
    return index.finished(docs.drop("text"), tasks, lines, F.lit("now"))[0].select("id", "status", "chunk_count")


# --- token meter ---

FIELDS = ("click", "view", "purchase")


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("field"), F.floor("value").cast("long").alias("tokens"))


_E = "e AS (SELECT user_id, ts, event_type AS field, CAST(floor(value) AS BIGINT) AS tokens FROM events)"
_AT = "TIMESTAMP '2024-01-30 12:30:00'"


def _as_of():
    return F.expr("TIMESTAMP_NTZ '2024-01-30 12:30:00'")


@query(f"WITH {_E} SELECT user_id, field, strftime(date_trunc('hour', ts), '%Y%m%d%H') AS hour, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL")
def token_rollup_hour(spark, sf_dir):
    return meter.hourly(_events(spark, sf_dir)).withColumn("hour", F.date_format("hour", "yyyyMMddHH"))


@query(f"WITH {_E} SELECT user_id, strftime(ts, '%Y%m%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL")
def token_rollup_day(spark, sf_dir):
    return meter.daily(meter.hourly(_events(spark, sf_dir))).withColumn("day", F.date_format("day", "yyyyMMdd"))


@query(f"WITH {_E} SELECT user_id, CAST(sum(tokens) AS BIGINT) AS total FROM e WHERE date_trunc('day', ts) <= date_trunc('day', {_AT}::TIMESTAMP + INTERVAL 20 DAY) - INTERVAL 30 DAY GROUP BY user_id")
def token_archive(spark, sf_dir):
    return meter.archived(meter.daily(meter.hourly(_events(spark, sf_dir))), _as_of() + F.make_dt_interval(F.lit(20)))


_STATS = f"""WITH {_E} SELECT user_id, {', '.join(f"CAST(coalesce(sum(tokens) FILTER (WHERE field = '{f}' AND ts >= {_AT} - INTERVAL 7 DAY AND ts <= {_AT}), 0) AS BIGINT) AS {f}_7d" for f in FIELDS)},
CAST(coalesce(sum(tokens) FILTER (WHERE {{0}} AND date_trunc('day', ts) > date_trunc('day', {_AT}) - INTERVAL 30 DAY), 0) AS BIGINT) AS days_7_to_30,
CAST(coalesce(sum(tokens) FILTER (WHERE date_trunc('day', ts) <= date_trunc('day', {_AT}) - INTERVAL 30 DAY), 0) AS BIGINT) AS archived FROM e GROUP BY user_id"""


@query(_STATS.replace("{0}", f"ts < {_AT} - INTERVAL 7 DAY"))
def token_stats(spark, sf_dir):
    return meter.stats(_events(spark, sf_dir), _as_of(), FIELDS)


@query(_STATS.replace("{0}", f"date_trunc('day', ts) <= date_trunc('day', {_AT} - INTERVAL 7 DAY)"))
def token_stats_compat(spark, sf_dir):
    return meter.stats(_events(spark, sf_dir), _as_of(), FIELDS, compat=True)


@query(f"WITH {_E} SELECT user_id, floor((sum(tokens) * 0.0007::DOUBLE + count(*) * 0.0008::DOUBLE + max(tokens) * 0.002::DOUBLE) / 1000.0::DOUBLE * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS cost FROM e GROUP BY user_id")
def cost_estimate(spark, sf_dir):
    sums = _events(spark, sf_dir).groupBy("user_id").agg(F.sum("tokens").alias("a"), F.count("*").alias("b"), F.max("tokens").alias("c"))
    return sums.select("user_id", meter.cost(F.col("a"), F.col("b"), F.col("c")).alias("cost"))


@query("SELECT DISTINCT user_id FROM events")
def active_users(spark, sf_dir):
    return meter.active_users(_events(spark, sf_dir))


@query(f"WITH {_E} SELECT user_id, field, CAST(sum(tokens) AS BIGINT) AS tokens FROM e WHERE ts >= {_AT} - INTERVAL 8 DAY GROUP BY ALL")
def token_retention(spark, sf_dir):
    rows = meter.retained(_events(spark, sf_dir), "ts", _as_of(), meter.HOURS_KEPT)
    return rows.groupBy("user_id", "field").agg(F.sum("tokens").cast("long").alias("tokens"))


@query(f"""WITH {_E}, h AS (SELECT user_id, date_trunc('hour', ts) AS hour, sum(tokens) AS tokens FROM e GROUP BY ALL), d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, 1000 AS tokens FROM e),
n AS (SELECT user_id, date_trunc('day', hour) AS day, tokens FROM h WHERE hour = TIMESTAMP '2024-01-30 12:00:00' AND user_id % 2 = 1), b AS (SELECT * FROM d UNION ALL SELECT * FROM n)
SELECT user_id, strftime(day, '%Y%m%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY ALL""")
def token_compaction(spark, sf_dir):
    """An hour goes into the day counters of users for whom it is not done yet."""
    events = _events(spark, sf_dir)
    hours = meter.hourly(events)
    days = events.select("user_id", F.date_trunc("day", "ts").alias("day")).distinct().withColumn("tokens", F.lit(1000).cast("long"))
    done = hours.filter("user_id % 2 = 0").select("user_id", "hour").distinct()
    return meter.compacted(hours, days, done, _as_of())[0].withColumn("day", F.date_format("day", "yyyyMMdd"))
