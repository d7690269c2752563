"""The relational side: lists, permissions, tasks, chats, and changes as functions from tables to tables.

Nothing here updates in place. A change takes the present rows and gives the next ones; sources.store writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import metadata, parse
from paperloom.sources.schema import CHOICES, schema
from paperloom.sources.store import file_path

LEVELS = {"READ": 1, "WRITE": 2, "ADMIN": 3}


# --- filters and lists ---


def present(rows: DataFrame, null_is_present: bool = False) -> DataFrame:
    """Rows not deleted. A null flag counts as deleted, as in SQL, or as present if asked."""
    flag = F.coalesce("is_deleted", F.lit(False)) if null_is_present else F.col("is_deleted")
    return rows.filter(~flag)


def newest_first(rows: DataFrame, by: str = "updated_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by), key)


def papers(rows: DataFrame, kb_id: int | None = None, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """Papers by one criterion: keyword in the title, else status, else knowledge base, else all; newest first."""
    kept = present(rows)
    if keyword and keyword.strip():
        kept = kept.filter(F.lower("title").contains(keyword.strip().lower()))
    elif status and status.strip():
        kept = kept.filter(F.col("reading_status") == status.strip().upper())
    elif kb_id is not None:
        kept = kept.filter(F.col("kb_id") == kb_id)
    return newest_first(kept)


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def choice(value: Column, kind: str, default: str | None = None) -> Column:
    """A stripped upper-case value of a set; the default where it is blank; an error for anything else."""
    own = F.upper(T.strip(value))
    known = F.when(own.isin(*CHOICES[kind]), own).otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind}: "), F.coalesce(value, F.lit("null")))))
    return F.when(T.is_blank(value), F.lit(default)).otherwise(known)


def valid(rows: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose column is blank or a known value, the others)."""
    good = T.is_blank(F.col(column)) | F.upper(T.strip(F.col(column))).isin(*CHOICES[kind])
    return rows.filter(good), rows.filter(~good)


# --- permissions ---


def accessible(kbs: DataFrame, grants: DataFrame, user_id: int, dept_id: str | None = None, role: str = "user") -> DataFrame:
    """(kb_id, permission) that a user has: the highest of own, department and public rights; ADMIN everywhere for an admin."""
    live = present(kbs).select(F.col("id").alias("kb_id"), "is_public")
    names = F.array(*map(F.lit, LEVELS))
    if role.upper() == "ADMIN":
        return live.select("kb_id", F.lit("ADMIN").alias("permission"))
    level = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("permission")).alias("level")
    own = (F.col("subject_type") == "USER") & (F.col("subject_id") == str(user_id))
    if dept_id is not None:
        own = own | ((F.col("subject_type") == "DEPARTMENT") & (F.col("subject_id") == dept_id))
    every = grants.filter(own).select("kb_id", level).unionByName(live.filter("is_public").select("kb_id", F.lit(1).alias("level")))
    best = every.groupBy("kb_id").agg(F.max("level").alias("level")).join(live.select("kb_id"), "kb_id", "left_semi")
    return best.select("kb_id", F.element_at(names, F.col("level")).alias("permission"))


def may_read(asked: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """asked (user_id, dept_id, role, kb_id) with allowed: admin, a public knowledge base, or any grant."""
    open_kbs = kbs.filter("is_public").select(F.col("id").alias("kb_id")).withColumn("_open", F.lit(True))
    return _allowed(asked.join(open_kbs, "kb_id", "left"), grants, F.coalesce("_open", F.lit(False))).drop("_open")


def may_write(asked: DataFrame, grants: DataFrame) -> DataFrame:
    """The same for writing: admin, or a grant of WRITE or ADMIN; publicity is not enough."""
    return _allowed(asked, grants.filter(F.col("permission").isin("WRITE", "ADMIN")), F.lit(False))


def _allowed(asked: DataFrame, grants: DataFrame, otherwise: Column) -> DataFrame:
    given = grants.select("kb_id", "subject_type", "subject_id").distinct()
    user = given.filter("subject_type = 'USER'").select("kb_id", F.col("subject_id").alias("_u"), F.lit(True).alias("_by_user"))
    dept = given.filter("subject_type = 'DEPARTMENT'").select("kb_id", F.col("subject_id").alias("_d"), F.lit(True).alias("_by_dept"))
    named = asked.withColumns({"_u": F.col("user_id").cast("string"), "_d": F.col("dept_id")})
    named = named.join(user, ["kb_id", "_u"], "left").join(dept, ["kb_id", "_d"], "left")
    yes = (F.upper("role") == "ADMIN") | otherwise | F.col("_by_user").isNotNull() | F.col("_by_dept").isNotNull()
    return named.withColumn("allowed", F.coalesce(yes, F.lit(False))).drop("_u", "_d", "_by_user", "_by_dept")


# --- tasks and documents ---


def index_status(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents with their latest task."""
    last = first_by(tasks, ["doc_id"], F.desc("created_at"), F.desc("id")).select("doc_id", F.col("status").alias("task_status"), "retry_count")
    return documents.join(last, "doc_id", "left").withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))


def latest_versions(chunks: DataFrame) -> DataFrame:
    """Chunks of each document's highest version."""
    top = F.max("doc_version").over(Window.partitionBy("doc_id"))
    return chunks.withColumn("_top", top).filter("doc_version = _top").drop("_top")


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("doc_id"), "doc_id", "left_anti")


def soft_delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = ids.select(F.col(key).alias("_id")).distinct().withColumn("_gone", F.lit(True))
    out = rows.join(gone, F.col(key) == F.col("_id"), "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted"))
    return out.select(*rows.columns)


def reindexed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with the next version, pending and without an error, where their id is asked for."""
    asked = ids.select("id").distinct().withColumn("_again", F.lit(True))
    again = F.col("_again").isNotNull()
    out = documents.join(asked, "id", "left").withColumns(
        {
            "version": F.when(again, F.col("version") + 1).otherwise(F.col("version")),
            "status": F.when(again, "PENDING").otherwise(F.col("status")),
            "error_msg": F.when(~again, F.col("error_msg")),
        }
    )
    return out.select(*documents.columns)


def retried(tasks: DataFrame) -> DataFrame:
    """Failed tasks with a retry left, counted up, with delay_seconds 1, 2, 4 before the next run."""
    can = tasks.filter("status = 'FAILED' AND retry_count < max_retry").withColumn("retry_count", F.col("retry_count") + 1)
    return can.withColumns({"status": F.lit("PENDING"), "delay_seconds": F.pow(F.lit(2), F.col("retry_count") - 1).cast("int")})


def patched(rows: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """rows where a patch row's non-null fields take the place of theirs."""
    names = [c for c in patch.columns if c != key]
    given = patch.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_{c}") for c in names])
    out = rows.join(given, F.col(key) == F.col("_id"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names})
    return out.select(*rows.columns)


def seeded(present_rows: DataFrame, seeds: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Union by key: a seed replaces the present row, or gives way to it."""
    both = present_rows.withColumn("_rank", F.lit(1)).unionByName(seeds.withColumn("_rank", F.lit(0 if overwrite else 2)))
    return first_by(both, keys, F.col("_rank")).drop("_rank")


def created(kbs: DataFrame, grants: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(knowledge bases with the new ones, grants with ADMIN for each creator)."""
    own = new.select(F.col("id").alias("kb_id"), F.lit("USER").alias("subject_type"), F.col("created_by").cast("string").alias("subject_id"), F.lit("ADMIN").alias("permission"))
    return kbs.unionByName(new, allowMissingColumns=True), grants.unionByName(own, allowMissingColumns=True)


# --- chats and feedback ---


def history(messages: DataFrame, last: int = 10) -> DataFrame:
    """The last messages of each session, with position ascending from 1."""
    back = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= last)
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return kept.withColumn("position", F.row_number().over(order).cast("int")).drop("_back")


def sessions(messages: DataFrame) -> DataFrame:
    """(session_id, message_count, title, last_active_at): the title is the first user message's first 50 characters."""
    asked = F.when(F.upper("role") == "USER", F.struct("created_at", "id", F.substring("content", 1, 50).alias("title")))
    return messages.groupBy("session_id").agg(
        F.count("*").cast("int").alias("message_count"), F.min(asked)["title"].alias("title"), F.max("created_at").alias("last_active_at")
    )


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One row for each (message, user), the last given."""
    return first_by(feedback, ["message_id", "user_id"], F.desc("created_at"), F.desc("id"))


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """messages with the feedback last written to each, whoever gave it."""
    last = first_by(feedback, ["message_id"], F.desc("created_at"), F.desc("id")).select(F.col("message_id").alias("id"), F.col("feedback").alias("_f"))
    return messages.join(last, "id", "left").withColumn("feedback", F.coalesce("_f", "feedback")).drop("_f")


def relations(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(paper_id, other_id, relation_type): one hop along or against the edges present."""
    own, other = ("target_paper_id", "source_paper_id") if incoming else ("source_paper_id", "target_paper_id")
    return present(edges).select(F.col(own).alias("paper_id"), F.col(other).alias("other_id"), "relation_type")


# --- notes, documents, messages, datasets: lists and rights ---

#: What a reader sees of a stored row.
VIEWS = {"paper": "is_deleted", "paper_note": "is_deleted", "paper_relation": "is_deleted", "knowledge_base": "is_deleted"}


def view(rows: DataFrame, table: str) -> DataFrame:
    """Present rows with the columns that a reader sees: those of the schema but the flag, in its order."""
    return present(rows).select(*[f.name for f in schema(table) if f.name != VIEWS[table]])


def notes(rows: DataFrame, paper_id: int | None = None) -> DataFrame:
    """Notes of a paper, or of all papers, the last changed first."""
    kept = present(rows)
    return newest_first(kept if paper_id is None else kept.filter(F.col("paper_id") == paper_id))


def documents_of(rows: DataFrame, kb_id: int) -> DataFrame:
    return present(rows).filter(F.col("kb_id") == kb_id)


def belongs(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked (kb_id, doc_id) with allowed: the document is present and in that knowledge base."""
    own = present(documents).select("kb_id", F.col("id").alias("doc_id"), F.lit(True).alias("_in")).dropDuplicates()
    return asked.join(own, ["kb_id", "doc_id"], "left").withColumn("allowed", F.coalesce("_in", F.lit(False))).drop("_in")


def messages_for(messages: DataFrame, chats: DataFrame, user_id: int, role: str = "user") -> DataFrame:
    """Messages of the sessions that a user owns, or of all for an admin, with position ascending from 1."""
    own = present(chats, null_is_present=True)
    own = own if role.upper() == "ADMIN" else own.filter(F.col("user_id") == user_id)
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return messages.join(own.select(F.col("id").alias("session_id")), "session_id", "left_semi").withColumn("position", F.row_number().over(order).cast("int"))


def chunks_by(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose chunk_id, doc_id or kb_id is among ids."""
    return chunks.join(ids.select(key).dropDuplicates(), key, "left_semi")


def of_kb(rows: DataFrame, kb_id: int) -> DataFrame:
    """Rows of a knowledge base: eval questions, grants, chunks."""
    return rows.filter(F.col("kb_id") == kb_id)


def without_kb(rows: DataFrame, kb_id: int) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("kb_id") == kb_id, F.lit(False)))


def of_department(kbs: DataFrame, department_id: str) -> DataFrame:
    return present(kbs).filter(F.col("department_id") == department_id)


def with_default(kbs: DataFrame, name: str, created_by: int) -> DataFrame:
    """Knowledge bases with a default one, numbered after all others, where none is present."""
    state = kbs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max((~F.col("is_deleted")).cast("int")), F.lit(0)).alias("any"))
    made = state.filter("any = 0").select((F.col("top") + 1).alias("id"), F.lit(name).alias("name"), F.lit(False).alias("is_public"), F.lit(created_by).cast("long").alias("created_by"), F.lit(False).alias("is_deleted"))
    return kbs.unionByName(made, allowMissingColumns=True)


def default_kb(kbs: DataFrame) -> DataFrame:
    """The first present knowledge base by id."""
    return present(kbs).orderBy("id").limit(1)


# --- uploads, deletion, replacement ---


def document_records(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(document rows to append, rejected files) of files (id, kb_id, file_name, file_size, uploaded_by); only PDF files become documents."""
    marked = parse.by_type(files)
    rows = marked.filter("success").select(
        "id", "kb_id", "file_name", F.lit("pdf").alias("file_type"), "file_size", file_path(F.col("kb_id"), F.col("file_name")).alias("path"), F.lit("PENDING").alias("status"),
        F.lit(1).alias("version"), "uploaded_by", now.alias("uploaded_at"), F.lit(False).alias("is_deleted"),
    )
    return rows, marked.filter("NOT success").select("id", "file_name", "error_msg")


def tasks_for(documents: DataFrame, kind: str, now: Column, max_retry: int = 3) -> DataFrame:
    """An index task for each document; its id is a hash of document, version and kind, so a rerun makes the same one."""
    return documents.select(
        F.xxhash64("id", "version", F.lit(kind)).alias("id"), F.col("id").alias("doc_id"), F.lit(kind).alias("task_type"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(max_retry).alias("max_retry"), now.alias("created_at"),
    )


def uploaded(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, tasks, rejected files)."""
    rows, rejected = document_records(files, now)
    return rows, tasks_for(rows, "INDEX", now), rejected


def uploaded_papers(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, tasks, papers, rejected files) of files that also have any paper fields; a paper's title is given or comes from its file."""
    rows, tasks, rejected = uploaded(files, now)
    given = {f.name for f in schema("paper")} - {"id", "kb_id", "doc_id", "title", "created_by", "created_at", "updated_at", "is_deleted", "reading_status"}
    title = F.col("title") if "title" in files.columns else F.lit(None).cast("string")
    papers = files.join(rows.select("id"), "id", "left_semi").select(
        "id", "kb_id", F.col("id").alias("doc_id"), metadata.default_title(title, F.col("file_name")).alias("title"), *[c for c in files.columns if c in given],
        F.lit("UNREAD").alias("reading_status"), F.col("uploaded_by").alias("created_by"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("is_deleted"),
    )
    return rows, tasks, papers, rejected


def deleted_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with those of ids flagged, chunks without theirs, paths of files to remove)."""
    gone = ids.select("id").dropDuplicates()
    paths = documents.join(gone, "id", "left_semi").select("path")
    return soft_delete(documents, gone), without_documents(chunks, gone.select(F.col("id").alias("doc_id"))), paths


def replaced(documents: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with new content, tasks, paths of the old files) for files (id, file_name, file_size): the next version, pending, without an error."""
    good = parse.by_type(files).filter("success").select(F.col("id"), F.col("file_name").alias("_name"), F.col("file_size").alias("_size"))
    live = present(documents).join(good, "id", "left_semi")
    new = documents.join(good, "id", "left").withColumn("_new", F.col("_name").isNotNull() & ~F.coalesce("is_deleted", F.lit(True)))
    use = lambda value, old: F.when(F.col("_new"), value).otherwise(F.col(old))
    out = new.withColumns(
        {
            "path": use(file_path(F.col("kb_id"), F.concat_ws("/", (F.col("version") + 1).cast("string"), "_name")), "path"), "file_name": use(F.col("_name"), "file_name"),
            "file_size": use(F.col("_size"), "file_size"), "version": use(F.col("version") + 1, "version"), "status": use(F.lit("PENDING"), "status"), "error_msg": F.when(~F.col("_new"), F.col("error_msg")),
        }
    ).select(*documents.columns)
    return out, tasks_for(out.join(live.select("id"), "id", "left_semi"), "REINDEX", now), live.select("path")


# --- papers' notes and relations, datasets ---


def added(rows: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """rows and new ones, stamped and present."""
    stamped = new.withColumns({c: now for c in ("created_at", "updated_at") if c in rows.columns} | ({"is_deleted": F.lit(False)} if "is_deleted" in rows.columns else {}))
    return rows.unionByName(stamped.select(*[c for c in rows.columns if c in stamped.columns]), allowMissingColumns=True).select(*rows.columns)


def without_relations(relations_: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with those asked for flagged, requests refused): asked (id, source_paper_id) must name the relation's own source."""
    live = present(relations_).select("id", "source_paper_id")
    ok = asked.join(live, ["id", "source_paper_id"], "left_semi")
    return soft_delete(relations_, ok), asked.join(live, ["id", "source_paper_id"], "left_anti")


def without_rows(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


# --- chats ---


def sessions_for(asked: DataFrame, chats: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(asked with the session to use, sessions to append).

    asked: ask_id, user_id, role, session_id or null, kb_ids. A session of one's own, or any for an admin, is used; else one is made, whose
    id is a hash of user, request and time, so a rerun makes the same one.
    """
    live = present(chats, null_is_present=True).select(F.col("id").alias("session_id"), F.col("user_id").alias("_owner"))
    joined = asked.join(live, "session_id", "left")
    mine = F.col("_owner").isNotNull() & ((F.col("_owner") == F.col("user_id")) | (F.upper("role") == "ADMIN"))
    made = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("ask_id").cast("string"), now.cast("string")).cast("binary"))
    out = joined.withColumns({"is_new": ~F.coalesce(mine, F.lit(False)), "session_id": F.when(mine, F.col("session_id")).otherwise(made)}).drop("_owner")
    new = out.filter("is_new").select(
        F.col("session_id").alias("id"), "user_id", F.to_json("kb_ids").alias("kb_ids"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("message_count"),
        now.alias("created_at"), now.alias("last_active_at"), F.lit(False).alias("is_deleted"),
    )
    return out, new


def after_turns(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions after new messages (session_id, role, content, created_at, position): counted on, dated, and titled if they had no title."""
    asked = F.when(F.lower("role") == "user", F.struct("created_at", "position", F.substring("content", 1, 50).alias("title")))
    new = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").cast("int").alias("_n"), F.min(asked)["title"].alias("_title"), F.max("created_at").alias("_at"))
    out = chats.join(new, "id", "left").withColumns(
        {"message_count": F.col("message_count") + F.coalesce("_n", F.lit(0)), "title": F.coalesce("title", "_title"), "last_active_at": F.greatest("last_active_at", "_at")}
    )
    return out.select(*chats.columns)
