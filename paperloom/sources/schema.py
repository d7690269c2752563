"""Schemas of the stored tables, and what each may hold."""

from __future__ import annotations

from pyspark.sql.types import StructType

_TABLES = {
    "knowledge_base": "id long, name string, description string, department_id string, is_public boolean, created_by long, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, is_deleted boolean",
    "permission": "id long, kb_id long, subject_type string, subject_id string, permission string, granted_by long, granted_at timestamp_ntz",
    "document": "id long, kb_id long, file_name string, file_type string, file_size long, path string, status string, error_msg string, "
    "chunk_count int, token_count int, version int, uploaded_by long, uploaded_at timestamp_ntz, indexed_at timestamp_ntz, is_deleted boolean",
    "chunk": "chunk_id long, doc_id long, kb_id long, paper_id long, chunk_index int, content string, raw_content string, table_caption string, "
    "embedding array<float>, page_num int, section_title string, section_type string, content_type string, token_count int, doc_version int, "
    "created_at timestamp_ntz",
    "index_task": "id long, doc_id long, task_type string, status string, retry_count int, max_retry int, error_msg string, created_at timestamp_ntz, "
    "started_at timestamp_ntz, finished_at timestamp_ntz",
    "chat_session": "id string, user_id long, kb_ids string, title string, message_count int, created_at timestamp_ntz, last_active_at timestamp_ntz, "
    "is_deleted boolean",
    "chat_message": "id long, session_id string, role string, content string, sources string, latency_ms int, feedback short, created_at timestamp_ntz",
    "answer_feedback": "id long, message_id long, user_id long, feedback short, comment string, created_at timestamp_ntz",
    "eval_dataset": "id long, kb_id long, question string, expected_answer string, expected_chunk_ids array<long>, created_by long, created_at timestamp_ntz",
    "eval_result": "id long, dataset_id long, eval_version string, hit boolean, rank int, actual_answer string, faithfulness double, "
    "answer_relevancy double, eval_at timestamp_ntz",
    "paper": "id long, kb_id long, doc_id long, title string, authors string, year int, venue string, doi string, arxiv_id string, abstract_text string, "
    "keywords string, bibtex string, source_url string, pdf_url string, reading_status string, rating int, note string, created_by long, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, is_deleted boolean",
    "paper_note": "id long, paper_id long, note_type string, content string, page_num int, section_title string, linked_chunk_id long, tags string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, is_deleted boolean",
    "paper_relation": "id long, source_paper_id long, target_paper_id long, relation_type string, evidence_chunk_id long, note string, "
    "created_at timestamp_ntz, is_deleted boolean",
}


def schema(table: str) -> StructType:
    """The declared schema of a table; needs a running session, as Spark parses it."""
    return StructType.fromDDL(_TABLES[table])



#: Allowed values by column kind.
CHOICES = {
    "document_status": ("PENDING", "PROCESSING", "DONE", "FAILED"),
    "task_status": ("PENDING", "RUNNING", "DONE", "FAILED"),
    "reading_status": ("UNREAD", "READING", "READ", "ARCHIVED"),
    "note_type": ("SUMMARY", "QUESTION", "IDEA", "QUOTE", "CRITIQUE", "TODO"),
    "relation_type": ("CITES", "EXTENDS", "COMPARES_WITH", "USES_METHOD", "USES_DATASET", "CONTRADICTS", "SAME_TOPIC"),
    "permission": ("READ", "WRITE", "ADMIN"),
}
