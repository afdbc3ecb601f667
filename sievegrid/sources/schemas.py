"""Explicit schemas of the record types; nothing is inferred."""

from __future__ import annotations

TABLE = "ARRAY<STRUCT<index INT, page INT, n_rows INT, n_cols INT, rows ARRAY<ARRAY<STRING>>>>"
FETCH = "id STRING, url STRING, venue STRING, lang STRING, expect STRING, status STRING, http_status INT, content_type STRING, bytes BIGINT, sha256 STRING, local_path STRING, retrieval_date STRING, error STRING, notes STRING"
DOCUMENT = f"doc_id STRING, title STRING, venue STRING, lang STRING, source_url STRING, retrieval_date STRING, fmt STRING, text STRING, tables {TABLE}, doc_no STRING, effective_status STRING, effective_date STRING, page_count INT, ocr_pages ARRAY<INT>, parse_warnings ARRAY<STRING>"
PARENT = "parent_id STRING, doc_id STRING, text STRING, venue STRING, lang STRING, source_url STRING, retrieval_date STRING, doc_title STRING, doc_no STRING, clause_id STRING, section_path ARRAY<STRING>, effective_status STRING, effective_date STRING, chunk_type STRING"
CHILD = "child_id STRING, parent_id STRING, doc_id STRING, text STRING, venue STRING, lang STRING, source_url STRING, doc_title STRING, doc_no STRING, clause_id STRING, effective_status STRING, chunk_type STRING, position INT"
PAIR = "qa_id STRING, question STRING, answer STRING, tier INT, source_url STRING, doc_id STRING, parent_id STRING, clause_id STRING, venue STRING, lang STRING, mining_method STRING, span_verified BOOLEAN, human_verified BOOLEAN"
SOURCE = "id STRING, venue STRING, kind STRING, expect STRING, url STRING, adapter STRING, http_only BOOLEAN, need_ua BOOLEAN, lang STRING, title STRING, notes STRING"
