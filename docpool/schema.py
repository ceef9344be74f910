"""Schemas of the stored tables and of query results."""

from __future__ import annotations

KEYS = "key string, doc_count long, last_accessed_at timestamp, last_updated_at timestamp, trashed_at timestamp"
RECORDS = "id long, key string, path string, content_hash string, created_at timestamp, updated_at timestamp"
SERIES_KEYS = "record_id long, series string"
CHUNKS = "id long, record_id long, chunk_index int, heading_path string, text string, embed_text string"
EMBEDDINGS = "chunk_id long, vector array<float>, dim int"
PENDING = "key string, series string, path string, marked_at timestamp"

#: Tables of a namespace's state; `keys` is one row.
TABLES = {"keys": KEYS, "records": RECORDS, "series_keys": SERIES_KEYS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "pending": PENDING}
