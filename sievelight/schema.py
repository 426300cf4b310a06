"""Schemas of the engine's tables."""

# Table layouts.
SOURCES = "source_id long, label string, indexed_at timestamp, chunk_count int, code_chunk_count int"
CHUNKS = "chunk_id long, source_id long, label string, title string, content string, content_type string, line_start int, line_end int"
EVENTS = "event_id long, event_type string, category string, data string, priority int, data_hash string, created_at timestamp"
LEDGER = "chunk_id long, source_label string, token_estimate long, returned_at timestamp, access_count int"
RUNS = "run_id long, normalized_query string, profile string, effective_query string, source_hint string, filter_hint string, memory_applied boolean, created_at timestamp"
RUN_HITS = "run_id long, source_type string, source_label string, file_path string, title string"
MEMORY = "normalized_query string, profile string, learned_query string, learned_source_hint string, learned_filter_hint string, winning_source_label string, winning_file_path string, success_count long, last_success timestamp"
K_SOURCES = "source_id long, label string, path string, glob string, enrichments array<string>, created_at timestamp, last_sync timestamp, file_count long, chunk_count long"
K_FILES = "file_id long, source_id long, rel_path string, content_hash string, size_bytes long, indexed_at timestamp, chunk_count int"
K_CHUNKS = "chunk_id long, file_id long, source_id long, title string, content string, line_start int, line_end int, metadata string"
LINKS = "source_file_id long, target_file_id long, link_type string, confidence double"
POSTINGS = "term string, chunk_id long, tf long, dl int, term_bucket int"
