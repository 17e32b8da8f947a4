"""Schemas of the records that flow between stages, as DDL."""

from __future__ import annotations

CAPTURE = (
    "url string, final_url string, status_code int, html string, fetched_at string, response_headers map<string,string>, raw_bytes binary, content_type string, redirect_chain array<string>, "
    "render_engine string, render_version string, render_timestamp string, js_executed boolean"
)
METADATA = "struct<title: string, author: string, language: string, description: string, site_name: string, published_time: string, modified_time: string, license: string>"
MEASURES = "struct<source_chars: int, markdown_chars: int, kept_chars: int, stripped_elements: int, retention_ratio: double>"
POLICY_DECISION = "struct<allowed: boolean, rule: string, reason: string>"
CHUNK = "struct<chunk_id: string, heading_path: array<string>, content: string, start: int, end: int, char_count: int, token_count: int>"
CHUNK_ROW = "doc_id string, content_hash string, chunk_id string, heading_path array<string>, start int, end int, char_count int, token_count int, chunk_sha256 string"
CONSENT = "scheme string, netloc string, ai_txt map<string,string>, llms_txt boolean, retryable boolean"
PAGE_RECORD = (
    "url string, status_code int, raw_bytes bigint, markdown_chars bigint, content_hash string, bytes_sha256 string, retention_ratio double, stripped_elements int, low_content boolean, license string, "
    f"ai_txt map<string,string>, llms_txt boolean, policy_decision {POLICY_DECISION}, requested_url string, error string"
)
MANIFEST_ROW = "url string, file string, content_hash string, fetched_at string, status_code int, title string, bytes_sha256 string, etag string, last_modified string, seq long"
SCORECARD_ROW = "url string, status_code int, latency_ms double, raw_bytes bigint, markdown_chars bigint, provenance_complete boolean, error string"
FRONTIER_ROW = "url string, depth int"
EDGE = "src string, dst string, pos long"
CHECKPOINT = "seen_hashes array<string>, manifest array<struct<url: string, content_hash: string>>, frontier array<struct<url: string, depth: int>>, visited array<string>"
