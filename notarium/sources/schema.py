"""Schemas of the engine's tables, as DDL strings, and a check of a frame against them."""

from __future__ import annotations

from pyspark.sql import DataFrame

COLLECTIONS = "id bigint, name string, root_path string, pattern string, exclude_globs array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
CONTEXTS = "context_id bigint, collection_id bigint, prefix string, context_text string"
DOCUMENTS = (
    "id bigint, collection_id bigint, rel_path string, abs_path string, title string, file_hash string, markdown_text string, "
    "frontmatter_json string, metadata_json string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
CHUNKS = (
    "id bigint, document_id bigint, version int, chunk_index int, heading_path string, section_title string, text_content string, "
    "token_count int, char_count int, start_line int, end_line int, metadata_json string, qdrant_point_id string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
LINKS = (
    "id bigint, collection_name string, source_rel_path string, target_identifier string, edge_type string, anchor_text string, "
    "source_kind string, confidence double, stale boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
)
OBJECTS = (
    "id bigint, document_id bigint, object_type string, title string, body_text string, source_chunk_ids array<bigint>, "
    "line_start int, line_end int, confidence double"
)
STATE = "name string, kind string, collection_name string, data_json string, updated_at timestamp_ntz"
VECTORS = "point_id string, embedding array<float>, payload map<string,string>"


def missing_columns(df: DataFrame, ddl: str) -> list[str]:
    """Columns of the schema that df lacks or has with another type."""
    have = dict(df.dtypes)
    wanted = df.sparkSession.createDataFrame([], ddl).dtypes
    return [name for name, kind in wanted if have.get(name) != kind]


def check_vectors(df: DataFrame, dim: int) -> int:
    """Number of vectors whose length is not dim, null ones included."""
    return df.where(f"embedding IS NULL OR size(embedding) <> {int(dim)}").count()
