"""Queries over the state of the store: what the next run must process, and references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notarium.operators import incremental, references
from notarium.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files which the next run must process, with the first reason that holds."""
    return incremental.next_actions(*[table(spark, folder, t) for t in ("file_listing", "vq_documents", "index_runs", "vq_chunks")])


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Number of files to process per collection and reason."""
    return p2_found(spark, folder).groupBy("collection_id", "action").count().withColumnRenamed("count", "files")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans(*[table(spark, folder, t) for t in ("vq_links", "vq_chunks", "vq_documents", "vq_collections")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Link and chunk references that no note satisfies."""
    return _orphans(spark, folder).select("source_table", "record_id", "state")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of orphan references per table and month."""
    return references.orphan_report(_orphans(spark, folder))


QUERIES = {q.__name__: q for q in (p2_found, p2_summary, p4_found, p4_report)}

_P2 = """
WITH latest AS (
  SELECT collection_id, rel_path, regexp_extract(lower(file_hash), '([0-9a-f]*)\\s*$', 1) AS h
  FROM file_listing
  QUALIFY row_number() OVER (PARTITION BY collection_id, rel_path ORDER BY file_mtime DESC NULLS LAST, listing_id DESC) = 1
), found AS (
  SELECT l.collection_id, l.rel_path,
    CASE WHEN d.id IS NULL THEN 'new'
      WHEN l.h <> regexp_extract(lower(d.file_hash), '([0-9a-f]*)\\s*$', 1) THEN 'changed'
      WHEN EXISTS (SELECT 1 FROM index_runs r WHERE r.status IS DISTINCT FROM 'succeeded'
                   AND d.updated_at BETWEEN r.started_at AND r.last_heartbeat_at) THEN 'retry'
      WHEN d.id IN (SELECT document_id FROM vq_chunks WHERE coalesce(trim(qdrant_point_id), '') = '' AND document_id IS NOT NULL)
        THEN 'unembedded' END AS action
  FROM latest l LEFT JOIN vq_documents d ON d.collection_id = l.collection_id AND d.rel_path = l.rel_path
  WHERE d.status IS DISTINCT FROM 'deleted'
)
"""

_P4 = """
WITH bare AS (
  SELECT id, created_at, collection_name, regexp_replace(target_identifier, '^\\s+|\\s+$', '', 'g') AS b FROM vq_links
), decoded AS (
  SELECT *, replace(url_decode(regexp_replace(regexp_replace(b, '(?s)#.*$', ''), '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '%25\\1', 'g')), '\\', '/') AS p
  FROM bare WHERE NOT regexp_matches(b, '^[A-Za-z]+:')
), target AS (
  SELECT id, created_at, collection_name, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
    trim(p), '^(\\./+)+', ''), '^/+|/+$', '', 'g')), '\\.md$', ''), '\\s+$', '') AS t
  FROM decoded
), notes AS (
  SELECT d.id, c.name AS collection_name, regexp_replace(lower(d.rel_path), '\\.md$', '') AS path, d.status, d.created_at
  FROM vq_documents d JOIN vq_collections c ON c.id = d.collection_id
), keyed AS (
  SELECT collection_name, path AS k, status, created_at FROM notes
  UNION ALL
  SELECT collection_name, regexp_extract(path, '[^/]*$'), status, created_at FROM notes WHERE contains(path, '/')
), held AS (
  SELECT collection_name, k, bool_or(status <> 'deleted') AS alive, min(created_at) FILTER (WHERE status <> 'deleted') AS first
  FROM keyed GROUP BY ALL
), refs AS (
  SELECT 'vq_links' AS source_table, t.id AS record_id, t.created_at,
    CASE WHEN h.alive IS NULL THEN 'missing' WHEN NOT h.alive THEN 'deleted' WHEN t.created_at < h.first THEN 'late' END AS state
  FROM target t LEFT JOIN held h ON h.collection_name = t.collection_name AND h.k = t.t WHERE t.t <> ''
  UNION
  SELECT 'vq_chunks', c.id, c.created_at,
    CASE WHEN d.id IS NULL THEN 'missing' WHEN d.status = 'deleted' THEN 'deleted' WHEN c.created_at < d.created_at THEN 'late' END
  FROM vq_chunks c LEFT JOIN vq_documents d ON d.id = c.document_id WHERE c.document_id IS NOT NULL
)
"""

SQL = {
    "p2_found": _P2 + "SELECT collection_id, rel_path, action FROM found WHERE action IS NOT NULL",
    "p2_summary": _P2 + "SELECT collection_id, action, count(*) AS files FROM found WHERE action IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT source_table, record_id, state FROM refs WHERE state IS NOT NULL",
    "p4_report": _P4
    + "SELECT source_table, strftime(created_at, '%Y-%m') AS period, state, count(*) AS orphans FROM refs WHERE state IS NOT NULL GROUP BY ALL",
}
