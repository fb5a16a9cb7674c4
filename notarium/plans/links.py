"""Queries over the link graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notarium.operators import graph
from notarium.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for it."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


_KEY = "regexp_replace(trim(replace(coalesce({0}, ''), '\\', '/'), '/'), '\\.md$', '')"


@query(
    """SELECT source_rel_path, target_identifier, edge_type, count(*) AS provenance_count, list_sort(list_distinct(list(source_kind))) AS source_kinds,
  list_sort(list_distinct(coalesce(list(anchor_text) FILTER (WHERE anchor_text <> ''), []))) AS anchors, max(confidence) AS confidence FROM vq_links GROUP BY ALL"""
)
def edge_collapse(spark, folder):
    """Edges with how often they occur."""
    return graph.collapse_edges(table(spark, folder, "vq_links"))


@query(
    f"""WITH i AS (SELECT rel_path AS identifier, {_KEY.format('rel_path')} AS k FROM vq_documents WHERE id % 50 = 0 GROUP BY ALL)
  SELECT i.identifier, l.id, l.source_rel_path, l.confidence, row_number() OVER (PARTITION BY i.identifier ORDER BY confidence DESC, updated_at DESC, l.id) AS place
  FROM vq_links l JOIN i ON {_KEY.format('l.target_identifier')} = i.k QUALIFY place <= 50"""
)
def backlinks(spark, folder):
    """Fifty links to every fiftieth note."""
    asked = table(spark, folder, "vq_documents").where("id % 50 = 0").select(F.col("rel_path").alias("identifier"))
    return graph.backlinks(table(spark, folder, "vq_links"), asked).select("identifier", "id", "source_rel_path", "confidence", "place")


@query(
    f"""WITH i AS (SELECT rel_path AS identifier, {_KEY.format('rel_path')} AS k FROM vq_documents WHERE id % 50 = 0 GROUP BY ALL)
  SELECT i.identifier, l.id, l.target_identifier, l.confidence, row_number() OVER (PARTITION BY i.identifier ORDER BY confidence DESC, updated_at DESC, l.id) AS place
  FROM vq_links l JOIN i ON {_KEY.format('l.source_rel_path')} = i.k QUALIFY place <= 50"""
)
def neighbours(spark, folder):
    """Fifty links from every fiftieth note."""
    asked = table(spark, folder, "vq_documents").where("id % 50 = 0").select(F.col("rel_path").alias("identifier"))
    return graph.neighbours(table(spark, folder, "vq_links"), asked).select("identifier", "id", "target_identifier", "confidence", "place")


@query(
    """WITH n AS (SELECT c.name AS collection_name, d.rel_path, regexp_replace(lower(regexp_extract(d.rel_path, '[^/]*$')), '\\.md$', '') AS k FROM vq_documents d JOIN vq_collections c ON c.id = d.collection_id),
  i AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY collection_name, k ORDER BY rel_path) <= 10)
  SELECT l.id, i.rel_path FROM vq_links l JOIN i ON i.collection_name = l.collection_name AND i.k = lower(l.target_identifier)
  WHERE l.source_kind = 'wikilink' AND l.edge_type = 'links_to' AND NOT contains(l.target_identifier, '/')"""
)
def basename_resolve(spark, folder):
    """Notes that plain wiki links name by file name."""
    names = table(spark, folder, "vq_collections").select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    notes = table(spark, folder, "vq_documents").join(names, "collection_id").select("collection_name", "rel_path")
    links = table(spark, folder, "vq_links").select("id", "collection_name", F.col("target_identifier").alias("target"), "edge_type", "source_kind")
    found = graph.expand_basenames(links, notes).where("edge_type = 'wikilink_basename'")
    given = table(spark, folder, "vq_links").where("edge_type = 'wikilink_basename'").select("id")
    return found.join(given, "id", "left_anti").select("id", F.concat("target", F.lit(".md")).alias("rel_path"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {_KEY.format('source_rel_path')} AS s, {_KEY.format('target_identifier')} AS t, edge_type FROM vq_links),
  w AS (SELECT DISTINCT {_KEY.format('rel_path')} AS start_key, {_KEY.format('rel_path')} AS node, 0 AS lvl, rel_path AS start FROM vq_documents WHERE id % 50 = 0
    UNION SELECT w.start_key, e.t, w.lvl + 1, w.start FROM w JOIN e ON e.s = w.node WHERE w.lvl < 2),
  d AS (SELECT start, node, min(lvl) AS lvl FROM w GROUP BY ALL)
  SELECT d.start, e.s AS source, e.t AS target, e.edge_type, d.lvl + 1 AS level FROM d JOIN e ON e.s = d.node WHERE d.lvl < 2"""
)
def graph_bfs(spark, folder):
    """Edges within two steps from every fiftieth note."""
    starts = table(spark, folder, "vq_documents").where("id % 50 = 0").select(F.col("rel_path").alias("start"))
    return graph.traverse(table(spark, folder, "vq_links"), starts, 2).select("start", "source", "target", "edge_type", "level")


@query()
def link_extract(spark, folder):
    """Links in the texts and front matter of all notes."""
    notes, names = table(spark, folder, "vq_documents"), table(spark, folder, "vq_collections")
    return graph.extract(notes, names, basenames=False).withColumnRenamed("source_rel_path", "rel_path")


@query()
def link_refresh(spark, folder):
    """The link table after all notes were read again."""
    return graph.refresh(*[table(spark, folder, t) for t in ("vq_links", "vq_documents", "vq_collections")])


@query(
    """SELECT collection_name, edge_type, source_kind, count(*) AS links, count(*) FILTER (WHERE stale) AS stale, count(DISTINCT source_rel_path) AS sources FROM vq_links GROUP BY ALL"""
)
def link_counts(spark, folder):
    """Links per collection, type and kind."""
    return table(spark, folder, "vq_links").groupBy("collection_name", "edge_type", "source_kind").agg(
        F.count("*").alias("links"), F.count_if("stale").alias("stale"), F.count_distinct("source_rel_path").alias("sources")
    )
