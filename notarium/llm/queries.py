"""Queries of the training-text operators, each over its whole tables, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.llm import markup, mixing, near_duplicates, rank_fusion, splitting, tokenizer, truncation
from notarium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


SOURCES = ("vq_documents", "vq_chunks")


def _source(scope: str = "scope") -> Column:
    """Name of the table behind a scope number."""
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col(scope).cast("int") + 1)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(scope, id, text) of all notes and chunks."""
    notes = table(spark, folder, "vq_documents").select(F.lit(0).alias("scope"), "id", F.col("markdown_text").alias("text"))
    chunks = table(spark, folder, "vq_chunks").select(F.lit(1).alias("scope"), "id", F.col("text_content").alias("text"))
    return notes.unionByName(chunks)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, record_id, text) of all notes and chunks."""
    return _texts(spark, folder).select(_source().alias("source_table"), F.col("id").alias("record_id"), "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Families of markup in every note and chunk."""
    return markup.found_families(_records(spark, folder))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of every note and chunk, with the lines that were kept."""
    return markup.strip_markup(_records(spark, folder)).select(
        "source_table", "record_id", "clean_text", "first_line", "last_line"
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hits that must lead their query's ranking."""
    return rank_fusion.leaders(table(spark, folder, "search_hits"))


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The fused ranking of every query."""
    return rank_fusion.ranking(table(spark, folder, "search_hits")).select(
        "query_id", "point_id", F.round("significance", 8).alias("significance"), "place"
    )


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(
        table(spark, folder, "vq_documents"), table(spark, folder, "vq_chunks"), table(spark, folder, "chunk_limits")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and chunks above their collection's limit: those that the splitter cut."""
    return _pieces(spark, folder).where(F.col("piece_no") == 0).select("source_table", "record_id", "section_no")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all oversized sections and chunks."""
    return _pieces(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes, and of chunks, with a similarity of 0.6 or more over sequences of three words."""
    members, pairs = near_duplicates.similar(
        _texts(spark, folder), "scope", "id", "text", threshold=0.6, words=3, min_words=20
    )
    found = near_duplicates.all_pairs(members, pairs)
    return found.select(_source().alias("source_table"), "id_a", "id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every note or chunk that is like another one (five words, 0.8), with the id of its group and its number of links."""
    members, pairs = near_duplicates.similar(_texts(spark, folder), "scope", "id", "text")
    found = near_duplicates.groups(members, pairs)
    return found.select(_source().alias("source_table"), "id", "class_id", F.col("links").cast("bigint").alias("links"))


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    """The classes behind p6_found: every text with 20 words or more, the id that stands for its class, the class size, and the
    id that stands for its byte-equal copies. p6_found with this membership is the whole result, whatever the class sizes."""
    members, _ = near_duplicates.similar(_texts(spark, folder), "scope", "id", "text", threshold=0.6, words=3, min_words=20)
    return near_duplicates.membership(members).select(_source().alias("source_table"), "id", "class_id", "class_size", "copy_of")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text again, decoded from its ids; null texts come back empty."""
    ids = tokenizer.encode(table(spark, folder, "documents"))
    return tokenizer.decode_ids(ids).select("doc_id", "text")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Selected documents with repeats, so that sources have their target shares of all tokens."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and real share of every source."""
    return mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))


def p8_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and real share of every language and topic."""
    return mixing.marginals(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text stops before its own end."""
    return truncation.found(table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts texts."""
    return truncation.rates(table(spark, folder, "documents"))


_LATEST = """
WITH latest AS (
  SELECT query_id, point_id, hit_id,
    CASE WHEN isnan(title_score) THEN NULL ELSE title_score END AS s0,
    CASE WHEN isnan(keyword_score) THEN NULL ELSE keyword_score END AS s1,
    CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END AS s2,
    CASE WHEN isnan(score) THEN NULL ELSE score END AS s3,
    CASE WHEN isnan(session_effective_score) THEN NULL ELSE session_effective_score END AS s4
  FROM search_hits
  WHERE query_id IS NOT NULL AND point_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, point_id ORDER BY searched_at DESC NULLS LAST, hit_id DESC NULLS LAST) = 1
), long AS (
  SELECT query_id, point_id, 0 AS which, s0 AS v FROM latest WHERE s0 IS NOT NULL
  UNION ALL SELECT query_id, point_id, 1, s1 FROM latest WHERE s1 IS NOT NULL
  UNION ALL SELECT query_id, point_id, 2, s2 FROM latest WHERE s2 IS NOT NULL
  UNION ALL SELECT query_id, point_id, 3, s3 FROM latest WHERE s3 IS NOT NULL
  UNION ALL SELECT query_id, point_id, 4, s4 FROM latest WHERE s4 IS NOT NULL
), placed AS (
  SELECT query_id, point_id, which,
    rank() OVER (PARTITION BY query_id, which ORDER BY v DESC) AS place,
    count(*) OVER (PARTITION BY query_id, which, v) AS ties,
    count(*) OVER (PARTITION BY query_id, which) AS total
  FROM long
)
"""

_P3_FOUND = _LATEST + """
SELECT query_id, point_id FROM placed GROUP BY query_id, point_id
HAVING count(*) >= 4 AND count(*) FILTER (WHERE place = 1 AND ties = 1) >= 3
  AND count(*) FILTER (WHERE place > (total + 1) // 2) = 0
"""

_P3_RANKING = _LATEST + """
, ranked AS (
  SELECT query_id, point_id, which, CAST(place AS DOUBLE) / total AS r,
    row_number() OVER (PARTITION BY query_id, point_id ORDER BY CAST(place AS DOUBLE) / total, which) AS k,
    count(*) OVER (PARTITION BY query_id, point_id) AS m
  FROM placed
), chances AS (
  SELECT query_id, point_id, m,
    (SELECT sum(factorial(CAST(m AS INTEGER)) / (factorial(i) * factorial(CAST(m AS INTEGER) - i)) * pow(r, i) * pow(1 - r, m - i))
     FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i) AS steps WHERE i >= k AND i <= m) AS chance
  FROM ranked
), scored AS (
  SELECT query_id, point_id, least(min(chance) * max(m), 1.0) AS significance FROM chances GROUP BY query_id, point_id
  UNION ALL
  SELECT query_id, point_id, 1.0 FROM latest
  WHERE s0 IS NULL AND s1 IS NULL AND s2 IS NULL AND s3 IS NULL AND s4 IS NULL
)
SELECT query_id, point_id, round(significance, 8) AS significance,
  rank() OVER (PARTITION BY query_id ORDER BY round(significance, 12)) AS place
FROM scored
"""


def queries() -> dict[str, Query]:
    """Name to query; the first of each problem is its main one."""
    runs = (p1_found, p1_clean, p3_found, p3_ranking, p5_found, p5_pieces, p6_found, p6_groups, p6_members, p7_ids, p7_decoded, p8_mix, p8_shares, p8_marginals, p9_found, p9_rates)
    return {run.__name__: run for run in runs}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {
        "p3_found": _P3_FOUND,
        "p3_ranking": _P3_RANKING,
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
