"""Combining ranked lanes and shaping the result list of every query in a batch.

Ties are broken by the record, so results do not depend on partitioning. A query's candidates are few (lane limits), so the
windows below hold small groups whatever the corpus is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Per mode: lane limit (factor, least), fused limit (factor, least), results per document, and whether missing ones are filled.
MODES = {
    "fast": ((4, 20), (4, 20), 2, True),
    "hybrid": ((4, 20), (6, 30), 2, True),
    "balanced": ((4, 20), (6, 30), 2, True),
    "deep": ((8, 50), (6, 30), 2, True),
    "focused": ((3, 12), (4, 12), 1, False),
}


def lane_limit(mode: str, n: int) -> int:
    """Rows that each lane contributes."""
    factor, least = MODES[mode][0]
    return max(factor * n, least)


def fused_limit(mode: str, n: int) -> int:
    """Rows kept after fusion."""
    factor, least = MODES[mode][1]
    return max(factor * n, least)


def reciprocal_ranks(lanes: dict[str, DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """(query_id, record_id, score, retrieval_lanes, rank): the sum of 1 / (k + rank) over the lanes."""
    united = None
    for i, (name, lane) in enumerate(lanes.items()):
        part = lane.select("query_id", "record_id", "rank", F.lit(name).alias("lane"), F.lit(i).alias("at"))
        united = part if united is None else united.unionByName(part)
    fused = united.groupBy("query_id", "record_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        F.transform(F.array_sort(F.collect_set(F.struct("at", "lane"))), lambda x: x["lane"]).alias("retrieval_lanes"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def reorder(rows: DataFrame) -> DataFrame:
    """rows ranked by their rerank_score; those without one come after, in their old order."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).drop("rank").withColumnRenamed("new_rank", "rank")


def rerank(candidates: DataFrame, scores: DataFrame, pool: int = 25) -> DataFrame:
    """Candidates re-ordered by rerank scores (query_id, record_id, rerank_score). Only the pool is kept."""
    return reorder(candidates.where(F.col("rank") <= pool).join(scores, ["query_id", "record_id"], "left"))


def overlap_score(query: Column, text: Column) -> Column:
    """Offline rerank score: the share of the query's tokens that the text holds."""
    from notarium.functions.text import simple_tokens

    own = F.array_distinct(simple_tokens(query))
    return F.round(
        F.coalesce(F.try_divide(F.size(F.array_intersect(own, simple_tokens(text))), F.size(own)), F.lit(0.0)), 9
    )


def score_floor(candidates: DataFrame, ratio: float) -> DataFrame:
    """(query_id, top, low, mean, floor) over positive finite scores; floor is ratio * top, null for a ratio of 0."""
    good = candidates.where((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") < float("inf")))
    floor = F.round(F.max("score") * ratio, 9) if ratio > 0 else F.lit(None).cast("double")
    return good.groupBy("query_id").agg(
        F.max("score").alias("top"), F.min("score").alias("low"), F.round(F.avg("score"), 9).alias("mean"), floor.alias("floor")
    )


def diversify(rows: DataFrame, n: int, per_document: int = 2, fill: bool = True) -> DataFrame:
    """At most per_document rows of one rel_path first, then, if fill, the deferred ones, up to n rows per query.

    rows has query_id, rel_path, rank. per_document <= 0 or n <= 1 keeps the order as it is.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    if per_document <= 0 or n <= 1:
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    own = Window.partitionBy("query_id", "rel_path").orderBy("rank")
    marked = rows.withColumn("deferred", F.row_number().over(own) > per_document)
    if not fill:
        marked = marked.where(~F.col("deferred"))
    final = Window.partitionBy("query_id").orderBy("deferred", "rank")
    return marked.withColumn("place", F.row_number().over(final)).where(F.col("place") <= n).drop("deferred")


def first_per_path(rows: DataFrame, limit: int) -> DataFrame:
    """The first row of each rel_path per query, up to limit; blank paths are left out."""
    own = Window.partitionBy("query_id", "rel_path").orderBy("rank")
    kept = rows.where(F.trim("rel_path") != "").withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


#: Columns of the three result views.
VIEWS = {
    "minimal": ("query_id", "id", "score", "rel_path", "title"),
    "default": ("query_id", "id", "score", "rel_path", "title", "heading_path", "start_line", "end_line", "text"),
    "debug": (
        "query_id", "id", "score", "rel_path", "title", "heading_path", "start_line", "end_line", "text", "collection_name",
        "chunk_index", "retrieval_lanes",
    ),
}
_ALIASES = {"full": "debug", "verbose": "debug", "compact": "default", "normal": "default"}


def shape(rows: DataFrame, view: str = "default") -> DataFrame:
    """The columns of a view; full and verbose mean debug, compact and normal mean default, others are refused."""
    name = _ALIASES.get(view, view)
    if name not in VIEWS:
        raise ValueError(f"no such view: {view}")
    return rows.select(*[c for c in VIEWS[name] if c in rows.columns])
