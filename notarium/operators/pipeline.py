"""The search pipeline for a batch of queries: lanes, fusion, re-ranking, links, sessions, diversity and windows.

Every stage is a DataFrame over all queries; what a query carries from stage to stage is bounded by its lane limits, so the
stages behind the lanes shuffle a few dozen rows a query, whatever the corpus is. Null and blank queries have no results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import matches_prefix
from notarium.operators import clusters, fusion, graph, lexical, sessions, vectors, windows
from notarium.operators.hits import with_payload
from notarium.runtime import materialize

#: Modes that end after their lanes were fused, with lane limits (factor, least); None takes the number of results.
SIMPLE = {"keyword": {"title": (2, 10), "keyword": (3, 10)}, "title": {"title": None}, "semantic": {"semantic": None}}
#: Modes in which links count by default.
LINKED = ("hybrid", "deep")


@dataclass(frozen=True)
class Corpus:
    """The tables that a search reads; objects (knowledge objects) may be absent."""

    notes: DataFrame
    chunks: DataFrame
    collections: DataFrame
    links: DataFrame
    objects: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """Numbers and plugins of a search; scorer and embedder are column expressions (query, text) and (text)."""

    rerank_pool: int = 25
    radius: int = 1
    per_document: int = 2
    policy: str = "penalize"
    penalty: float = 0.65
    most_sessions: int = 1
    top_k: int = 20
    floor_ratio: float = 0.0
    as_of: str | None = None
    links: bool | None = None
    scorer: Callable[[Column, Column], Column] | None = fusion.overlap_score
    embedder: Callable[[Column], Column] | None = None


def _named(lane: DataFrame, prefix: str) -> DataFrame:
    return lane.withColumn("record_id", F.concat(F.lit(prefix), F.col("record_id").cast("string")))


def title_hits(corpus: Corpus, asked: DataFrame, limit: int) -> DataFrame:
    """Title lane over notes that are not deleted."""
    notes = corpus.notes.where(F.col("status").isin("indexed", "enriched"))
    return _named(lexical.title_lane(asked, notes.select(F.col("id").alias("record_id"), "title", "rel_path"), limit), "title:")


def keyword_hits(corpus: Corpus, asked: DataFrame, limit: int) -> DataFrame:
    """Keyword lane: the best chunks and, if there are any, the best knowledge objects, merged by score."""
    lane = _named(lexical.keyword_lane(asked, lexical.query_index(corpus.chunks, "id", "text_content", asked), limit), "chunk:")
    if corpus.objects is None:
        return lane
    known = _named(lexical.keyword_lane(asked, lexical.query_index(corpus.objects, "id", "body_text", asked), limit), "knowledge:")
    # chunks come first where scores are equal
    both = lane.withColumn("kind_no", F.lit(0)).unionByName(known.withColumn("kind_no", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind_no", "rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("kind_no")


def has_vectors(corpus: Corpus) -> bool:
    """Whether any chunk or knowledge object has a point id, that is, a vector."""
    tables = [corpus.chunks, *([corpus.objects] if corpus.objects is not None and "qdrant_point_id" in corpus.objects.columns else [])]
    rows = [t.where(F.coalesce(F.trim("qdrant_point_id"), F.lit("")) != "").select(F.lit(1).alias("one")) for t in tables]
    found = rows[0] if len(rows) == 1 else rows[0].unionAll(rows[1])
    return found.limit(1).count() > 0


def semantic_hits(corpus: Corpus, asked: DataFrame, limit: int, embedder: Callable[[Column], Column]) -> DataFrame:
    """Dense lane over the chunks that have a vector."""
    stored = corpus.chunks.where(F.coalesce(F.trim("qdrant_point_id"), F.lit("")) != "").dropDuplicates(["id"]).select("id", embedder(F.col("text_content")).alias("vector"))
    wanted = asked.select("query_id", embedder(F.col("query_text")).alias("vector"))
    said = F.exists("vector", lambda x: x != 0)  # a text without words is near to nothing
    lane = vectors.nearest(stored.where(said), wanted.where(said), limit, "id", "vector", apart=False)
    return _named(lane.withColumnRenamed("id", "record_id"), "chunk:")


def with_windows(rows: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """rows with the text and lines around their chunk."""
    slim = rows.where("chunk_index IS NOT NULL").select("query_id", "record_id", "document_id", "chunk_index")
    near = windows.neighbour_window(slim, chunks.dropDuplicates(["id"]), radius).drop("document_id", "chunk_index")
    return rows.join(near, ["query_id", "record_id"], "left")


def search(corpus: Corpus, queries: DataFrame, mode: str = "hybrid", n: int = 5, options: Options = Options()) -> DataFrame:
    """(query_id, record_id, score, retrieval_lanes, rel_path, title, ..., place) of a mode: the results of every query.

    Modes: keyword, title, semantic; fast, hybrid, balanced, deep, focused. Any other one runs as hybrid without links.
    queries has query_id and query_text. With a window (radius above 0, not in focused mode) rows carry window_text,
    window_start_line and window_end_line.
    """
    mode = "hybrid" if mode == "balanced" else mode
    named, linked = mode, options.links if options.links is not None else mode in LINKED
    if mode not in SIMPLE and mode not in fusion.MODES:
        mode = "hybrid"
    asked = materialize(queries.where(F.trim("query_text") != "").select("query_id", "query_text"), "searches")
    embedder = options.embedder or vectors.hash_embedding()
    run = {
        "title": lambda k: title_hits(corpus, asked, k),
        "keyword": lambda k: keyword_hits(corpus, asked, k),
        "semantic": lambda k: semantic_hits(corpus, asked, k, embedder),
    }
    if mode in SIMPLE:
        limits = {lane: n if k is None else max(k[0] * n, k[1]) for lane, k in SIMPLE[mode].items()}
        lanes = {lane: run[lane](k) for lane, k in limits.items()}
        if len(lanes) == 1:  # a single lane keeps its own scores
            (name, lane), = lanes.items()
            fused = lane.withColumn("retrieval_lanes", F.array(F.lit(name)))
        else:
            fused = fusion.reciprocal_ranks(lanes, n)
    else:
        names = ["title", "keyword"] + (["semantic"] if mode != "fast" and has_vectors(corpus) else [])
        lanes = {lane: run[lane](fusion.lane_limit(mode, n)) for lane in names}
        fused = fusion.reciprocal_ranks(lanes, n if mode == "fast" else fusion.fused_limit(mode, n))
    # the lanes run once; what follows reads their few rows several times
    fused = materialize(fused, "fused")
    rows = with_payload(fused, corpus.notes, corpus.chunks, corpus.collections, corpus.objects).join(asked, "query_id")
    out = max(n, options.top_k) if linked else n
    if mode not in SIMPLE and mode != "fast" and options.scorer is not None:
        pool = max(options.rerank_pool, 6 * n) if mode == "deep" else options.rerank_pool
        scored = rows.where(F.col("rank") <= pool).withColumn("rerank_score", options.scorer(F.col("query_text"), F.coalesce("text", F.lit(""))))
        rows = fusion.reorder(scored).where(F.col("rank") <= out)
        rows = rows.withColumn("score", F.coalesce("rerank_score", "score")).drop("rerank_score")
    elif mode not in SIMPLE and mode != "focused":
        rows = rows.where(F.col("rank") <= out)
    rows = materialize(rows, "ranked")
    if linked and mode not in SIMPLE:
        rows = graph.graph_signals(rows, corpus.links, options.top_k, options.floor_ratio).drop("rank").withColumnRenamed("place", "rank")
    factors = sessions.with_factor(
        rows.withColumns({"lanes": F.col("retrieval_lanes"), "placed": F.col("chunk_index").isNotNull() | F.col("start_line").isNotNull()}), options.as_of, options.penalty
    )
    rows = sessions.apply_policy(factors, options.policy, max(0, min(max(1, n), options.most_sessions)), "rank")
    rows = rows.drop("score", "rank", "lanes", "placed", "factor").withColumnsRenamed({"effective_score": "score", "place": "rank"})
    if mode in SIMPLE:
        rows = rows.withColumn("place", F.col("rank")).where(F.col("place") <= n)
    else:
        focused = named == "focused"
        rows = fusion.diversify(rows, n, 1 if focused else options.per_document, not focused)
        if focused:
            return rows
    return with_windows(rows, corpus.chunks, options.radius) if options.radius > 0 else rows


def node_clusters(
    corpus: Corpus,
    options: Options = Options(),
    prefixes: Sequence[str] = (),
    collection_id: int | None = None,
    seed_limit: int = 25,
    keep: int = 5,
    min_score: float = 0.35,
    policy: str = "exclude",
    penalty: float = 0.65,
    most_sessions: int = 1,
    candidates: Sequence[str] = (),
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Clusters of the newest notes (under prefixes) by what semantic mode finds for their profile; see clusters.node_clusters.

    seed_limit is held to 1..200 and keep to 1..25, so the seeds are a stated, bounded set.
    """
    seed_limit, keep = max(1, min(200, seed_limit)), max(1, min(25, keep))
    notes = corpus.notes.where(F.col("status").isin("indexed", "enriched") & matches_prefix(F.col("rel_path"), list(prefixes)))
    if collection_id is not None:
        notes = notes.where(F.col("collection_id") == collection_id)
    field = lambda name: F.coalesce(F.get_json_object("frontmatter_json", f"$.{name}"), F.lit(""))
    seeds = notes.orderBy(F.desc("updated_at"), "rel_path", "id").limit(seed_limit)
    seeds = materialize(seeds.select("id", "rel_path", "title", clusters.seed_profile(F.col("title"), field("type"), field("domain"), F.col("markdown_text")).alias("profile")), "seeds")
    asked = seeds.select(F.col("id").alias("query_id"), F.col("profile").alias("query_text"))
    hits = search(corpus, asked, "semantic", max(4 * keep, 8), options)
    if policy == "penalize":
        placed = F.col("chunk_index").isNotNull() | F.col("start_line").isNotNull()
        hits = sessions.with_factor(hits.withColumns({"lanes": F.col("retrieval_lanes"), "placed": placed}), options.as_of, penalty)
    related = materialize(clusters.related_of_seeds(hits, seeds, keep, min_score, policy, most_sessions, candidates, excluded), "related")
    return clusters.node_clusters(related, seeds, keep)
