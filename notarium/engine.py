"""The engine over one folder of tables: what a caller uses, each method giving a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium import notes
from notarium.functions.text import target_parts
from notarium.operators import clusters, fusion, graph, pipeline, refresh, stats
from notarium.operators.hits import with_payload
from notarium.sources import receipts
from notarium.sources.settings import Settings
from notarium.sources.tables import table


class Engine:
    """Searches, statistics and graph walks over the tables of a folder (vq_documents, vq_chunks, vq_links, vq_collections).

    Search calls take a batch of queries (query_id, query_text) or one text.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, embedder: Callable[[Column], Column] | None = None):
        self.spark, self.folder, self.settings, self.embedder = spark, folder, settings or Settings(), embedder

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _chunks(self) -> DataFrame:
        return self._table("vq_chunks").dropDuplicates(["id"])

    def _queries(self, queries: DataFrame | str) -> DataFrame:
        if isinstance(queries, str):
            return self.spark.createDataFrame([(1, queries)], "query_id bigint, query_text string")
        return queries

    def corpus(self) -> pipeline.Corpus:
        """The tables as the search pipeline reads them; knowledge objects where the folder has them."""
        objects = None
        if os.path.exists(f"{self.folder}/vq_objects.parquet"):
            objects = self._table("vq_objects")
        return pipeline.Corpus(*[self._table(t) for t in ("vq_documents", "vq_chunks", "vq_collections", "vq_links")], objects)

    def options(self) -> pipeline.Options:
        """What the settings say about searches."""
        own = self.settings
        return pipeline.Options(
            rerank_pool=own.rerank_pool, radius=own.neighbour_radius, per_document=own.results_per_document, policy=own.session_policy, penalty=own.session_penalty,
            most_sessions=own.session_most, top_k=own.graph_top_k, floor_ratio=own.graph_floor_ratio, links=own.graph_signals, embedder=self.embedder,
            scorer=fusion.overlap_score if own.reranker else None,
        )

    def search(self, queries: DataFrame | str, n: int = 5, mode: str = "hybrid", view: str = "default") -> DataFrame:
        """Results of a mode (keyword, title, semantic, fast, hybrid, balanced, deep, focused) in a view; see pipeline.search."""
        rows = pipeline.search(self.corpus(), self._queries(queries), mode, max(1, min(n, 50)), self.options())
        return fusion.shape(rows.withColumnRenamed("record_id", "id"), view)

    def related(self, idea: str, limit: int = 6, mode: str = "focused") -> DataFrame:
        """Cards of related notes, one per note, with the reason; the first one is the suggested home of the idea."""
        n = max(1, min(limit, 20))
        hits = pipeline.search(self.corpus(), self._queries(idea), mode, n, self.options()).drop("rank").withColumnRenamed("place", "rank")
        reason = clusters.connection_reason(F.lit(idea), F.concat_ws(" ", "title", "text"), F.col("retrieval_lanes"))
        cards = fusion.first_per_path(hits, n).select("rel_path", F.coalesce("title", "rel_path").alias("title"), "score", "heading_path", reason.alias("reason"), "place")
        return cards.withColumn("suggested_home", F.col("place") == 1)

    def think(self, question: str, limit: int = 5) -> DataFrame:
        """An extract with citations."""
        hits = pipeline.search(self.corpus(), self._queries(question), "hybrid", max(1, min(limit, 50)), self.options())
        return clusters.answer(hits.drop("rank").withColumnsRenamed({"place": "rank", "record_id": "id"}))

    def semantic_clusters(self, collection: str | None = None, prefixes: list[str] | None = None, **how) -> DataFrame:
        """Clusters of the newest notes by what semantic mode finds for them; see pipeline.node_clusters."""
        number = None
        if collection:
            row = self._table("vq_collections").where(F.col("name") == collection).select("id").first()
            number = row["id"] if row else -1
        return pipeline.node_clusters(self.corpus(), self.options(), prefixes or [], number, **how)

    def background(self, collection: str | None = None) -> DataFrame:
        """Index runs, newest first, with how long their last sign of life lies behind their start."""
        runs = self._table("index_runs")
        age = F.unix_timestamp("last_heartbeat_at") - F.unix_timestamp("started_at")
        return runs.withColumn("seconds", age).orderBy(F.desc("started_at"), "run_id")

    def status(self) -> DataFrame:
        """Rows per table."""
        from notarium.plans.store import status_counts

        return status_counts(self.spark, self.folder)

    def collections(self) -> DataFrame:
        """Collections by name."""
        return self._table("vq_collections").select("id", "name", "root_path", "pattern").orderBy("name")

    def chunk_stats(self, collection: str | None = None) -> DataFrame:
        """Chunk length statistics with their assessment."""
        chunks = self._chunks().withColumn("embedded", F.coalesce(F.trim("qdrant_point_id"), F.lit("")) != "")
        if collection:
            names = self._table("vq_collections").where(F.col("name") == collection).select(F.col("id").alias("collection_id"))
            own = self._table("vq_documents").join(names, "collection_id", "left_semi").select(F.col("id").alias("document_id"))
            chunks = chunks.join(own, "document_id", "left_semi")
        return stats.health(stats.chunk_summary(chunks, self.settings.chunk_min_tokens, self.settings.chunk_max_tokens), self.settings.chunk_max_tokens)

    def _note_of(self, identifier: str) -> DataFrame:
        """The notes that an identifier names: #id, chunk:id, knowledge:id, or a path (also scheme://collection/path)."""
        stored = self._table("vq_documents")
        kind, _, number = identifier.partition(":")
        if identifier.startswith("#") and identifier[1:].isdigit():
            return stored.where(F.col("id") == int(identifier[1:]))
        if kind in ("chunk", "knowledge") and number.isdigit():
            source = self._table("vq_chunks") if kind == "chunk" else self.corpus().objects
            if source is None:
                return stored.limit(0)
            return stored.join(source.where(F.col("id") == int(number)).select(F.col("document_id").alias("id")), "id", "left_semi")
        parts = self.spark.range(1).select(target_parts(F.lit(identifier)).alias("p")).first()["p"]
        path = parts["path"] if parts else identifier
        if parts:
            names = self._table("vq_collections").where(F.col("name") == parts["collection"]).select(F.col("id").alias("collection_id"))
            stored = stored.join(names, "collection_id", "left_semi")
        return stored.where(F.col("rel_path").isin(path, path + ".md"))

    def document(self, identifier: str, full: bool = False) -> DataFrame:
        """A note by identifier with its chunks and knowledge objects; its text is cut to 1200 characters unless full."""
        found = self._note_of(identifier)
        text = F.col("markdown_text") if full else F.substring("markdown_text", 1, 1200)
        ids = found.select(F.col("id").alias("document_id"))
        # the note is chosen before anything is grouped
        own = self._table("vq_chunks").join(F.broadcast(ids.limit(1000)), "document_id", "left_semi").dropDuplicates(["id"])
        chunks = own.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "heading_path", "start_line", "end_line"))).alias("chunks"))
        out = found.select("id", "rel_path", "title", "status", text.alias("text")).join(chunks, F.col("id") == F.col("document_id"), "left").drop("document_id")
        objects = self.corpus().objects
        if objects is None:
            return out.withColumn("objects", F.lit(None).cast("array<struct<id:bigint,object_type:string,title:string,body_text:string>>"))
        known = objects.join(F.broadcast(ids.limit(1000)), "document_id", "left_semi").groupBy("document_id")
        known = known.agg(F.array_sort(F.collect_list(F.struct("id", "object_type", "title", "body_text"))).alias("objects"))
        return out.join(known, F.col("id") == F.col("document_id"), "left").drop("document_id")

    def fetch(self, point_id: str) -> DataFrame:
        """A record by its point id (or chunk:id, knowledge:id, title:id) in the debug view, with the window around it."""
        stored = self._chunks().where(F.col("qdrant_point_id") == point_id).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("record_id"))
        named = self.spark.createDataFrame([(point_id,)], "record_id string").where(F.col("record_id").rlike(r"^(chunk|knowledge|title):\d+$"))
        ranked = stored.unionByName(named).select(F.lit(1).cast("bigint").alias("query_id"), "record_id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank"))
        corpus = self.corpus()
        rows = with_payload(ranked, corpus.notes, corpus.chunks, corpus.collections, corpus.objects)
        return pipeline.with_windows(rows, corpus.chunks, self.settings.neighbour_radius).withColumnRenamed("record_id", "id")

    def _asked(self, identifier: str) -> DataFrame:
        return self.spark.createDataFrame([(identifier,)], "identifier string")

    def backlinks(self, identifier: str, limit: int = 50) -> DataFrame:
        """Links to a note."""
        return graph.backlinks(self._table("vq_links"), self._asked(identifier), limit)

    def neighbours(self, identifier: str, limit: int = 50) -> DataFrame:
        """Links from a note."""
        return graph.neighbours(self._table("vq_links"), self._asked(identifier), limit)

    def traverse(self, identifier: str, depth: int = 2, direction: str = "out", edge_type: str | None = None, limit: int = 200) -> DataFrame:
        """Edges within some steps of a note."""
        return graph.traverse(self._table("vq_links"), self._asked(identifier).withColumnRenamed("identifier", "start"), depth, direction, edge_type, limit)

    def longest(self, limit: int = 12) -> DataFrame:
        """The longest chunks with their notes."""
        return stats.longest_chunks(self._chunks(), self._table("vq_documents"), max(1, min(limit, 100)))

    def extract_links(self) -> DataFrame:
        """Links in all notes."""
        from notarium.plans.links import link_extract

        return link_extract(self.spark, self.folder)

    def refreshed_links(self) -> DataFrame:
        """The link table after all notes were read again, to be written in place of the old one."""
        return graph.refresh(*[self._table(t) for t in ("vq_links", "vq_documents", "vq_collections")])

    def refresh_plan(self, listed: DataFrame) -> DataFrame:
        """What a refresh would do with every listed file."""
        return refresh.classify_refresh(self._table("vq_documents"), listed)

    # --- writes of single notes ---------------------------------------------------------------------

    def _root(self, collection: str | None) -> str:
        """The folder of a collection, or of the only one; ValueError if there is none that may be written."""
        rows = self._table("vq_collections").select("name", "root_path").orderBy("name").collect()  # a handful of rows
        own = [r for r in rows if collection is None or r["name"] == collection]
        if len(own) != 1:
            raise ValueError(f"name one of the collections: {', '.join(r['name'] for r in rows)}")
        return own[0]["root_path"]

    def write_status(self, collection: str | None = None) -> DataFrame:
        """Which collections can be written, and to which folders."""
        rows = self._table("vq_collections")
        rows = rows.where(F.col("name") == collection) if collection else rows
        names = [(r["name"], r["root_path"], os.path.isdir(r["root_path"] or ""), list(self.settings.write_folders)) for r in rows.orderBy("name").collect()]
        return self.spark.createDataFrame(names, "name string, root_path string, writable boolean, folders array<string>")

    def write(self, operation: str, collection: str | None = None, **given) -> DataFrame:
        """One write (capture, note_put, note_append, note_propose) with its receipt; see notes."""
        done = notes.perform(operation, self._root(collection), given, tuple(self.settings.write_folders))
        row = [(done.rel_path, done.before, done.after, done.size)]
        out = self.spark.createDataFrame(row, "rel_path string, before string, after string, size bigint")
        receipt = out.withColumns({"operation": F.lit(operation), "at": F.current_timestamp()})
        receipts.append(receipt, f"{self._root(collection)}/{notes.RECEIPTS}")
        return out
