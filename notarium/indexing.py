"""Index runs: a tree of files into the stored tables, and vectors for what waits for one.

A run lists the files, compares them with the stored notes, reads and cuts what is new or changed, and drops what is gone.
Tables are snapshots; notes, which carry the hash and stamp by which the next run compares, are written last. A run that
breaks off before that leaves the notes as they were, so the next run does the same work again and replaces what the broken one wrote:
ids come from names, not from counters, and rows are replaced by note. Searches read what the pointers name at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions import text as T
from notarium.operators import mutations, refresh, vectors, windows
from notarium.operators.chunking import chunk_notes
from notarium.runtime import materialize
from notarium.sources import scan, schema
from notarium.sources.snapshots import SnapshotStore

TABLES = {"vq_documents": schema.DOCUMENTS, "vq_chunks": schema.CHUNKS, "vq_objects": schema.OBJECTS + ", qdrant_point_id string", "vq_vectors": schema.VECTORS}


def named_id(*parts: Column) -> Column:
    """A positive number that depends on the parts only."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**62 - 1))


class Indexer:
    """Keeps the tables of a store in step with files; embedder maps a text column to a vector column."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, embedder: Callable[[Column], Column] | None = None):
        self.spark, self.store = spark, store
        self.embedder = embedder or vectors.hash_embedding()

    def init(self, reset: bool = False) -> list[str]:
        """Create the tables that are missing, or all of them anew; their names."""
        names = [n for n in TABLES if reset or self.store.version(n) is None]
        for name in names:
            self.store.write(name, self.spark.createDataFrame([], TABLES[name]))
        return names

    def table(self, name: str) -> DataFrame:
        """The current version of a table, or an empty one."""
        if self.store.version(name) is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.store.read(name)

    def plan(self, collection_id: int, root: str, pattern: str = "*.md", excludes: Sequence[str] = (), force: bool = False) -> DataFrame:
        """(collection_id, rel_path, action) of all listed and stored files; with force nothing counts as unchanged."""
        listed = scan.list_files(self.spark, root, pattern, list(excludes)).withColumn("collection_id", F.lit(collection_id).cast("bigint"))
        stored = self.table("vq_documents").where(F.col("collection_id") == collection_id)
        plan = refresh.classify_refresh(stored, listed)
        return plan.withColumn("action", F.when(F.col("action").isin("unchanged", "backfill"), "changed").otherwise(F.col("action"))) if force else plan

    def run(
        self, collection_id: int, root: str, pattern: str = "*.md", excludes: Sequence[str] = (), force: bool = False, limit: int | None = None, paths: Sequence[str] | None = None
    ) -> dict[str, int]:
        """One run; the number of files per outcome. With limit only so many files are read and nothing is dropped; paths keeps
        the run to these files."""
        plan = self.plan(collection_id, root, pattern, excludes, force)
        if paths is not None:
            plan = plan.where(F.col("rel_path").isin(list(paths)))
        plan = materialize(plan, "plan")
        work = plan.where(F.col("action").isin("new", "changed"))
        if limit is not None:
            work = work.orderBy("rel_path").limit(limit)
        gone = plan.where("action = 'deleted'") if limit is None else plan.limit(0)
        old = self.table("vq_documents")
        own = ["collection_id", "rel_path"]
        read = materialize(scan.read_notes(self.spark, root, collection_id, pattern, list(excludes), work.select("rel_path")), "read")
        known = old.select(*own, F.col("id").alias("_id"), F.col("file_hash").alias("_hash"), F.col("created_at").alias("_created"))
        now = F.current_timestamp().cast("timestamp_ntz")
        found = read.join(known, own, "left").withColumns(
            {"id": F.coalesce("_id", named_id(F.col("collection_id"), F.col("rel_path"))), "created_at": F.coalesce("_created", now), "updated_at": now}
        )
        found = found.withColumn("frontmatter_json", F.to_json(scan.frontmatter_map()(F.col("frontmatter"))))
        # a file that was only touched keeps its chunks
        fresh = found if force else found.where(~F.col("_hash").eqNullSafe(F.col("file_hash")))
        rewritten = materialize(fresh.select("id"), "rewritten")
        dropped = materialize(old.join(gone.select(*own), own, "left_semi").select("id"), "dropped")
        touched = rewritten.union(dropped).select(F.col("id").alias("document_id"))
        self._replace_chunks(fresh, touched)
        names = [c.split()[0] for c in schema.DOCUMENTS.split(", ")]
        changed = found.select(*names)
        stamps = self._stamps(plan, collection_id, root, pattern, excludes)
        kept = old.join(changed.select("id"), "id", "left_anti").join(dropped, "id", "left_anti").join(stamps, own, "left")
        kept = kept.withColumn("metadata_json", F.coalesce("_stamp", "metadata_json")).select(*names)
        self.store.write("vq_documents", kept.unionByName(changed))
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}  # five kinds at most
        return {"indexed": rewritten.count(), "deleted": dropped.count(), "backfilled": counts.get("backfill", 0), "unchanged": counts.get("unchanged", 0), "read": read.count()}

    def _stamps(self, plan: DataFrame, collection_id: int, root: str, pattern: str, excludes: Sequence[str]) -> DataFrame:
        """(collection_id, rel_path, _stamp): size and time of the files whose row has none yet."""
        listed = scan.list_files(self.spark, root, pattern, list(excludes)).withColumn("collection_id", F.lit(collection_id).cast("bigint"))
        fill = plan.where("action = 'backfill'").select("collection_id", "rel_path")
        stamp = F.to_json(F.struct("file_size", (F.unix_micros("file_mtime") * 1000).alias("file_mtime_ns")))
        return listed.join(fill, ["collection_id", "rel_path"], "left_semi").select("collection_id", "rel_path", stamp.alias("_stamp"))

    def _replace_chunks(self, fresh: DataFrame, touched: DataFrame) -> None:
        """Cut fresh notes anew; chunks, points and objects of touched notes are replaced, dropped or remapped."""
        chunks, now = self.table("vq_chunks"), F.current_timestamp().cast("timestamp_ntz")
        cut = chunk_notes(fresh.select("id", T.body_of(F.col("markdown_text")).alias("markdown_text"))).withColumnRenamed("id", "document_id")
        new = cut.withColumns(
            {
                "id": named_id(F.col("document_id"), F.col("chunk_index"), F.col("text_content")), "version": F.lit(1), "metadata_json": F.lit("{}"),
                "qdrant_point_id": F.lit(None).cast("string"), "created_at": now, "updated_at": now,
            }
        )
        new = materialize(new.select(*[c.split()[0] for c in schema.CHUNKS.split(", ")]), "chunks")
        stale = chunks.join(touched, "document_id", "left_semi").select(F.col("qdrant_point_id").alias("point_id"))
        objects = self.table("vq_objects")
        moved = materialize(objects.join(touched, "document_id", "left_semi"), "objects")
        stale = stale.union(moved.select("qdrant_point_id")).where("point_id IS NOT NULL")
        self.store.write("vq_vectors", mutations.delete_points(self.table("vq_vectors"), stale))
        lines = moved.select("id", "document_id", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))
        spans = windows.remap_objects(lines, new).withColumnsRenamed({"object_id": "id", "source_chunk_ids": "_chunks"})
        # objects of notes that are gone go with them
        remapped = moved.join(fresh.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(spans, "id", "left")
        remapped = remapped.withColumn("source_chunk_ids", F.coalesce("_chunks", F.array().cast("array<bigint>"))).withColumn("qdrant_point_id", F.lit(None).cast("string"))
        self.store.write("vq_objects", objects.join(touched, "document_id", "left_anti").unionByName(remapped.select(*objects.columns)))
        self.store.write("vq_chunks", chunks.join(touched, "document_id", "left_anti").unionByName(new))

    def embed(self, limit: int | None = None, max_points: int = 400) -> dict[str, int]:
        """Vectors for waiting chunks, in order of note and place; point ids are written back last, so a broken run is repeated.

        Chunks are packed into windows of a note and windows into requests, which names the unit in which an embedder is asked.
        """
        chunks, notes = self.table("vq_chunks"), self.table("vq_documents")
        waiting = vectors.pending(chunks).join(notes.select(F.col("id").alias("document_id"), "rel_path", "title"), "document_id")
        if limit is not None:
            waiting = waiting.orderBy("document_id", "chunk_index").limit(limit)
        waiting = materialize(waiting, "waiting")
        packed = vectors.pack_through(
            waiting.select(F.col("document_id").alias("source_key"), F.col("chunk_index").alias("item_no"), F.col("text_content").alias("text"))
        )
        requests = vectors.pack_requests(packed)
        point = T.name_uuid(F.concat(F.lit("notes:chunk:"), F.col("id").cast("string")))
        payload = F.create_map(F.lit("rel_path"), F.col("rel_path"), F.lit("title"), F.col("title"), F.lit("heading_path"), F.col("heading_path"), F.lit("text"), F.col("text_content"))
        made = waiting.select(
            "id", point.alias("point_id"), self.embedder(T.bounded_text(F.col("text_content"))).cast("array<float>").alias("embedding"), payload.alias("payload")
        )
        made = materialize(made.where(F.exists("embedding", lambda x: x != 0)), "vectors")
        stored = mutations.delete_points(self.table("vq_vectors"), made.select("point_id")).unionByName(made.select("point_id", "embedding", "payload"))
        self.store.write("vq_vectors", stored, max_records=max_points)
        written = made.select("id", "point_id")
        self.store.write("vq_chunks", mutations.write_point_ids(chunks, written))
        return {"embedded": made.count(), "waiting": waiting.count() - made.count(), "requests": requests.select("lane", "request_no").distinct().count()}


def send_halving(points: list, send: Callable[[list], None], retries: int = 4, too_large: Callable[[Exception], bool] = lambda fault: True, wait: Callable[[int], None] = lambda n: None) -> int:
    """Send points; a write that is refused as too large is sent in halves, other faults are tried again. The number of calls."""
    for attempt in range(1, retries + 1):
        try:
            send(points)
            return attempt
        except Exception as fault:
            if len(points) > 1 and too_large(fault):
                middle = len(points) // 2
                return attempt + send_halving(points[:middle], send, retries, too_large, wait) + send_halving(points[middle:], send, retries, too_large, wait)
            if attempt == retries:
                raise
            wait(attempt)
    return retries
