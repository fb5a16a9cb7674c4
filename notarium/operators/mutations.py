"""Changes to stored tables, each as a new version of the table (write it with SnapshotStore.update)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["collection_name", "source_rel_path", "target_identifier", "edge_type", "anchor_text", "source_kind"]


def clear_point_ids(chunks: DataFrame) -> DataFrame:
    """All chunks as waiting for a vector."""
    return chunks.withColumn("qdrant_point_id", F.lit(None).cast("string"))


def write_point_ids(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """chunks with the point ids of written (id, point_id); of several for one id the greatest holds."""
    new = written.groupBy("id").agg(F.max("point_id").alias("_new"))
    return chunks.join(new, "id", "left").withColumn("qdrant_point_id", F.coalesce("_new", "qdrant_point_id")).drop("_new")


def delete_points(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """vectors without the given point ids."""
    return vectors.join(gone.select("point_id").distinct(), "point_id", "left_anti")


def sweep_links(stored: DataFrame, fresh: DataFrame, scanned: DataFrame) -> DataFrame:
    """The links after an extraction: fresh ones are added or marked current, others of scanned sources become stale, and
    those of sources that are gone are dropped.

    scanned is (collection_name, rel_path) of all sources that were read; if it is empty, nothing is dropped. Both link
    tables have the key columns and confidence; stored also stale.
    """
    null_safe = {k: F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEY}
    own = fresh.groupBy(*null_safe.values()).agg(F.max("confidence").alias("confidence")).withColumn("_fresh", F.lit(True))
    old = stored.groupBy(*null_safe.values()).agg(F.max("confidence").alias("_old"))
    merged = old.join(own, KEY, "full").select(
        *KEY, F.coalesce("confidence", "_old").alias("confidence"), F.col("_fresh").isNull().alias("stale")
    )
    if scanned.isEmpty():
        return merged.withColumn("stale", F.col("stale") & F.lit(False))
    sources = scanned.select("collection_name", F.col("rel_path").alias("source_rel_path")).distinct()
    return merged.join(sources, ["collection_name", "source_rel_path"], "left_semi").select(*KEY, "confidence", "stale")


def put_state(states: DataFrame, name: str, kind: str, collection: str | None, data: Column, at: Column) -> DataFrame:
    """states (see schema.STATE) with one row added or replaced."""
    row = states.sparkSession.range(1).select(
        F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(collection).cast("string").alias("collection_name"), F.to_json(data).alias("data_json"), at.alias("updated_at")
    )
    return states.where(~F.col("name").eqNullSafe(name)).unionByName(row)
