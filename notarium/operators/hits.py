"""What ranked records stand for: their chunk or note, joined late, for the few rows that are left after fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = {"heading_path": "string", "start_line": "int", "end_line": "int", "chunk_index": "int"}
#: Characters of a note's own text where it has no chunk.
SHOWN = 2000


def with_payload(ranked: DataFrame, notes: DataFrame, chunks: DataFrame, collections: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """ranked (query_id, record_id, ...) with document_id, rel_path, title, collection_name, text and place.

    record_id is chunk:<id>, title:<note id> or knowledge:<object id>; a note shows its first chunk, or the beginning of its own text.
    Chunks may hold rows twice. The hits are joined first, so texts that are no hit are not shuffled where the hits are few
    enough to be broadcast.
    """
    key = F.substring_index("record_id", ":", -1).try_cast("bigint")
    by_chunk = ranked.where(F.startswith("record_id", F.lit("chunk:"))).withColumn("chunk_id", key)
    own = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.col("text_content").alias("text"), *_PLACE)
    rows = own.join(by_chunk, "chunk_id").drop("chunk_id").dropDuplicates(["query_id", "record_id"])
    by_note = ranked.where(F.startswith("record_id", F.lit("title:"))).withColumn("document_id", key)
    asked = by_note.select("document_id").distinct()
    first = F.min(F.struct("chunk_index", "id", F.col("text_content").alias("text"), *[c for c in _PLACE if c != "chunk_index"]))
    shown = chunks.join(asked, "document_id", "left_semi").groupBy("document_id").agg(first.alias("r")).select("document_id", "r.text", *[f"r.{c}" for c in _PLACE])
    whole = notes.select(F.col("id").alias("document_id"), F.substring("markdown_text", 1, SHOWN).alias("_own"))
    of_notes = by_note.join(shown, "document_id", "left").join(whole, "document_id", "left").withColumn("text", F.coalesce("text", "_own")).drop("_own")
    rows = rows.unionByName(of_notes)
    if objects is not None:
        by_object = ranked.where(F.startswith("record_id", F.lit("knowledge:"))).withColumn("object_id", key)
        known = objects.select(
            F.col("id").alias("object_id"), "document_id", F.col("body_text").alias("text"), F.lit(None).cast("string").alias("heading_path"),
            F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), F.lit(None).cast("int").alias("chunk_index"),
        )
        rows = rows.unionByName(known.join(by_object, "object_id").drop("object_id"))
    slim = notes.select(F.col("id").alias("document_id"), "rel_path", "title", "collection_id")
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    return slim.join(rows, "document_id").join(names, "collection_id", "left")
