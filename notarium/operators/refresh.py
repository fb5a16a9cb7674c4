"""Differences between two states of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack between a file's time and the stored row's, in seconds.
SLACK = 2


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """(keys, change): 'new', 'changed' or 'deleted' between two listings with the same keys and stamp columns."""
    old = before.select(*keys, F.struct(*stamp).alias("old"), F.lit(True).alias("was"))
    new = after.select(*keys, F.struct(*stamp).alias("new"), F.lit(True).alias("now"))
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return old.join(new, keys, "full").select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def metadata_number(json: Column, field: str) -> Column:
    """A whole number of a JSON object, or null."""
    return F.get_json_object(json, f"$.{field}").try_cast("bigint")


def classify_refresh(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """(collection_id, rel_path, action): new, backfill, unchanged, changed or deleted.

    stored has collection_id, rel_path, metadata_json, updated_at; listed has collection_id, rel_path, file_size, file_mtime.
    A stamp that was never stored is filled in without reading the file if the size fits, or if nothing is stored and the
    file is not newer than the row (with two seconds of slack).
    """
    old = stored.select(
        "collection_id",
        "rel_path",
        metadata_number(F.col("metadata_json"), "file_size").alias("old_size"),
        F.call_function("div", metadata_number(F.col("metadata_json"), "file_mtime_ns"), F.lit(1000)).alias("old_time"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("row_time"),
        F.lit(True).alias("was"),
    )
    new = listed.select(
        "collection_id",
        "rel_path",
        F.col("file_size").alias("size"),
        F.unix_micros(F.col("file_mtime").cast("timestamp")).alias("time"),
        F.lit(True).alias("now"),
    )
    action = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "deleted")
        .when(F.col("old_time").isNull() & (F.col("old_size") == F.col("size")), "backfill")
        .when(
            F.col("old_time").isNull() & F.col("old_size").isNull() & (F.col("time") <= F.col("row_time") + SLACK * 1_000_000),
            "backfill",
        )
        .when((F.col("old_time") == F.col("time")) & (F.col("old_size") == F.col("size")), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, ["collection_id", "rel_path"], "full").select("collection_id", "rel_path", action.alias("action"))


def replace_rows(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """current with all rows of fresh's keys replaced by fresh (copy on write)."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str], checksum: str) -> DataFrame:
    """current with fresh rows added or put in their place; rows whose checksum is equal stay as they are."""
    same = fresh.join(current.select(*keys, checksum), [*keys, checksum], "left_semi").select(*keys)
    changed = fresh.join(same, keys, "left_anti")
    return current.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
