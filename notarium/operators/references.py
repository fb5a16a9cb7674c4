"""References to records that do not exist.

A reference has one or more key columns, some of which may be null. References are grouped by their null mask; those of one
mask are held against the targets on its non-null columns. The declared match semantics decide what nulls mean:

* simple: a reference with any null is satisfied, and not checked;
* partial: the non-null columns must match some target; a reference with nulls only is satisfied;
* full: a reference with some nulls but not all is an orphan; with nulls only it is satisfied.

Targets are aggregated per key before each join, so a join never multiplies rows. A key that draws most references streams
through a sort-merge join against one row, and adaptive skew handling splits it. Repeated references give repeated rows; an
empty target table makes every checked reference an orphan. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.runtime import materialize


def resolve(
    references: DataFrame,
    targets: DataFrame,
    keys: list[str],
    match: str = "simple",
    alive: Column | None = None,
    since: str | None = None,
    at: str | None = None,
) -> DataFrame:
    """references with `state` (which replaces one of that name): null if satisfied, else 'missing', 'deleted' or 'late'.

    targets has the same key columns; alive says which of its rows exist (all, if not given), `since` is their time of
    coming, `at` the time of the reference. 'deleted' means that only rows that are not alive match, 'late' that the
    reference is older than every living match.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"no such match: {match}")
    lives = F.coalesce(alive, F.lit(False)) if alive is not None else F.lit(True)
    own = targets.select(*keys, lives.alias("_alive"), (F.col(since) if since else F.lit(None).cast("timestamp")).alias("_since"))
    # at most 2^keys masks; only those that occur are joined
    references = materialize(references.drop("state"), "references")
    present = references.select(F.array(*[F.col(k).isNotNull() for k in keys]).alias("mask")).distinct().collect()
    masks = [tuple(r["mask"]) for r in present] or [(True,) * len(keys)]
    parts = []
    for mask in sorted(masks):
        used = [k for k, present in zip(keys, mask) if present]
        chosen = [F.col(k).isNotNull() if present else F.col(k).isNull() for k, present in zip(keys, mask)]
        part = references.where(reduce(lambda a, b: a & b, chosen))
        if not used or (match == "simple" and len(used) < len(keys)):
            parts.append(part.withColumn("state", F.lit(None).cast("string")))
        elif match == "full" and len(used) < len(keys):
            parts.append(part.withColumn("state", F.lit("missing")))
        else:
            held = (
                own.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in used]))
                .groupBy(*used)
                .agg(F.bool_or("_alive").alias("_any"), F.min(F.when(F.col("_alive"), F.col("_since"))).alias("_first"))
            )
            late = F.col(at) < F.col("_first") if at else F.lit(False)
            state = F.when(F.col("_any").isNull(), "missing").when(~F.col("_any"), "deleted").when(late, "late")
            parts.append(part.join(held, used, "left").withColumn("state", state).drop("_any", "_first").select(*references.columns, "state"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def link_target(target: Column) -> Column:
    """A written link target in one form: lower case, no blanks around, fragment, escapes, backslashes, ./ or .md; null if
    it is no reference to a note (a scheme, or nothing but a fragment)."""
    bare = F.regexp_replace(target, r"(?U)^\s+|\s+$", "")
    cut = F.regexp_replace(bare, r"(?s)#.*$", "")
    # only whole escapes are decoded, and a plus sign stays one
    safe = F.replace(F.regexp_replace(cut, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    path = F.replace(F.try_url_decode(safe), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"^(?:\./+)+", ""), r"^/+|/+$", "")
    path = F.regexp_replace(F.lower(path), r"(?U)\.md$|\s+$", "")
    return F.when(~bare.rlike(r"^[A-Za-z]+:") & (F.length(path) > 0), path)


def note_keys(notes: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, path, name, status, created_at): the keys under which links can name each note."""
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    path = F.regexp_replace(F.lower(F.regexp_replace(F.replace("rel_path", F.lit("\\"), F.lit("/")), r"^/+|/+$", "")), r"\.md$", "")
    return notes.join(names, "collection_id").select(
        "collection", path.alias("path"), F.substring_index(path, "/", -1).alias("name"), "status", "created_at"
    )


def link_references(links: DataFrame) -> DataFrame:
    """(record_id, created_at, collection, path, name): a target with a slash names a whole path, one without any file name."""
    target = link_target(F.col("target_identifier"))
    whole = F.contains(F.col("target"), F.lit("/"))
    return links.select(F.col("id").alias("record_id"), "created_at", F.col("collection_name").alias("collection"), target.alias("target")).where(
        F.col("target").isNotNull()
    ).select(
        "record_id", "created_at", "collection", F.when(whole, F.col("target")).alias("path"), F.when(~whole, F.col("target")).alias("name")
    )


def orphans(links: DataFrame, chunks: DataFrame, notes: DataFrame, collections: DataFrame) -> DataFrame:
    """(source_table, record_id, created_at, state): link and chunk references that no note satisfies.

    Links match partially on (collection, path, name), of which one of path and name is always null; a null collection
    matches any. Chunks match simply on the note's id, so a null document_id is no reference.
    """
    alive = ~F.col("status").eqNullSafe("deleted")
    by_link = resolve(
        link_references(links), note_keys(notes, collections), ["collection", "path", "name"], "partial", alive, "created_at", "created_at"
    ).select(F.lit("vq_links").alias("source_table"), "record_id", "created_at", "state")
    own = chunks.select(F.col("id").alias("record_id"), "document_id", "created_at")
    homes = notes.select(F.col("id").alias("document_id"), "status", "created_at")
    by_chunk = resolve(own, homes, ["document_id"], "simple", alive, "created_at", "created_at").select(
        F.lit("vq_chunks").alias("source_table"), "record_id", "created_at", "state"
    )
    return by_link.unionByName(by_chunk).where(F.col("state").isNotNull()).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(source_table, period, state, orphans): number of orphan references per table and month of created_at."""
    return found.groupBy("source_table", F.date_format("created_at", "yyyy-MM").alias("period"), "state").agg(
        F.count("*").alias("orphans")
    )
