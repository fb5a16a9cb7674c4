"""Grouping related notes: around shared nearest notes, around shared words, and as cards of related work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import matches_prefix, source_class

#: Words that say nothing about relation, and words that make no label, as fixed values.
RELATED_STOP = "about after agent also and for from idea into like note notes that the this with work".split()
LABEL_STOP = "about agent agentic and from idea into note notes that the this with workspace".split()


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def terms(text: Column, stop: list[str] = RELATED_STOP) -> Column:
    """Distinct lower-case words of four or more characters that begin with a letter, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9_-]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), _list(stop))


def connection_reason(idea: Column, text: Column, lanes: Column) -> Column:
    """Why a hit is related: shared words (eight at most, in order), its lanes, or nearness."""
    shared = F.slice(F.array_sort(F.array_intersect(terms(idea), terms(text))), 1, 8)
    return (
        F.when(F.size(shared) > 0, F.concat(F.lit("shared terms: "), F.array_join(shared, ", ")))
        .when(F.size(F.coalesce(lanes, F.array().cast("array<string>"))) > 0, F.concat(F.lit("retrieved through "), F.array_join(lanes, ", ")))
        .otherwise("retrieval score indicates semantic proximity")
    )


def anchored_clusters(related: DataFrame, seeds: DataFrame, min_score: float = 0.35, keep: int = 5) -> DataFrame:
    """Clusters of seeds that share their best related item.

    related has seed, item, score (already without the seed itself); seeds has seed. Items under min_score are dropped, each
    seed keeps its best `keep`. The anchor is the best item, or the seed itself without any. One row per cluster: anchor,
    seeds, best score and the number of related items.
    """
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "item")
    good = related.where(F.col("score") >= min_score).withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    top = good.where("n = 1").select("seed", F.col("item").alias("anchor"))
    anchored = seeds.join(top, "seed", "left").withColumn("anchor", F.coalesce("anchor", "seed"))
    joined = anchored.join(good, "seed", "left")
    return joined.groupBy("anchor").agg(
        F.count_distinct("seed").alias("connection_count"),
        F.array_sort(F.collect_set("seed")).alias("seed_nodes"),
        F.count_distinct("item").alias("related_count"),
        F.max("score").alias("best_score"),
    )


def seed_profile(title: Column, kind: Column, domain: Column, text: Column, most: int = 1600) -> Column:
    """The text by which a note is searched: its title, kind, domain and the beginning of its text."""
    parts = [
        F.trim(title),
        F.when(F.trim(kind) != "", F.concat(F.lit("type: "), F.trim(kind))),
        F.when(F.trim(domain) != "", F.concat(F.lit("domain: "), F.trim(domain))),
        F.substring(F.trim(text), 1, most),
    ]
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


def related_of_seeds(
    hits: DataFrame,
    seeds: DataFrame,
    keep: int = 5,
    min_score: float = 0.35,
    policy: str = "exclude",
    most_sessions: int = 1,
    prefixes: Sequence[str] = (),
    excluded: Sequence[str] = (),
) -> DataFrame:
    """(seed, item, title, score, n): the related notes of each seed, best first.

    hits has query_id (the seed's id), rel_path, title, score, place and, for the penalize policy, factor; seeds has id, rel_path. Of
    several hits of a note the first counts. The seed itself, notes outside the prefixes or under an excluded one, sessions
    where they are excluded, and hits under min_score are left out; penalize multiplies a session's score by its factor and
    keeps `most_sessions` of a seed.
    """
    if policy not in ("exclude", "penalize", "include"):
        raise ValueError(f"no such session policy: {policy}")
    session = source_class(F.col("rel_path")) == "agent_session"
    rows = hits.join(seeds.select(F.col("id").alias("query_id"), F.col("rel_path").alias("seed")), "query_id").where(F.col("rel_path") != F.col("seed"))
    rows = rows.where(matches_prefix(F.col("rel_path"), list(prefixes)))
    if excluded:
        rows = rows.where(~matches_prefix(F.col("rel_path"), list(excluded)))
    if policy == "exclude":
        rows = rows.where(~session)
    score = F.when(session, F.col("score") * F.col("factor")).otherwise(F.col("score")) if policy == "penalize" else F.col("score")
    rows = rows.withColumn("score", F.round(score, 6)).where(F.col("score") >= min_score)
    first = Window.partitionBy("seed", "rel_path").orderBy("place")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "rel_path")
    if policy == "penalize":
        seen = F.sum(session.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        once = once.withColumn("_s", seen).where(~session | (F.col("_s") <= most_sessions)).drop("_s")
    ranked = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return ranked.select("seed", F.col("rel_path").alias("item"), "title", "score", "n")


def node_clusters(related: DataFrame, seeds: DataFrame, keep: int = 5) -> DataFrame:
    """Clusters of seed notes around their best related note, with its title as label and the best `keep` related notes.

    One row per cluster: anchor, label, seed_count, seed_paths, related_paths (by score, number of seeds, path), best_score, place.
    """
    top = related.where("n = 1").select("seed", F.col("item").alias("anchor"), F.col("title").alias("label"))
    own = seeds.select(F.col("rel_path").alias("seed"), F.col("title").alias("own")).join(top, "seed", "left")
    own = own.select("seed", F.coalesce("anchor", "seed").alias("anchor"), F.coalesce("label", "own", "seed").alias("label"))
    nodes = own.join(related.select("seed", "item", "score"), "seed").groupBy("anchor", "item").agg(F.max("score").alias("score"), F.count("*").alias("links"))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.desc("links"), "item")
    nodes = nodes.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep)
    listed = nodes.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("related_paths"), F.max("score").alias("best_score")
    )
    grouped = own.groupBy("anchor").agg(F.min("label").alias("label"), F.count("*").alias("seed_count"), F.array_sort(F.collect_set("seed")).alias("seed_paths"))
    rows = grouped.join(listed, "anchor", "left").withColumns(
        {"related_paths": F.coalesce("related_paths", F.array().cast("array<string>")), "best_score": F.coalesce("best_score", F.lit(0.0))}
    )
    # one row per cluster of a bounded number of seeds
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("seed_count"), F.desc("best_score"), "anchor"))
    return rows.withColumn("place", place)


def keyword_label(notes: DataFrame) -> DataFrame:
    """(id, label): each note's most frequent word of four or more letters, first in order among equals; 'general' if none.

    notes has id, text. Words are counted per note with map-side combination.
    """
    words = notes.select(
        "id",
        F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z][a-z]{3,}"), F.lit(0))).alias("word"),
    ).where(~F.col("word").isin(LABEL_STOP))
    counted = words.groupBy("id", "word").agg(F.count("*").alias("n"))
    best = counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("b")).select("id", F.col("b.word").alias("label"))
    return notes.select("id").join(best, "id", "left").select("id", F.coalesce("label", F.lit("general")).alias("label"))


def label_clusters(labels: DataFrame) -> DataFrame:
    """(label, notes): number of notes per label."""
    return labels.groupBy("label").agg(F.count("*").alias("notes"))


def workspace_digest(notes: DataFrame) -> DataFrame:
    """(collection_id, notes, digest): one hash per collection over paths and file hashes.

    Each note's hash is a 128-bit number; sums of its halves do not depend on order, so the digest is a plain aggregate and
    no list of notes is gathered.
    """
    own = F.md5(F.concat_ws("\x1f", "rel_path", "file_hash"))
    half = [F.conv(F.substring(own, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 17)]
    sums = [F.sum(h).cast("string") for h in half]
    return notes.groupBy("collection_id").agg(F.count("*").alias("notes"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


def answer(hits: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer, citations): the first hits' titles with 360 characters of text, and where they come from.

    hits has query_id, id, rel_path, title, text, start_line, end_line, rank.
    """
    line = F.concat(
        F.lit("- "),
        F.coalesce(F.when(F.col("title") != "", F.col("title")), "rel_path", F.lit("Untitled")),
        F.lit(": "),
        F.substring(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), 1, 360),
    )
    rows = hits.withColumn("line", F.when((F.col("rank") <= most) & (F.trim("text") != ""), line))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line", "rel_path", "id", "start_line", "end_line")))
    return rows.groupBy("query_id").agg(ordered.alias("h")).select(
        "query_id",
        F.array_join(F.transform(F.filter("h", lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n").alias("answer"),
        F.transform("h", lambda x: x["rel_path"]).alias("citations"),
    )
