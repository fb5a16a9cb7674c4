"""The link graph: extracting links from text, resolving them, collapsing edges, walking, and re-ranking by links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import clean_path
from notarium.operators.mutations import sweep_links
from notarium.operators.sessions import session_prefix
from notarium.runtime import materialize

#: Front matter fields that name other notes, and the edge each makes, as fixed values.
FIELDS = {"related": "related", "source": "source", "project": "part_of", "topic": "about", "up": "parent"}
EDGE = "struct<target:string,edge_type:string,anchor:string,source_kind:string,confidence:double>"


def mask_code(text: Column) -> Column:
    """Fenced and inline code replaced by a blank."""
    fenced = F.regexp_replace(text, r"(?ms)^ {0,3}(```+|~~~+)[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", " ")
    return F.regexp_replace(fenced, r"`[^`\n]*`", " ")


def normal_target(target: Column) -> Column:
    """Without fragment, backslashes, surrounding slashes and .md."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(target, r"(?s)#.*$", "")), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:\./)+|^/+|/+$", ""), r"\.md$", "")


def basename_key(path: Column) -> Column:
    """Lower-case file name without .md, as links name it."""
    return F.regexp_replace(F.lower(F.substring_index(clean_path(path), "/", -1)), r"\.md$", "")


def links_in(text: Column, frontmatter: Column | None = None) -> Column:
    """Array of links (see EDGE) of a note: wiki links, qualified wiki links, Markdown links, front matter fields.

    Code is masked; images, addresses with a scheme and bare fragments are no links. frontmatter is a map of strings.
    Each (target, type, anchor, kind) comes once; null text gives an empty array.
    """
    masked = mask_code(F.coalesce(text, F.lit("")))

    def edge(target: Column, kind: str, anchor: Column, source: str, confidence: float) -> Column:
        return F.struct(
            target.alias("target"),
            F.lit(kind).alias("edge_type"),
            F.coalesce(F.trim(anchor), F.lit("")).alias("anchor"),
            F.lit(source).alias("source_kind"),
            F.lit(confidence).alias("confidence"),
        )

    def named(kind: str):
        return lambda v: edge(normal_target(v), kind, F.lit(""), "frontmatter", 0.9)

    def wiki(inner: Column) -> Column:
        parts = F.split(inner, r"\|", 2)
        kind = F.regexp_extract(inner, r"^([A-Za-z][\w-]*):", 1)
        plain = edge(normal_target(F.get(parts, F.lit(0))), "links_to", F.get(parts, F.lit(1)), "wikilink", 1.0)
        other = plain.withField("edge_type", F.concat(F.lit("wikilink:"), kind)).withField(
            "target", normal_target(F.regexp_replace(F.get(parts, F.lit(0)), r"^[A-Za-z][\w-]*:", ""))
        )
        return F.when(kind != "", other).otherwise(plain)

    wikis = F.transform(F.regexp_extract_all(masked, F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1)), wiki)
    rx = r"(?<!!)\[([^\]\n]*)\]\(([^)\s]+)[^)]*\)"
    anchors = F.regexp_extract_all(masked, F.lit(rx), F.lit(1))
    targets = F.regexp_extract_all(masked, F.lit(rx), F.lit(2))
    marks = F.filter(
        F.zip_with(targets, anchors, lambda t, a: F.struct(t.alias("t"), a.alias("a"))),
        lambda x: ~x["t"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.startswith(x["t"], F.lit("#")),
    )
    marks = F.transform(marks, lambda x: edge(normal_target(x["t"]), "links_to", x["a"], "markdown", 1.0))
    found = F.concat(wikis, marks)
    if frontmatter is not None:
        for field, kind in sorted(FIELDS.items()):
            value = F.try_element_at(frontmatter, F.lit(field))
            names = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda v: F.trim(F.regexp_replace(v, r"[\[\]\"']", ""))), lambda v: v != "")
            found = F.concat(found, F.transform(names, named(kind)))
    return F.array_distinct(F.filter(found.cast(f"array<{EDGE}>"), lambda x: x["target"] != ""))


def indexable(source: Column, target: Column, edge_type: Column, anchor: Column, kind: Column, collection: Column) -> Column:
    """Whether a link's fields have at most 300 characters and its key at most 1600 bytes."""
    fields = [source, target, edge_type, anchor, kind]
    short = F.lit(True)
    for f in fields:
        short = short & (F.length(F.coalesce(f, F.lit(""))) <= 300)
    return short & (F.octet_length(F.concat_ws("\x1f", collection, *fields)) <= 1600)


def expand_basenames(links: DataFrame, notes: DataFrame, most: int = 10) -> DataFrame:
    """links plus one wikilink_basename edge per note (at most `most`, by path) that a plain wiki link names by file name.

    links has collection_name, source_rel_path, target, edge_type, anchor, source_kind; notes has collection_name, rel_path.
    """
    w = Window.partitionBy("collection_name", "key").orderBy("rel_path")
    index = notes.select("collection_name", "rel_path", basename_key(F.col("rel_path")).alias("key"))
    index = index.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
    plain = links.where((F.col("source_kind") == "wikilink") & (F.col("edge_type") == "links_to") & ~F.contains("target", F.lit("/")))
    found = plain.withColumn("key", F.lower("target")).join(index, ["collection_name", "key"])
    extra = found.withColumn("target", F.regexp_replace("rel_path", r"\.md$", "")).withColumn("edge_type", F.lit("wikilink_basename"))
    return links.unionByName(extra.select(*links.columns))


def extract(notes: DataFrame, collections: DataFrame, basenames: bool = True) -> DataFrame:
    """Links of all notes (collection_name, source_rel_path, target, edge_type, anchor, source_kind, confidence), those that are
    too large left out; with basenames also the notes that plain wiki links name by file name.

    notes has collection_id, rel_path, markdown_text, frontmatter_json; collections has id, name.
    """
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    own = notes.join(names, "collection_id")
    fields = F.from_json(F.coalesce("frontmatter_json", F.lit("{}")), "map<string,string>")
    rows = own.select("collection_name", F.col("rel_path").alias("source_rel_path"), F.explode(links_in(F.col("markdown_text"), fields)).alias("l"))
    rows = rows.select("collection_name", "source_rel_path", "l.*")
    if basenames:
        rows = expand_basenames(rows, own.select("collection_name", "rel_path"))
    return rows.where(indexable(F.col("source_rel_path"), F.col("target"), F.col("edge_type"), F.col("anchor"), F.col("source_kind"), F.col("collection_name")))


def refresh(stored: DataFrame, notes: DataFrame, collections: DataFrame) -> DataFrame:
    """The link table after all notes were read again: found links are added or marked current, others of the same notes become
    stale, and links of notes that are gone are dropped; see mutations.sweep_links."""
    alive = notes.where(~F.col("status").eqNullSafe("deleted"))
    found = extract(alive, collections).withColumnsRenamed({"target": "target_identifier", "anchor": "anchor_text"})
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    return sweep_links(stored, materialize(found, "links"), alive.join(names, "collection_id").select("collection_name", "rel_path"))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, type): how often it occurs, its kinds and anchors, and the greatest confidence."""
    return edges.groupBy("source_rel_path", "target_identifier", "edge_type").agg(
        F.count("*").alias("provenance_count"),
        F.array_sort(F.collect_set("source_kind")).alias("source_kinds"),
        F.array_sort(F.collect_set(F.when(F.col("anchor_text") != "", F.col("anchor_text")))).alias("anchors"),
        F.max("confidence").alias("confidence"),
    )


def link_key(path: Column) -> Column:
    """Form in which sources and targets of links are compared: forward slashes, no .md."""
    return F.regexp_replace(clean_path(path), r"\.md$", "")


def backlinks(edges: DataFrame, identifiers: DataFrame, limit: int = 50) -> DataFrame:
    """The edges that lead to each identifier, best first."""
    return _nearest(edges, identifiers, "target_identifier", limit)


def neighbours(edges: DataFrame, identifiers: DataFrame, limit: int = 50) -> DataFrame:
    """The edges that leave each identifier, best first."""
    return _nearest(edges, identifiers, "source_rel_path", limit)


def _nearest(edges: DataFrame, identifiers: DataFrame, end: str, limit: int) -> DataFrame:
    own = identifiers.select("identifier", link_key(F.col("identifier")).alias("key")).distinct()
    w = Window.partitionBy("identifier").orderBy(F.desc("confidence"), F.desc("updated_at"), "id")
    hits = edges.withColumn("key", link_key(F.col(end))).join(own, "key").drop("key")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def traverse(
    edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "out", edge_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """(start, level, source, target, edge_type): edges reached breadth-first from each start, level by level.

    Each level joins the frontier with the edges and drops nodes already seen, so cost follows the edges touched. depth is
    held to 1..5. An edge counts once per start, at its first level. limit keeps the first edges by level, confidence and name.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    base = edges.where(F.col("edge_type") == edge_type) if edge_type else edges
    base = materialize(
        base.groupBy(
            link_key(F.col("source_rel_path")).alias("source"), link_key(F.col("target_identifier")).alias("target"), "edge_type"
        ).agg(F.max("confidence").alias("confidence")),
        "graph",
    )
    sides = []
    if direction in ("out", "both"):
        sides.append(base.select(F.col("source").alias("node"), F.col("target").alias("next"), "source", "target", "edge_type", "confidence"))
    if direction in ("in", "both"):
        sides.append(base.select(F.col("target").alias("node"), F.col("source").alias("next"), "source", "target", "edge_type", "confidence"))
    steps = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    frontier = materialize(starts.select("start", link_key(F.col("start")).alias("node")).distinct(), "frontier")
    seen, found = frontier, None
    for level in range(1, max(1, min(depth, 5)) + 1):
        reached = materialize(frontier.join(steps, "node").withColumn("level", F.lit(level)), "reached")
        part = reached.select("start", "level", "source", "target", "edge_type", "confidence")
        found = part if found is None else found.unionByName(part)
        frontier = materialize(
            reached.select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"), "frontier"
        )
        seen = seen.unionByName(frontier)
    once = found.groupBy("start", "source", "target", "edge_type").agg(
        F.min("level").alias("level"), F.max("confidence").alias("confidence")
    )
    if limit:
        w = Window.partitionBy("start").orderBy("level", F.desc("confidence"), "target", "source", "edge_type")
        once = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(limit, 1000))).drop("place")
    return once


def inbound_sources(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, rel_path, inbound): distinct other candidates of the query that link to each candidate."""
    pool = candidates.select("query_id", "rel_path", link_key(F.col("rel_path")).alias("key")).distinct()
    pairs = edges.select(link_key(F.col("source_rel_path")).alias("from"), link_key(F.col("target_identifier")).alias("to")).where(
        F.col("from") != F.col("to")
    ).distinct()
    hits = (
        pool.select("query_id", F.col("key").alias("from"))
        .join(pairs, "from")
        .join(pool.select("query_id", "rel_path", F.col("key").alias("to")), ["query_id", "to"])
    )
    return hits.groupBy("query_id", "rel_path").agg(F.count_distinct("from").alias("inbound"))


def graph_signals(candidates: DataFrame, edges: DataFrame, top_k: int = 20, ratio: float = 0.0) -> DataFrame:
    """Candidates (query_id, rel_path, score, rank) with the pool of the first top_k re-ranked by links; the tail stays.

    A candidate with two or more inbound sources in the pool gains 5 %; of several of one session prefix all but the best
    lose 5 %. Scores under ratio times the greatest are left alone.
    """
    k = max(3, min(top_k, 100))
    pool = candidates.where(F.col("rank") <= k)
    top = Window.partitionBy("query_id")
    floor = F.when(F.lit(ratio > 0), F.max("score").over(top) * ratio)
    boosted = pool.withColumn("_floor", floor).join(inbound_sources(pool, edges), ["query_id", "rel_path"], "left")
    able = F.col("_floor").isNull() | (F.col("score") >= F.col("_floor"))
    boosted = boosted.withColumn("score", F.when((F.col("inbound") >= 2) & able, F.col("score") * 1.05).otherwise(F.col("score")))
    boosted = boosted.withColumn("_prefix", session_prefix(F.col("rel_path")))
    own = Window.partitionBy("query_id", "_prefix").orderBy(F.desc("score"), "rel_path", "rank")
    able = F.col("_floor").isNull() | (F.col("score") >= F.col("_floor"))
    later = F.col("_prefix").isNotNull() & (F.row_number().over(own) > 1) & able
    demoted = boosted.withColumn("score", F.when(later, F.col("score") * 0.95).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rel_path", "rank")
    ranked = demoted.withColumn("place", F.row_number().over(w)).drop("_floor", "_prefix", "inbound")
    tail = candidates.where(F.col("rank") > k).withColumn("place", F.col("rank"))
    return ranked.unionByName(tail.select(*ranked.columns)).withColumn("score", F.round("score", 9))
