"""Joins and windows around chunks: neighbours, first and latest rows, overlapping ranges, prefixes.

A document may hold any share of the chunks: windows run over blocks of a document, ranges are laid out to equalities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import collapsed, snippet


def adjacent_texts(chunks: DataFrame, block: int = 256) -> DataFrame:
    """Chunks with prev_text and next_text of the same document and version.

    A document is cut into blocks of `block` indexes with a window each, so a document of any size spreads over many tasks;
    what stands at the edges of a block comes from a window over one row per block.
    """
    group = ["document_id", "version"]
    rows = chunks.withColumn("_block", F.floor(F.col("chunk_index") / block))
    inner = Window.partitionBy(*group, "_block").orderBy("chunk_index", "id")
    rows = rows.withColumns(
        {
            "_prev": F.lag(F.struct("text_content")).over(inner),
            "_next": F.lead(F.struct("text_content")).over(inner),
        }
    )
    ends = F.struct("chunk_index", "id", "text_content")
    edges = chunks.groupBy(*group, F.floor(F.col("chunk_index") / block).alias("_block")).agg(
        F.max(ends).alias("last"), F.min(ends).alias("first")
    )
    outer = Window.partitionBy(*group).orderBy("_block")
    edges = edges.select(
        *group, "_block", F.lag("last.text_content").over(outer).alias("_before"), F.lead("first.text_content").over(outer).alias("_after")
    )
    same = F.lit(True)
    for key in (*group, "_block"):
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"e.{key}"))
    joined = rows.alias("r").join(edges.alias("e"), same, "left")
    return joined.select(
        *[F.col(f"r.{c}") for c in chunks.columns],
        F.when(F.col("_prev").isNotNull(), F.col("_prev.text_content")).otherwise(F.col("_before")).alias("prev_text"),
        F.when(F.col("_next").isNotNull(), F.col("_next.text_content")).otherwise(F.col("_after")).alias("next_text"),
    )


def neighbour_window(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Each hit (document_id, chunk_index, hit columns) with the text and lines of the chunks around it.

    Every hit is laid out to the indexes it needs, so the range becomes an equality on document and index.
    """
    wanted = hits.withColumn(
        "near", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius))
    )
    near = chunks.select(
        "document_id", F.col("chunk_index").alias("near"), F.trim("text_content").alias("text"), "start_line", "end_line"
    )
    keys = [c for c in hits.columns]
    return (
        wanted.join(near, ["document_id", "near"])
        .groupBy(*keys)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", "text"))), lambda x: x["text"]), "\n").alias("window_text"),
            F.min("near").alias("first_index"),
            F.max("near").alias("last_index"),
            F.min("start_line").alias("window_start_line"),
            F.max("end_line").alias("window_end_line"),
        )
    )


def object_window(objects: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """(object_id, window_text, first_index, last_index, window_start_line, window_end_line) of knowledge objects.

    The window runs from the first to the last chunk that an object names, with `radius` more on each side; an object without
    known chunks gets those whose lines it overlaps. objects has id, document_id, source_chunk_ids, line_start, line_end.
    """
    named = objects.select(F.col("id").alias("object_id"), "document_id", F.explode("source_chunk_ids").alias("chunk_id"))
    places = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index")
    found = named.join(places, ["chunk_id", "document_id"]).select("object_id", "document_id", "chunk_index")
    rest = objects.join(found.select(F.col("object_id").alias("id")).distinct(), "id", "left_anti")
    lines = rest.select("id", "document_id", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))
    overlap = overlapping(lines, chunks.select("id", "document_id", "start_line", "end_line"))
    by_line = overlap.join(places.withColumnRenamed("chunk_id", "right_id"), ["right_id", "document_id"]).select(
        F.col("left_id").alias("object_id"), "document_id", "chunk_index"
    )
    wide = (
        found.withColumn("reach", F.lit(radius))
        .unionByName(by_line.withColumn("reach", F.lit(0)))
        .groupBy("object_id", "document_id")
        .agg((F.min("chunk_index") - F.max("reach")).alias("low"), (F.max("chunk_index") + F.max("reach")).alias("high"))
    )
    laid = wide.select("object_id", "document_id", F.explode(F.sequence("low", "high")).alias("chunk_index"))
    return (
        laid.join(chunks.select("document_id", "chunk_index", F.trim("text_content").alias("text"), "start_line", "end_line"), ["document_id", "chunk_index"])
        .groupBy("object_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("window_text"),
            F.min("chunk_index").alias("first_index"),
            F.max("chunk_index").alias("last_index"),
            F.min("start_line").alias("window_start_line"),
            F.max("end_line").alias("window_end_line"),
        )
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk): the chunk of least index per document."""
    row = F.struct("chunk_index", "id", "text_content")
    return chunks.groupBy("document_id").agg(F.min(row).alias("r")).select(
        "document_id", F.col("r.id").alias("first_id"), F.col("r.text_content").alias("first_text")
    )


def latest_objects(objects: DataFrame, object_type: str) -> DataFrame:
    """(document_id, object_id, title, body_text): the newest knowledge object of a type per document."""
    row = F.struct("id", "title", "body_text")
    return (
        objects.where(F.col("object_type") == object_type)
        .groupBy("document_id")
        .agg(F.max(row).alias("r"))
        .select("document_id", F.col("r.id").alias("object_id"), "r.title", "r.body_text")
    )


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): rows of one document whose line ranges overlap.

    Both have id, document_id, start_line, end_line. Ranges are laid out over blocks of 64 lines, so the join is an equality
    on document and block; each pair is kept in the first block that both touch.
    """

    def blocked(df: DataFrame, name: str) -> DataFrame:
        lines = [F.col(c).alias(f"{name}_{c}") for c in ("id", "start_line", "end_line")]
        return df.where("start_line <= end_line").select(
            "document_id",
            *lines,
            F.explode(F.sequence(F.floor(F.col("start_line") / 64), F.floor(F.col("end_line") / 64))).alias("block"),
        )

    both = blocked(left, "left").join(blocked(right, "right"), ["document_id", "block"])
    return both.where(
        (F.col("left_end_line") >= F.col("right_start_line"))
        & (F.col("left_start_line") <= F.col("right_end_line"))
        & (F.col("block") == F.floor(F.greatest("left_start_line", "right_start_line") / 64))
    ).select("document_id", "left_id", "right_id")


def remap_objects(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """(object_id, source_chunk_ids): the chunks whose lines each object overlaps, in order."""
    pairs = overlapping(
        objects.select("id", "document_id", "start_line", "end_line"), chunks.select("id", "document_id", "start_line", "end_line")
    )
    return pairs.groupBy(F.col("left_id").alias("object_id")).agg(
        F.array_sort(F.collect_set("right_id")).alias("source_chunk_ids")
    )


def prefix_contexts(notes: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, contexts): the context texts whose path prefix covers the note, longest prefix first.

    A path is laid out to its own prefixes, so the join is an equality on collection and prefix.
    contexts has collection_id, prefix, context_id, context_text.
    """
    parts = F.split("rel_path", "/")
    own = notes.select(
        "id",
        "collection_id",
        F.explode(
            F.concat(
                F.array(F.lit("")),
                F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
            )
        ).alias("prefix"),
    )
    order = F.struct((-F.length("prefix")).alias("n"), "context_id", "context_text")
    return (
        own.join(contexts, ["collection_id", "prefix"])
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["context_text"]).alias("contexts"))
    )


def object_template(rows: DataFrame) -> DataFrame:
    """rows with embedding_text for knowledge objects: where they stand, their type and title, and their text.

    rows has collection_name, rel_path, title, object_type, object_title, document_summary and body_text.
    """
    summary = collapsed(F.col("document_summary"))
    labels = {
        "Collection": "collection_name", "Relative path": "rel_path", "Document title": "title",
        "Knowledge object type": "object_type", "Object title": "object_title",
    }
    lines = [F.concat(F.lit(f"{label}: "), collapsed(F.col(c))) for label, c in labels.items()]
    lines.append(F.when(summary != "", F.concat(F.lit("Document summary: "), summary)))
    lines.append(F.concat(F.lit("Knowledge text: "), collapsed(F.col("body_text"))))
    return rows.withColumn("embedding_text", F.trim(F.concat_ws("\n", *lines)))


def context_template(rows: DataFrame) -> DataFrame:
    """rows with embedding_text: the passage with where it stands and what surrounds it. The labels are fixed values.

    rows has collection_name, rel_path, title, heading_path, segment_summary, document_summary, contexts (array), prev_text,
    next_text and text_content.
    """

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    kept = F.filter(F.transform(F.coalesce("contexts", F.array().cast("array<string>")), collapsed), lambda c: c != "")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Collection: "), collapsed(F.col("collection_name"))),
        F.concat(F.lit("Relative path: "), collapsed(F.col("rel_path"))),
        F.concat(F.lit("Document title: "), collapsed(F.col("title"))),
        line("Heading path", collapsed(F.col("heading_path"))),
        line("Section summary", collapsed(F.col("segment_summary"))),
        line("Document summary", collapsed(F.col("document_summary"))),
        F.when(F.size(kept) > 0, F.concat(F.lit("Context: "), F.array_join(kept, " | "))),
        line("Previous context", snippet(F.col("prev_text"), 18)),
        line("Next context", snippet(F.col("next_text"), 18)),
        F.concat(F.lit("Passage: "), collapsed(F.col("text_content"))),
    )
    return rows.withColumn("embedding_text", F.trim(text))
