"""Queries over stored notes and chunks: statistics, windows, refresh, and text functions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions import text as T
from notarium.functions import validation
from notarium.operators import clusters, knowledge, mutations, refresh, stats, vectors, windows
from notarium.sources.tables import table


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, of which rows that were delivered twice count once."""
    return table(spark, folder, "vq_chunks").dropDuplicates(["id"])


def _stat_chunks(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "vq_chunks").select("id", "document_id", "chunk_index", "token_count", "char_count", "qdrant_point_id")
    return own.dropDuplicates(["id"]).withColumn("embedded", F.coalesce(F.trim("qdrant_point_id"), F.lit("")) != "")


_CHUNKS = "chunks AS (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for it."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


_SUMMARY = f"""
WITH {_CHUNKS}, s AS (
  SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
    round(avg(token_count), 2) AS avg_tokens,
    round(quantile_cont(token_count, 0.5), 6) AS p50_tokens, round(quantile_cont(token_count, 0.75), 6) AS p75_tokens,
    round(quantile_cont(token_count, 0.9), 6) AS p90_tokens, round(quantile_cont(token_count, 0.95), 6) AS p95_tokens,
    round(quantile_cont(token_count, 0.99), 6) AS p99_tokens,
    CAST(sum(token_count) AS BIGINT) AS total_tokens, CAST(sum(char_count) AS BIGINT) AS total_chars,
    count(*) FILTER (WHERE token_count > 320) AS over_max_chunks, count(*) FILTER (WHERE token_count < 120) AS under_min_chunks,
    count(*) FILTER (WHERE coalesce(trim(qdrant_point_id), '') <> '') AS embedded_chunks
  FROM chunks)
"""


@query(_SUMMARY + "SELECT * FROM s")
def chunk_stats_summary(spark, folder):
    """Length statistics of all chunks."""
    return stats.chunk_summary(_stat_chunks(spark, folder))


@query(
    f"""WITH {_CHUNKS} SELECT CASE WHEN token_count < 120 THEN 'under_min' WHEN token_count <= 220 THEN 'min_to_target'
  WHEN token_count <= 320 THEN 'target_to_max' WHEN token_count <= 640 THEN 'max_to_double' ELSE 'over_double' END AS bucket,
  count(*) AS chunks, min(token_count) AS shortest FROM chunks GROUP BY 1"""
)
def chunk_stats_buckets(spark, folder):
    """Histogram of chunk lengths."""
    return stats.chunk_buckets(_stat_chunks(spark, folder))


@query(
    _SUMMARY
    + """SELECT s.*, CASE WHEN chunks > 0 THEN round(over_max_chunks * 100.0 / chunks, 2) ELSE 0 END AS over_pct,
  CASE WHEN chunks > 0 THEN round(under_min_chunks * 100.0 / chunks, 2) ELSE 0 END AS under_pct,
  CASE WHEN chunks = 0 THEN 'no_chunks' WHEN p95_tokens > 320 OR over_max_chunks * 100.0 / chunks > 10 OR max_tokens > 960 THEN 'too_long'
    WHEN under_min_chunks * 100.0 / chunks > 45 THEN 'too_short' ELSE 'healthy' END AS assessment FROM s"""
)
def chunk_health(spark, folder):
    """Statistics with the assessment of the chunk lengths."""
    return stats.health(stats.chunk_summary(_stat_chunks(spark, folder)))


@query(
    f"""WITH {_CHUNKS} SELECT c.id, d.rel_path, c.chunk_index, c.token_count, c.char_count FROM chunks c JOIN vq_documents d ON d.id = c.document_id
  ORDER BY token_count DESC, rel_path, chunk_index, c.id LIMIT 12"""
)
def longest_chunks(spark, folder):
    """The twelve longest chunks."""
    return stats.longest_chunks(_stat_chunks(spark, folder), table(spark, folder, "vq_documents"))


@query(
    """SELECT 'collections' AS what, count(*) AS n, 0 AS pending FROM vq_collections UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE status <> 'enriched') FROM vq_documents
  UNION ALL SELECT 'chunks', count(*), count(*) FILTER (WHERE coalesce(trim(qdrant_point_id), '') = '') FROM vq_chunks
  UNION ALL SELECT 'links', count(*), count(*) FILTER (WHERE stale) FROM vq_links"""
)
def status_counts(spark, folder):
    """Rows of every table, and how many of them wait for something."""
    waits = {
        "collections": ("vq_collections", F.lit(False)),
        "documents": ("vq_documents", F.col("status") != "enriched"),
        "chunks": ("vq_chunks", F.coalesce(F.trim("qdrant_point_id"), F.lit("")) == ""),
        "links": ("vq_links", F.col("stale")),
    }
    parts = [table(spark, folder, t).agg(F.lit(n).alias("what"), F.count("*").alias("n"), F.count_if(w).alias("pending")) for n, (t, w) in waits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT id, name, root_path, pattern FROM vq_collections ORDER BY name")
def collection_list(spark, folder):
    """Collections by name."""
    return table(spark, folder, "vq_collections").select("id", "name", "root_path", "pattern").orderBy("name")


@query("SELECT collection_id, status, count(*) AS notes, CAST(sum(length(markdown_text)) AS BIGINT) AS chars FROM vq_documents GROUP BY ALL")
def notes_by_status(spark, folder):
    """Notes and characters per collection and status."""
    return table(spark, folder, "vq_documents").groupBy("collection_id", "status").agg(
        F.count("*").alias("notes"), F.sum(F.length("markdown_text")).alias("chars")
    )


@query(
    f"""WITH {_CHUNKS} SELECT id, lag(text_content) OVER w AS prev_text, lead(text_content) OVER w AS next_text FROM chunks
  WINDOW w AS (PARTITION BY document_id, version ORDER BY chunk_index, id)"""
)
def lag_lead_context(spark, folder):
    """The texts before and after every chunk."""
    return windows.adjacent_texts(chunks_of(spark, folder)).select("id", "prev_text", "next_text")


@query(
    """WITH hits AS (SELECT DISTINCT CAST(split_part(point_id, ':', 2) AS BIGINT) AS id FROM search_hits WHERE point_id LIKE 'chunk:%'),
  c AS (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
  h AS (SELECT c.id, c.document_id, c.chunk_index FROM c JOIN hits USING (id))
  SELECT h.id, string_agg(trim(n.text_content), chr(10) ORDER BY n.chunk_index) AS window_text, min(n.chunk_index) AS first_index,
    max(n.chunk_index) AS last_index, min(n.start_line) AS window_start_line, max(n.end_line) AS window_end_line
  FROM h JOIN c n ON n.document_id = h.document_id AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY h.id"""
)
def neighbour_window(spark, folder):
    """Text and lines around every chunk that some search returned."""
    chunks = chunks_of(spark, folder)
    hits = table(spark, folder, "search_hits").select(F.regexp_extract("point_id", r"^chunk:(\d+)$", 1).try_cast("bigint").alias("id")).distinct()
    own = chunks.select("id", "document_id", "chunk_index").join(hits, "id")
    return windows.neighbour_window(own, chunks).drop("document_id", "chunk_index")


@query(
    f"""WITH {_CHUNKS} SELECT d.id AS document_id, f.id AS first_id, f.text_content AS first_text FROM (SELECT DISTINCT document_id AS id FROM chunks) d
  JOIN LATERAL (SELECT c.id, c.text_content FROM chunks c WHERE c.document_id IS NOT DISTINCT FROM d.id ORDER BY chunk_index, c.id LIMIT 1) f ON TRUE"""
)
def lateral_first_chunk(spark, folder):
    """First chunk of every document."""
    return windows.first_chunks(chunks_of(spark, folder))


_OBJECTS = f"""{_CHUNKS}, objects AS (
  SELECT id * 2 AS id, document_id, 'concept' AS object_type, section_title AS title, text_content AS body_text, id AS chunk_id,
    start_line AS line_start, end_line AS line_end, round(1.0 / (1 + chunk_index), 6) AS confidence
  FROM chunks WHERE coalesce(trim(section_title), '') <> ''
  UNION ALL
  SELECT id * 2 + 1, document_id, 'segment_summary', section_title, text_content, id, start_line, end_line, 0.5 FROM chunks)"""


@query(
    f"WITH {_OBJECTS} SELECT document_id, id AS object_id, title, body_text FROM objects WHERE object_type = 'segment_summary' "
    "QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id DESC) = 1"
)
def lateral_latest(spark, folder):
    """Newest summary of every document."""
    return windows.latest_objects(knowledge.objects_from_sections(chunks_of(spark, folder)), "segment_summary")


@query(
    f"""WITH {_OBJECTS}, keyed AS (SELECT *, CASE WHEN object_type = 'segment_summary' OR trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) = ''
    THEN chr(0) || id ELSE trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) END AS k FROM objects)
  SELECT min(id) AS id, document_id, object_type, arg_max(title, (length(body_text), -id)) AS title, arg_max(body_text, (length(body_text), -id)) AS body_text,
    list_sort(list_distinct(list(chunk_id))) AS source_chunk_ids, min(line_start) AS line_start, max(line_end) AS line_end, max(confidence) AS confidence
  FROM keyed GROUP BY document_id, object_type, k"""
)
def knowledge_dedupe(spark, folder):
    """Knowledge objects merged per document, type and title."""
    return knowledge.merge_objects(knowledge.objects_from_sections(chunks_of(spark, folder)))


@query(
    f"""WITH {_CHUNKS}, o AS (SELECT id, document_id, start_line + 3 AS start_line, end_line + 5 AS end_line FROM chunks)
  SELECT o.id AS object_id, list_sort(list_distinct(list(c.id))) AS source_chunk_ids FROM o JOIN chunks c
    ON c.document_id = o.document_id AND o.end_line >= c.start_line AND o.start_line <= c.end_line GROUP BY o.id"""
)
def remap_overlap(spark, folder):
    """Chunks whose lines overlap those of objects that moved."""
    chunks = chunks_of(spark, folder)
    moved = chunks.select("id", "document_id", (F.col("start_line") + 3).alias("start_line"), (F.col("end_line") + 5).alias("end_line"))
    return windows.remap_objects(moved, chunks)


@query(
    f"""WITH {_CHUNKS}
  SELECT c.id, (SELECT min(s.id) FROM chunks s WHERE s.document_id = c.document_id AND s.end_line >= c.start_line AND s.start_line <= c.end_line) AS segment_id
  FROM chunks c"""
)
def range_overlap_top1(spark, folder):
    """The first segment (any chunk of the note) that overlaps the lines of every chunk."""
    chunks = chunks_of(spark, folder)
    pairs = windows.overlapping(chunks, chunks)
    best = pairs.groupBy(F.col("left_id").alias("id")).agg(F.min("right_id").alias("segment_id"))
    return chunks.select("id").join(best, "id", "left")


_CONTEXTS = """contexts AS (
  SELECT collection_id, regexp_extract(rel_path, '^[^/]+') AS prefix, min(id) AS context_id, 'folder ' || regexp_extract(rel_path, '^[^/]+') AS context_text
  FROM vq_documents GROUP BY collection_id, regexp_extract(rel_path, '^[^/]+')
  UNION ALL SELECT id, '', -id, 'collection ' || name FROM vq_collections)"""


def _contexts(spark, folder):
    top = F.substring_index("rel_path", "/", 1)
    folders = table(spark, folder, "vq_documents").groupBy("collection_id", top.alias("prefix")).agg(F.min("id").alias("context_id"))
    folders = folders.withColumn("context_text", F.concat(F.lit("folder "), "prefix"))
    whole = table(spark, folder, "vq_collections").select(
        F.col("id").alias("collection_id"), F.lit("").alias("prefix"), (-F.col("id")).alias("context_id"), F.concat(F.lit("collection "), "name").alias("context_text")
    )
    return folders.unionByName(whole)


@query(
    f"""WITH {_CONTEXTS} SELECT d.id, list(x.context_text ORDER BY length(x.prefix) DESC, x.context_id) AS contexts
  FROM vq_documents d JOIN contexts x ON x.collection_id = d.collection_id AND (x.prefix = '' OR d.rel_path = x.prefix OR starts_with(d.rel_path, x.prefix || '/'))
  GROUP BY d.id"""
)
def prefix_contexts(spark, folder):
    """Context texts that cover each note's path."""
    return windows.prefix_contexts(table(spark, folder, "vq_documents"), _contexts(spark, folder))


def _collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _snip(c: str) -> str:
    w = f"list_filter(string_split({_collapse(c)}, ' '), lambda w: w <> '')"
    return f"CASE WHEN len({w}) <= 18 THEN array_to_string({w}, ' ') ELSE array_to_string(({w})[1:18], ' ') || ' ...' END"


@query(
    f"""WITH {_CHUNKS}, l AS (SELECT *, lag(text_content) OVER w AS prev_text, lead(text_content) OVER w AS next_text FROM chunks
    WINDOW w AS (PARTITION BY document_id, version ORDER BY chunk_index, id)),
  t AS (SELECT l.id, k.name, d.rel_path, d.title, {_collapse('l.heading_path')} AS h, {_snip('prev_text')} AS p, {_snip('next_text')} AS n, l.text_content
    FROM l JOIN vq_documents d ON d.id = l.document_id JOIN vq_collections k ON k.id = d.collection_id)
  SELECT id, trim(concat_ws(chr(10), 'Collection: ' || {_collapse('name')}, 'Relative path: ' || {_collapse('rel_path')}, 'Document title: ' || {_collapse('title')},
    CASE WHEN h <> '' THEN 'Heading path: ' || h END, CASE WHEN p <> '' THEN 'Previous context: ' || p END,
    CASE WHEN n <> '' THEN 'Next context: ' || n END, 'Passage: ' || {_collapse('text_content')})) AS embedding_text FROM t"""
)
def context_template(spark, folder):
    """The text that is embedded for every chunk."""
    notes = table(spark, folder, "vq_documents").select(F.col("id").alias("document_id"), "collection_id", "rel_path", "title")
    names = table(spark, folder, "vq_collections").select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    rows = windows.adjacent_texts(chunks_of(spark, folder)).join(notes, "document_id").join(names, "collection_id")
    rows = rows.withColumns(
        {c: F.lit(None).cast("string") for c in ("segment_summary", "document_summary")} | {"contexts": F.lit(None).cast("array<string>")}
    )
    return windows.context_template(rows).select("id", "embedding_text")


def _est(c: str) -> str:
    clean = _collapse(c)
    return f"""greatest(1, coalesce(list_sum(list_transform(list_filter(string_split({clean}, ' '), lambda w: w <> ''), lambda w: greatest(2, (length(w) + 2) // 3))), 0), (length({clean}) + 2) // 3)"""


@query(f"WITH {_CHUNKS} SELECT id, CAST({_est('text_content')} AS INTEGER) AS tokens FROM chunks")
def embed_token_estimate(spark, folder):
    """Estimated embedding tokens of every chunk."""
    return chunks_of(spark, folder).select("id", T.embedding_tokens(F.col("text_content")).alias("tokens"))


def _bounded(c: str, most: int) -> str:
    """Rows (id, bounded) of the CTE src(id, t): the longest run of first words within `most` estimated tokens."""
    return f"""w AS (SELECT id, {_collapse('t')} AS clean, list_filter(string_split({_collapse('t')}, ' '), lambda x: x <> '') AS own, {_est('t')} AS whole FROM src),
  o AS (SELECT id, unnest(own) AS word, generate_subscripts(own, 1) AS k FROM w),
  r AS (SELECT id, k, sum(greatest(2, (length(word) + 2) // 3)) OVER (PARTITION BY id ORDER BY k) AS used, sum(length(word) + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS chars FROM o),
  f AS (SELECT id, max(chars) AS chars FROM r WHERE greatest(used, (chars + 2) // 3) <= {most} GROUP BY id)
  SELECT w.id, CASE WHEN whole <= {most} THEN clean WHEN f.chars > 0 THEN substring(clean, 1, CAST(f.chars AS BIGINT)) ELSE trim(substring(clean, 1, {3 * most})) END AS bounded FROM w LEFT JOIN f USING (id)"""


@query("BOUNDED")
def bounded_text(spark, folder):
    """Every note cut to 6000 estimated tokens, the budget of an embedding request."""
    return table(spark, folder, "vq_documents").select("id", T.bounded_text(F.col("markdown_text")).alias("bounded"))


@query("BOUNDED CHUNKS")
def bounded_chunks(spark, folder):
    """Every chunk cut to 64 estimated tokens."""
    return chunks_of(spark, folder).select("id", T.bounded_text(F.col("text_content"), 64).alias("bounded"))


SQL["bounded_text"] = "WITH src AS (SELECT id, markdown_text AS t FROM vq_documents), " + _bounded("t", 6000)
SQL["bounded_chunks"] = f"WITH {_CHUNKS}, src AS (SELECT id, text_content AS t FROM chunks), " + _bounded("t", 64)


@query(
    f"""WITH RECURSIVE c AS (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
  items AS (SELECT document_id AS source_key, chunk_index AS item_no, {_est('text_content')} AS tokens, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS k
    FROM c WHERE coalesce(trim(qdrant_point_id), '') = '' AND document_id IS NOT NULL),
  walk AS (SELECT source_key, item_no, tokens, k, tokens AS used, 1 AS cnt, 0 AS batch_no FROM items WHERE k = 1
    UNION ALL SELECT i.source_key, i.item_no, i.tokens, i.k, CASE WHEN w.used + i.tokens > 12000 OR w.cnt >= 32 THEN i.tokens ELSE w.used + i.tokens END,
      CASE WHEN w.used + i.tokens > 12000 OR w.cnt >= 32 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.used + i.tokens > 12000 OR w.cnt >= 32 THEN w.batch_no + 1 ELSE w.batch_no END
    FROM walk w JOIN items i ON i.source_key = w.source_key AND i.k = w.k + 1)
  SELECT source_key, item_no, CAST(tokens AS INTEGER) AS tokens, batch_no FROM walk"""
)
def embed_batches(spark, folder):
    """Waiting chunks packed into windows of 12,000 tokens and 32 chunks of one note."""
    waiting = vectors.pending(chunks_of(spark, folder)).where(F.col("document_id").isNotNull())
    return vectors.pack_through(
        waiting.select(F.col("document_id").alias("source_key"), F.col("chunk_index").alias("item_no"), F.col("text_content").alias("text"))
    )


@query(
    SQL["embed_batches"].replace("SELECT source_key, item_no, CAST(tokens AS INTEGER) AS tokens, batch_no FROM walk", """, g AS (SELECT source_key, batch_no, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM walk GROUP BY ALL),
  n AS (SELECT *, abs(hash_part) % 64 AS lane FROM (SELECT *, source_key AS hash_part FROM g)), o AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY source_key, batch_no) AS k FROM n),
  req AS (SELECT lane, source_key, batch_no, items, tokens, k, items AS used, tokens AS used_tokens, 1 AS cnt, 0 AS request_no FROM o WHERE k = 1
    UNION ALL SELECT o.lane, o.source_key, o.batch_no, o.items, o.tokens, o.k, CASE WHEN f THEN o.items ELSE r.used + o.items END, CASE WHEN f THEN o.tokens ELSE r.used_tokens + o.tokens END,
      CASE WHEN f THEN 1 ELSE r.cnt + 1 END, CASE WHEN f THEN r.request_no + 1 ELSE r.request_no END
    FROM (SELECT r.*, o2.k AS nk, r.cnt >= 4 OR r.used + o2.items > 384 OR r.used_tokens + o2.tokens > 40000 AS f FROM req r JOIN o o2 ON o2.lane = r.lane AND o2.k = r.k + 1) r JOIN o ON o.lane = r.lane AND o.k = r.nk)
  SELECT lane, source_key, batch_no, request_no, items, tokens FROM req""")
)
def embed_requests(spark, folder):
    """Windows packed into requests of 4 windows, 384 chunks and 40,000 tokens, in 64 lanes of notes."""
    return vectors.pack_requests(embed_batches(spark, folder), 64)


@query(
    f"""WITH RECURSIVE {_CHUNKS}, p AS (SELECT id, 100 + 12 * 64 + octet_length(encode(coalesce(text_content, ''))) AS size, id % 64 AS lane FROM chunks WHERE coalesce(trim(qdrant_point_id), '') = ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) AS k FROM p),
  w AS (SELECT lane, id, size, k, size AS used, 1 AS cnt, 0 AS batch_no FROM o WHERE k = 1
    UNION ALL SELECT o.lane, o.id, o.size, o.k, CASE WHEN w.used + o.size > 65536 OR w.cnt >= 40 THEN o.size ELSE w.used + o.size END, CASE WHEN w.used + o.size > 65536 OR w.cnt >= 40 THEN 1 ELSE w.cnt + 1 END,
      CASE WHEN w.used + o.size > 65536 OR w.cnt >= 40 THEN w.batch_no + 1 ELSE w.batch_no END FROM w JOIN o ON o.lane = w.lane AND o.k = w.k + 1)
  SELECT lane, id, CAST(size AS INTEGER) AS size, batch_no FROM w"""
)
def upsert_batches(spark, folder):
    """Waiting points packed into writes of 40 points and 64 kB, in 64 lanes."""
    waiting = vectors.pending(chunks_of(spark, folder))
    size = (F.lit(100 + 12 * 64) + F.octet_length(F.coalesce("text_content", F.lit("")))).alias("size")
    return vectors.pack_points(waiting.select("id", size), 64, 40, 65_536)


@query(
    f"""WITH {_CHUNKS}, p AS (SELECT id, 0 AS kind_no FROM chunks WHERE coalesce(trim(qdrant_point_id), '') = '' UNION ALL SELECT id, 1 FROM vq_documents WHERE status = 'indexed')
  SELECT id, kind_no FROM (SELECT *, row_number() OVER (PARTITION BY kind_no ORDER BY id) AS n FROM p) WHERE n <= 200 ORDER BY n, kind_no LIMIT 200"""
)
def pending_split(spark, folder):
    """Two hundred waiting rows, half chunks and half notes."""
    first = vectors.pending(chunks_of(spark, folder)).select("id")
    second = table(spark, folder, "vq_documents").where("status = 'indexed'").select("id")
    return vectors.split_limit(first, second, 200, ["id"])


@query(
    f"""WITH {_CHUNKS}, h AS (SELECT id, sha1(unhex('{T.NAMESPACE_URL}') || encode('notes:chunk:' || id)) AS h FROM chunks)
  SELECT id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], format('{{:x}}', (CAST('0x' || h[17:17] AS INTEGER) & 3) | 8) || h[18:20], h[21:32]) AS point_id FROM h"""
)
def point_uuid5(spark, folder):
    """Name-based point id of every chunk."""
    return chunks_of(spark, folder).select("id", T.name_uuid(F.concat(F.lit("notes:chunk:"), F.col("id").cast("string"))).alias("point_id"))


@query(
    """WITH a AS (SELECT collection_id, rel_path, max(file_mtime) AS t FROM file_listing WHERE run_id <= 24 GROUP BY ALL),
  b AS (SELECT collection_id, rel_path, max(file_mtime) AS t FROM file_listing WHERE run_id > 24 GROUP BY ALL)
  SELECT * FROM (SELECT coalesce(a.collection_id, b.collection_id) AS collection_id, coalesce(a.rel_path, b.rel_path) AS rel_path,
    CASE WHEN a.rel_path IS NULL THEN 'new' WHEN b.rel_path IS NULL THEN 'deleted' WHEN a.t IS DISTINCT FROM b.t THEN 'changed' END AS change
    FROM a FULL JOIN b ON a.collection_id = b.collection_id AND a.rel_path = b.rel_path) WHERE change IS NOT NULL"""
)
def snapshot_diff(spark, folder):
    """Files that differ between the earlier and the later half of the scans."""
    seen = table(spark, folder, "file_listing")
    one, two = (
        seen.where(c).groupBy("collection_id", "rel_path").agg(F.max("file_mtime").alias("t")) for c in ("run_id <= 24", "run_id > 24")
    )
    return refresh.snapshot_diff(one, two, ["collection_id", "rel_path"], ["t"])


@query(
    """WITH l AS (SELECT * FROM file_listing QUALIFY row_number() OVER (PARTITION BY collection_id, rel_path ORDER BY file_mtime DESC, listing_id DESC) = 1),
  o AS (SELECT *, TRY_CAST(json_extract_string(metadata_json, '$.file_size') AS BIGINT) AS s, TRY_CAST(json_extract_string(metadata_json, '$.file_mtime_ns') AS BIGINT) // 1000 AS m FROM vq_documents)
  SELECT coalesce(o.collection_id, l.collection_id) AS collection_id, coalesce(o.rel_path, l.rel_path) AS rel_path,
    CASE WHEN o.id IS NULL THEN 'new' WHEN l.listing_id IS NULL THEN 'deleted' WHEN o.m IS NULL AND o.s = l.file_size THEN 'backfill'
      WHEN o.m IS NULL AND o.s IS NULL AND epoch_us(l.file_mtime) <= epoch_us(o.updated_at) + 2000000 THEN 'backfill'
      WHEN o.m = epoch_us(l.file_mtime) AND o.s = l.file_size THEN 'unchanged' ELSE 'changed' END AS action
  FROM o FULL JOIN l ON o.collection_id = l.collection_id AND o.rel_path = l.rel_path"""
)
def refresh_classify(spark, folder):
    """Every file as new, backfill, unchanged, changed or deleted."""
    row = F.max(F.struct("file_mtime", "listing_id", "file_size")).alias("r")
    listed = table(spark, folder, "file_listing").groupBy("collection_id", "rel_path").agg(row)
    listed = listed.select("collection_id", "rel_path", "r.file_size", "r.file_mtime")
    return refresh.classify_refresh(table(spark, folder, "vq_documents"), listed)


@query(
    """WITH s AS (SELECT DISTINCT collection_id, rel_path FROM file_listing WHERE run_id = (SELECT max(run_id) FROM file_listing))
  SELECT id FROM vq_documents d WHERE status <> 'deleted' AND NOT EXISTS (SELECT 1 FROM s WHERE s.collection_id = d.collection_id AND s.rel_path = d.rel_path)"""
)
def deleted_anti(spark, folder):
    """Notes whose file the last scan has not seen."""
    seen = table(spark, folder, "file_listing")
    last = seen.agg(F.max("run_id").alias("run_id"))
    listed = seen.join(F.broadcast(last), "run_id").select("collection_id", "rel_path")  # one row
    notes = table(spark, folder, "vq_documents").where("status <> 'deleted'")
    return notes.join(listed, ["collection_id", "rel_path"], "left_anti").select("id")


_CHANGED = """changed AS (SELECT d.id FROM vq_documents d JOIN (SELECT * FROM file_listing QUALIFY row_number() OVER (PARTITION BY collection_id, rel_path ORDER BY file_mtime DESC, listing_id DESC) = 1) l
    ON l.collection_id = d.collection_id AND l.rel_path = d.rel_path WHERE regexp_extract(lower(l.file_hash), '([0-9a-f]*)\\s*$', 1) IS DISTINCT FROM regexp_extract(lower(d.file_hash), '([0-9a-f]*)\\s*$', 1))"""


def _changed(spark, folder):
    """Ids of the notes whose latest listed hash is not the stored one."""
    from notarium.operators.incremental import checksum, latest_sightings

    latest = latest_sightings(table(spark, folder, "file_listing")).select("collection_id", "rel_path", "checksum")
    stored = table(spark, folder, "vq_documents").select("id", "collection_id", "rel_path", checksum(F.col("file_hash")).alias("stored"))
    return stored.join(latest, ["collection_id", "rel_path"]).where(~F.col("checksum").eqNullSafe(F.col("stored"))).select("id")


@query(
    f"""WITH {_CHUNKS}, {_CHANGED}, fresh AS (SELECT id, document_id, 2 AS version FROM chunks WHERE document_id IN (SELECT id FROM changed))
  SELECT id, document_id, version FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT * FROM fresh"""
)
def replace_chunks(spark, folder):
    """Chunks after those of all changed notes were written anew."""
    own = chunks_of(spark, folder).select("id", "document_id", "version")
    fresh = own.join(_changed(spark, folder).withColumnRenamed("id", "document_id"), "document_id", "left_semi").withColumn("version", F.lit(2))
    return refresh.replace_rows(own, fresh.select(own.columns), "document_id")


@query(
    """WITH fresh AS (SELECT collection_id, rel_path, regexp_extract(lower(file_hash), '([0-9a-f]*)\\s*$', 1) AS file_hash FROM file_listing
    QUALIFY row_number() OVER (PARTITION BY collection_id, rel_path ORDER BY file_mtime DESC, listing_id DESC) = 1)
  SELECT collection_id, rel_path, file_hash FROM fresh UNION SELECT collection_id, rel_path, file_hash FROM vq_documents d
    WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.collection_id = d.collection_id AND f.rel_path = d.rel_path)"""
)
def upsert_documents(spark, folder):
    """Stored hashes after the latest listing was merged in."""
    from notarium.operators.incremental import latest_sightings

    fresh = latest_sightings(table(spark, folder, "file_listing")).select("collection_id", "rel_path", F.col("checksum").alias("file_hash"))
    current = table(spark, folder, "vq_documents").select("collection_id", "rel_path", "file_hash")
    return refresh.upsert(current, fresh, ["collection_id", "rel_path"], "file_hash")


@query(
    """SELECT DISTINCT point_id FROM (SELECT qdrant_point_id AS point_id FROM vq_chunks WHERE coalesce(trim(qdrant_point_id), '') <> ''
  UNION SELECT point_id FROM search_hits WHERE point_id IS NOT NULL)"""
)
def union_point_ids(spark, folder):
    """All point ids that are known anywhere."""
    one = table(spark, folder, "vq_chunks").where("coalesce(trim(qdrant_point_id), '') <> ''").select(F.col("qdrant_point_id").alias("point_id"))
    return one.union(table(spark, folder, "search_hits").where("point_id IS NOT NULL").select("point_id")).distinct()


@query(
    """SELECT id, 'vault_note' AS source_class FROM vq_documents WHERE FALSE UNION ALL SELECT id, CASE WHEN starts_with(rel_path, '88_Agents/sessions/') THEN 'agent_session'
  WHEN starts_with(rel_path, '14_Agent_Workspace/') THEN 'agent_workspace'
  WHEN len(list_intersect(regexp_split_to_array(lower(rel_path), '[/ ._-]+'), string_split('article articles blog blogs clipping clippings import imported libraries library readwise resource resources source sources text texts', ' '))) > 0
  THEN 'imported_text' ELSE 'vault_note' END FROM vq_documents"""
)
def source_class(spark, folder):
    """Class of every note's source."""
    return table(spark, folder, "vq_documents").select("id", T.source_class(F.col("rel_path")).alias("source_class"))


@query(
    """WITH s AS (SELECT id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s_-]', '', 'g'), '[\\s_]+', '-', 'g') AS b FROM vq_documents),
  t AS (SELECT id, regexp_replace(substring(regexp_replace(b, '-+', '-', 'g'), 1, 80), '^-+|-+$', '', 'g') AS slug FROM s) SELECT id, CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS slug FROM t"""
)
def slugify(spark, folder):
    """Slug of every note's title."""
    return table(spark, folder, "vq_documents").select("id", T.slug(F.col("title")).alias("slug"))


@query(
    """WITH m AS (SELECT event_id, 'Authorization: Bearer ' || event_type || user_id || ' token=' || user_id || ', {"api_key": "k-' || user_id || '", "password": "p' || user_id || '", "n": 1} api-key: '
    || user_id || ' PASSWORD=' || event_type || ' done' AS t FROM events)
  SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(Bearer\\s+)[A-Za-z0-9._~+/=-]+', '\\1<redacted>', 'g'),
    '(?i)(api[_-]?key[''"\\s:=]+)[A-Za-z0-9._~+/=-]+', '\\1<redacted>', 'g'), '(?i)(password[''"\\s:=]+)[^\\s''"}]+', '\\1<redacted>', 'g'), '(token=)[^\\s,]+', '\\1<redacted>', 'g') AS message FROM m"""
)
def redact_secrets(spark, folder):
    """Event messages, also with JSON in them, without the secrets."""
    user = F.col("user_id").cast("string")
    message = F.concat(
        F.lit("Authorization: Bearer "), "event_type", user, F.lit(" token="), user, F.lit(', {"api_key": "k-'), user, F.lit('", "password": "p'), user,
        F.lit('", "n": 1} api-key: '), user, F.lit(" PASSWORD="), "event_type", F.lit(" done"),
    )
    return table(spark, folder, "events").select("event_id", T.redacted(message).alias("message"))


@query("SELECT id, [rel_path, CASE WHEN rel_path LIKE '%.md' THEN rel_path[:-4] ELSE rel_path || '.md' END] AS variants FROM vq_documents")
def identifier_variants(spark, folder):
    """Ways in which a note can be named."""
    return table(spark, folder, "vq_documents").select("id", T.identifier_variants(F.col("rel_path")).alias("variants"))


@query("SELECT id, sha256(markdown_text) AS content_hash, sha256(markdown_text) = file_hash AS fresh FROM vq_documents")
def content_hashes(spark, folder):
    """Hash of every note's text and whether it is the stored one."""
    own = T.content_hash(F.col("markdown_text"))
    return table(spark, folder, "vq_documents").select("id", own.alias("content_hash"), (own == F.col("file_hash")).alias("fresh"))


@query(
    """SELECT id, rel_path FROM vq_documents WHERE NOT regexp_matches(rel_path, '^88_Agents/.*$') AND NOT regexp_matches(rel_path, '^.*archive.*\\.md$')"""
)
def excluded_globs(spark, folder):
    """Notes that two shell patterns leave."""
    return table(spark, folder, "vq_documents").where(~T.excluded(F.col("rel_path"), ["88_Agents/*", "*archive*.md"])).select("id", "rel_path")


@query(
    """WITH f AS (SELECT id, regexp_extract(markdown_text, '^---\\n((?s:.*?))\\n---\\n?', 1) AS block FROM vq_documents WHERE starts_with(markdown_text, '---' || chr(10)))
  SELECT id, length(block) AS block_chars FROM f WHERE block <> ''"""
)
def frontmatter_blocks(spark, folder):
    """Length of every front matter block."""
    block = T.frontmatter_block(F.col("markdown_text"))
    return table(spark, folder, "vq_documents").select("id", F.length(block).cast("bigint").alias("block_chars")).where("block_chars > 0")


_FM = "trim(coalesce(json_extract_string(frontmatter_json, '$.{}'), ''))"


@query(
    f"""SELECT id, list_filter([
    CASE WHEN {_FM.format('type')} = '' THEN 'missing type' END, CASE WHEN {_FM.format('domain')} = '' THEN 'missing domain' END, CASE WHEN {_FM.format('created')} = '' THEN 'missing created' END,
    CASE WHEN {_FM.format('type')} <> '' AND {_FM.format('type')} NOT IN ('article','concept','draft','moc','note','plan','project','read','report','resource','runbook','sop','system') THEN 'unknown type' END,
    CASE WHEN {_FM.format('domain')} <> '' AND {_FM.format('domain')} NOT IN ('ai','content','ecom','general','personal','sport','strategy','system','trading') THEN 'unknown domain' END,
    CASE WHEN {_FM.format('created')} <> '' AND (NOT regexp_full_match({_FM.format('created')}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR TRY_CAST({_FM.format('created')} AS DATE) IS NULL) THEN 'created is no date' END
  ], lambda e: e IS NOT NULL) AS errors FROM vq_documents"""
)
def frontmatter_validate(spark, folder):
    """What is wrong with every note's front matter."""
    fields = F.from_json(F.coalesce("frontmatter_json", F.lit("{}")), "map<string,string>")
    return table(spark, folder, "vq_documents").select("id", validation.frontmatter_errors(fields).alias("errors"))


@query(
    """WITH w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z]{3,}')) AS word FROM vq_documents),
  n AS (SELECT id, word, count(*) AS n FROM w WHERE word NOT IN ('about','agent','agentic','and','from','idea','into','note','notes','that','the','this','with','workspace') GROUP BY ALL),
  l AS (SELECT d.id, coalesce((SELECT arg_min(word, (-n, word)) FROM n WHERE n.id = d.id), 'general') AS label FROM vq_documents d)
  SELECT label, count(*) AS notes FROM l GROUP BY label"""
)
def keyword_clusters(spark, folder):
    """Notes per most frequent title word."""
    labels = clusters.keyword_label(table(spark, folder, "vq_documents").select("id", F.col("title").alias("text")))
    return clusters.label_clusters(labels)


@query(
    """WITH h AS (SELECT collection_id, md5(concat_ws(chr(31), rel_path, file_hash)) AS m FROM vq_documents)
  SELECT collection_id, count(*) AS notes, sha256(CAST(sum(CAST('0x' || m[1:15] AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || m[17:31] AS HUGEINT)) AS VARCHAR)) AS digest FROM h GROUP BY collection_id"""
)
def workspace_digest(spark, folder):
    """One hash per collection over all of its notes."""
    return clusters.workspace_digest(table(spark, folder, "vq_documents").select("collection_id", "rel_path", "file_hash"))


@query()
def chunk_markdown(spark, folder):
    """All notes cut into chunks."""
    from notarium.operators.chunking import chunk_notes

    return chunk_notes(table(spark, folder, "vq_documents"))


@query(
    f"""WITH {_OBJECTS}, o AS (SELECT id, document_id, title, list_sort(list_distinct(list(chunk_id))) AS ids FROM objects WHERE object_type = 'concept' GROUP BY ALL),
  w AS (SELECT o.id AS object_id, o.document_id, min(c.chunk_index) - 1 AS low, max(c.chunk_index) + 1 AS high FROM o JOIN chunks c ON list_contains(o.ids, c.id) AND c.document_id = o.document_id GROUP BY ALL)
  SELECT w.object_id, string_agg(trim(c.text_content), chr(10) ORDER BY c.chunk_index) AS window_text, min(c.chunk_index) AS first_index, max(c.chunk_index) AS last_index,
    min(c.start_line) AS window_start_line, max(c.end_line) AS window_end_line FROM w JOIN chunks c ON c.document_id = w.document_id AND c.chunk_index BETWEEN w.low AND w.high GROUP BY w.object_id"""
)
def knowledge_window(spark, folder):
    """Text around the chunks of every concept."""
    chunks = chunks_of(spark, folder)
    concepts = knowledge.objects_from_sections(chunks).where("object_type = 'concept'")
    return windows.object_window(concepts, chunks)


@query(
    f"""WITH {_OBJECTS} SELECT o.id, trim(concat_ws(chr(10), 'Collection: ' || {_collapse('k.name')}, 'Relative path: ' || {_collapse('d.rel_path')}, 'Document title: ' || {_collapse('d.title')},
    'Knowledge object type: ' || o.object_type, 'Object title: ' || {_collapse('o.title')}, 'Knowledge text: ' || {_collapse('o.body_text')})) AS embedding_text
  FROM objects o JOIN vq_documents d ON d.id = o.document_id JOIN vq_collections k ON k.id = d.collection_id"""
)
def object_template(spark, folder):
    """The text that is embedded for every knowledge object."""
    notes = table(spark, folder, "vq_documents").select(F.col("id").alias("document_id"), "collection_id", "rel_path", F.col("title").alias("note_title"))
    names = table(spark, folder, "vq_collections").select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    rows = knowledge.objects_from_sections(chunks_of(spark, folder)).withColumnRenamed("title", "object_title").join(notes, "document_id").join(names, "collection_id")
    rows = rows.withColumnRenamed("note_title", "title").withColumn("document_summary", F.lit(None).cast("string"))
    return windows.object_template(rows).select("id", "embedding_text")


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN coalesce(trim(qdrant_point_id), '') = '' THEN 'point-' || id ELSE qdrant_point_id END AS qdrant_point_id FROM chunks")
def point_writeback(spark, folder):
    """Point ids after all waiting chunks got one."""
    chunks = chunks_of(spark, folder).select("id", "qdrant_point_id")
    written = vectors.pending(chunks).select("id", F.concat(F.lit("point-"), F.col("id").cast("string")).alias("point_id"))
    return mutations.write_point_ids(chunks, written)


_LINK_KEY = ", ".join(f"coalesce({k}, '') AS {k}" for k in mutations.KEY)


@query(
    f"""WITH o AS (SELECT {_LINK_KEY}, max(confidence) AS c FROM vq_links GROUP BY ALL),
  f AS (SELECT {_LINK_KEY}, max(confidence) AS confidence FROM vq_links WHERE NOT stale GROUP BY ALL),
  s AS (SELECT c.name AS collection_name, d.rel_path AS source_rel_path FROM vq_documents d JOIN vq_collections c ON c.id = d.collection_id WHERE d.status <> 'deleted')
  SELECT o.*  EXCLUDE (c), coalesce(f.confidence, o.c) AS confidence, f.confidence IS NULL AS stale FROM o LEFT JOIN f USING (collection_name, source_rel_path, target_identifier, edge_type, anchor_text, source_kind)
  WHERE EXISTS (SELECT 1 FROM s WHERE s.collection_name = o.collection_name AND s.source_rel_path = o.source_rel_path)"""
)
def link_sweep(spark, folder):
    """Links after an extraction that found those again that were not stale."""
    links = table(spark, folder, "vq_links")
    names = table(spark, folder, "vq_collections").select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    sources = table(spark, folder, "vq_documents").where("status <> 'deleted'").join(names, "collection_id").select("collection_name", "rel_path")
    return mutations.sweep_links(links, links.where("NOT stale"), sources)


@query(
    """SELECT id, rel_path, status FROM vq_documents WHERE status IN ('indexed', 'enriched') AND (starts_with(rel_path, '10_Projects/') OR starts_with(rel_path, 'Daily/'))
  ORDER BY updated_at DESC, rel_path, id LIMIT 25"""
)
def seed_nodes(spark, folder):
    """The 25 newest notes of two folders."""
    notes = table(spark, folder, "vq_documents").where(F.col("status").isin("indexed", "enriched") & T.matches_prefix(F.col("rel_path"), ["10_Projects/", "Daily/"]))
    return notes.orderBy(F.desc("updated_at"), "rel_path", "id").limit(25).select("id", "rel_path", "status")


@query()
def heading_sections(spark, folder):
    """Chunks per heading path of all notes, cut anew."""
    from notarium.operators.chunking import chunk_notes

    return chunk_notes(table(spark, folder, "vq_documents")).groupBy("id", "heading_path").agg(F.count("*").alias("chunks"), F.min("start_line").alias("first_line"))


@query(
    f"""WITH {_CHUNKS}, c AS (SELECT id, len(regexp_extract_all(coalesce(text_content, ''), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+')) AS w,
    len(regexp_extract_all(regexp_replace(coalesce(text_content, ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]')) AS p FROM chunks)
  SELECT id, greatest(1, CAST(ceil(w * CAST(1.35 AS DOUBLE) + p * CAST(0.35 AS DOUBLE)) AS INTEGER)) AS tokens FROM c"""
)
def prose_token_estimate(spark, folder):
    """Second token estimate of every chunk."""
    return chunks_of(spark, folder).select("id", T.prose_tokens(F.col("text_content")).alias("tokens"))


_W = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]"


@query(
    f"""WITH {_CHUNKS}, s AS (SELECT id, coalesce(text_content, '') AS t, list_filter(string_split({_collapse('text_content')}, ' '), lambda x: x <> '') AS own FROM chunks),
  o AS (SELECT id, unnest(own) AS word, generate_subscripts(own, 1) AS k FROM s),
  c AS (SELECT id, k, word, len(regexp_extract_all(word, '{_W}+')) AS w, len(regexp_extract_all(word, '[^{_W[1:-1]}]')) AS m FROM o),
  r AS (SELECT id, k, word, greatest(1, ceil(sum(w) OVER (PARTITION BY id ORDER BY k) * CAST(1.35 AS DOUBLE) + sum(m) OVER (PARTITION BY id ORDER BY k) * CAST(0.35 AS DOUBLE))) AS size FROM c),
  e AS (SELECT id, max(size) AS whole, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE size < 64), '') AS cut FROM r GROUP BY id)
  SELECT s.id, CASE WHEN coalesce(e.whole, 1) <= 64 THEN s.t ELSE e.cut END AS truncated FROM s LEFT JOIN e USING (id)"""
)
def truncated_prose(spark, folder):
    """Every chunk cut to 64 tokens of the second estimate."""
    return chunks_of(spark, folder).select("id", T.truncated_prose(F.col("text_content"), 64).alias("truncated"))


@query(
    f"WITH {_OBJECTS} SELECT document_id, count(*) AS segments, min(line_start) AS line_start, max(line_end) AS line_end, string_agg(body_text, chr(10) ORDER BY line_start, id) AS body_text "
    "FROM objects WHERE object_type = 'segment_summary' GROUP BY document_id"
)
def document_spans(spark, folder):
    """The segment summaries of every document in one, with the lines they span."""
    return knowledge.document_spans(knowledge.objects_from_sections(chunks_of(spark, folder)))


@query(SQL["context_template"].replace("SELECT l.id, k.name,", "SELECT l.id, l.qdrant_point_id, k.name,") + " WHERE coalesce(trim(qdrant_point_id), '') = ''")
def pending_chunks(spark, folder):
    """The text that is embedded for every chunk that waits for a vector, with the texts around it."""
    waiting = vectors.pending(chunks_of(spark, folder)).select("id")
    return context_template(spark, folder).join(waiting, "id", "left_semi")


@query(
    """SELECT id, CASE WHEN trim(regexp_extract(coalesce(markdown_text, ''), '(?m)^# +(\\S.*)$', 1)) <> '' THEN trim(regexp_extract(markdown_text, '(?m)^# +(\\S.*)$', 1))
    ELSE array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(rel_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END AS title FROM vq_documents"""
)
def workspace_titles(spark, folder):
    """First heading, or the file name in words, of every note."""
    return table(spark, folder, "vq_documents").select("id", T.workspace_title(F.col("markdown_text"), F.col("rel_path")).alias("title"))
