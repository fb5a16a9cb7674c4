"""Queries of the retrieval path: lanes, fusion, re-ranking, sessions, windows and answers, for all logged searches at once."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.operators import clusters, fusion, knowledge, lexical, pipeline, sessions, vectors
from notarium.operators.graph import graph_signals, inbound_sources
from notarium.operators.hits import with_payload
from notarium.plans.store import chunks_of
from notarium.runtime import materialize
from notarium.sources.tables import table

QUERIES, SQL = {}, {}
#: The day on which ages of sessions are counted in the queries.
AS_OF = "2025-11-01"
N = 5


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for it."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def searches(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query_text): all logged searches that have a text."""
    own = table(spark, folder, "search_hits").groupBy("query_id").agg(F.max("query_text").alias("query_text"))
    return own.where(F.trim("query_text") != "")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.inverted_index(chunks_of(spark, folder).select("id", "text_content"), "id", "text_content")


def _asked_index(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.query_index(table(spark, folder, "vq_chunks"), "id", "text_content", searches(spark, folder))


def _keyword(spark, folder, limit, asked=None, index=None):
    asked = searches(spark, folder) if asked is None else asked
    return lexical.keyword_lane(asked, _asked_index(spark, folder) if index is None else index, limit).withColumn(
        "record_id", F.concat(F.lit("chunk:"), F.col("record_id").cast("string"))
    )


def _title(spark, folder, limit, asked=None):
    asked = searches(spark, folder) if asked is None else asked
    notes = table(spark, folder, "vq_documents").where(F.col("status").isin("indexed", "enriched"))
    lane = lexical.title_lane(asked, notes.select(F.col("id").alias("record_id"), "title", "rel_path"), limit)
    return lane.withColumn("record_id", F.concat(F.lit("title:"), F.col("record_id").cast("string")))


def _sparse(spark, folder, limit, asked=None, index=None):
    asked = searches(spark, folder) if asked is None else asked
    totals = lexical.lengths(table(spark, folder, "vq_chunks"), "id", "text_content")
    return lexical.bm25_lane(asked, _asked_index(spark, folder) if index is None else index, totals, limit).withColumn(
        "record_id", F.concat(F.lit("chunk:"), F.col("record_id").cast("string"))
    )


def corpus_of(spark: SparkSession, folder: str) -> pipeline.Corpus:
    """The tables that searches read, with a knowledge object per titled chunk."""
    notes, collections, links = (table(spark, folder, t) for t in ("vq_documents", "vq_collections", "vq_links"))
    chunks = table(spark, folder, "vq_chunks")
    return pipeline.Corpus(notes, chunks, collections, links)


def retrieve(spark: SparkSession, folder: str, mode: str, n: int = N, objects: bool = False) -> DataFrame:
    """The results of a search mode for all logged searches; see pipeline.search."""
    corpus = corpus_of(spark, folder)
    if objects:
        known = knowledge.objects_from_sections(chunks_of(spark, folder)).where("object_type = 'concept'")
        corpus = dataclasses.replace(corpus, objects=known)
    return pipeline.search(corpus, searches(spark, folder), mode, n, pipeline.Options(as_of=AS_OF))


_TERMS = """
q AS (SELECT query_id, max(query_text) AS query_text FROM search_hits GROUP BY query_id HAVING trim(max(query_text)) <> ''),
qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+'))) AS term,
  len(list_distinct(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+'))) AS terms FROM q),
chunks AS (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
idx AS (SELECT term, record_id, count(*) AS tf FROM (SELECT id AS record_id, unnest(regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{L}\\p{N}]+')) AS term FROM chunks) GROUP BY ALL)"""


def _top(name: str, scored: str, limit: int, prefix: str) -> str:
    return f"""{name} AS (SELECT query_id, '{prefix}:' || record_id AS record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank
  FROM ({scored}) QUALIFY rank <= {limit})"""


def _kw(limit: int) -> str:
    return _top(
        "kw",
        "SELECT query_id, record_id, round(sum(CAST(tf AS DOUBLE) / (tf + 1)), 9) AS score FROM qt JOIN idx USING (term) GROUP BY query_id, record_id HAVING count(*) = max(terms)",
        limit,
        "chunk",
    )


def _kw_objects(limit: int) -> str:
    """Keyword lane over chunks and over concepts (a titled chunk each), merged by score."""
    chunks = _kw(limit).replace("kw AS (", "kc AS (", 1)
    objects = _top(
        "ko",
        """WITH io AS (SELECT term, record_id, count(*) AS tf FROM (SELECT id * 2 AS record_id, unnest(regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{L}\\p{N}]+')) AS term FROM chunks WHERE coalesce(trim(section_title), '') <> '') GROUP BY ALL)
    SELECT query_id, record_id, round(sum(CAST(tf AS DOUBLE) / (tf + 1)), 9) AS score FROM qt JOIN io USING (term) GROUP BY query_id, record_id HAVING count(*) = max(terms)""",
        limit,
        "knowledge",
    )
    return f"""{chunks}, {objects}, kb AS (SELECT *, 0 AS kind FROM kc UNION ALL SELECT *, 1 FROM ko),
kw AS (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, rank) AS rank FROM kb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, rank) <= {limit})"""


def _tt(limit: int) -> str:
    return _top(
        "tt",
        """WITH p AS (SELECT id AS record_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+'))) AS term, 1.0 AS w FROM vq_documents WHERE status IN ('indexed', 'enriched')
      UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(rel_path, '\\.md$', '')), '[\\p{L}\\p{N}]+'))), 0.4 FROM vq_documents WHERE status IN ('indexed', 'enriched')),
    x AS (SELECT term, record_id, sum(CAST(w AS DOUBLE)) AS w FROM p GROUP BY ALL),
    f AS (SELECT query_id, record_id, sum(w) AS base FROM qt JOIN x USING (term) GROUP BY query_id, record_id HAVING count(*) = max(terms)),
    s AS (SELECT q.query_id, d.id AS record_id, lower(trim(q.query_text)) AS needle, lower(coalesce(d.title, '')) AS title, lower(d.rel_path) AS path FROM q, vq_documents d WHERE d.status IN ('indexed', 'enriched'))
    SELECT s.query_id, s.record_id, round(coalesce(base, 0.0) + CASE WHEN title = needle THEN 2.0 ELSE 0 END + CASE WHEN contains(title, needle) THEN 1.0 ELSE 0 END
      + CASE WHEN contains(path, needle) THEN 0.5 ELSE 0 END, 9) AS score FROM s LEFT JOIN f ON f.query_id = s.query_id AND f.record_id = s.record_id
    WHERE base IS NOT NULL OR contains(title, needle) OR contains(path, needle)""",
        limit,
        "title",
    )


def _bm(limit: int) -> str:
    return _top(
        "bm",
        """WITH len AS (SELECT record_id, sum(tf) AS n FROM idx GROUP BY record_id), tot AS (SELECT count(*) AS records, avg(n) AS mean FROM len),
    fr AS (SELECT term, count(*) AS df FROM idx GROUP BY term)
    SELECT query_id, record_id, round(sum(ln(1 + (records - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
    FROM qt JOIN fr USING (term) JOIN idx USING (term) JOIN len USING (record_id) CROSS JOIN tot GROUP BY query_id, record_id""",
        limit,
        "chunk",
    )


def _fused(lanes: list[tuple[str, str, int]], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, record_id, rank, '{lane}' AS lane, {i} AS ord FROM {cte}" for cte, lane, i in lanes)
    return f"""fused AS (SELECT query_id, record_id, round(sum(1.0 / (60 + rank)), 9) AS score, list(lane ORDER BY ord) AS retrieval_lanes FROM ({union}) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM fused QUALIFY rank <= {limit})"""


_PATHS = """paths AS (SELECT 'title:' || id AS record_id, rel_path FROM vq_documents UNION ALL SELECT 'chunk:' || c.id, d.rel_path FROM chunks c JOIN vq_documents d ON d.id = c.document_id)"""


def _dense(limit: int) -> str:
    """The hash embedder and the cosine of all pairs, over chunks that have a point id."""
    vector = """SELECT {key} AS key, CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 64 AS dim, sum(CASE WHEN (CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END) AS v
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}) GROUP BY ALL"""
    stored = "(SELECT id, text_content FROM chunks WHERE coalesce(trim(qdrant_point_id), '') <> '')"
    return _top(
        "ds",
        f"""WITH a AS ({vector.format(key='query_id', text='query_text', source='q')}), b AS ({vector.format(key='id', text='text_content', source=stored)}),
    an AS (SELECT key, sqrt(sum(v * v)) AS n FROM a GROUP BY key HAVING n > 0), bn AS (SELECT key, sqrt(sum(v * v)) AS n FROM b GROUP BY key HAVING n > 0),
    dots AS (SELECT a.key AS q, b.key AS c, sum(a.v * b.v) AS d FROM a JOIN b USING (dim) GROUP BY ALL)
    SELECT an.key AS query_id, bn.key AS record_id, round(coalesce(d, 0.0) / (an.n * bn.n), 6) AS score FROM an CROSS JOIN bn LEFT JOIN dots ON dots.q = an.key AND dots.c = bn.key""",
        limit,
        "chunk",
    )


_SHOWN = """firsts AS (SELECT document_id, first(text_content ORDER BY chunk_index, id) AS text, first(start_line ORDER BY chunk_index, id) AS start_line, min(chunk_index) AS chunk_index FROM chunks GROUP BY document_id),
shown AS (SELECT 'title:' || d.id AS record_id, d.id AS document_id, d.rel_path, d.title, coalesce(f.text, substring(d.markdown_text, 1, 2000)) AS text, f.start_line, f.chunk_index FROM vq_documents d LEFT JOIN firsts f ON f.document_id = d.id
  UNION ALL SELECT 'chunk:' || c.id, d.id, d.rel_path, d.title, c.text_content, c.start_line, c.chunk_index FROM chunks c JOIN vq_documents d ON d.id = c.document_id{objects})"""
_SHOWN_OBJECTS = " UNION ALL SELECT 'knowledge:' || c.id * 2, d.id, d.rel_path, d.title, c.text_content, c.start_line, NULL FROM chunks c JOIN vq_documents d ON d.id = c.document_id WHERE coalesce(trim(c.section_title), '') <> ''"
_KEY = "regexp_replace(trim(replace({}, '\\', '/'), '/'), '\\.md$', '')"
_MARKS = ", ".join(f"'{m}'" for m in sessions.MARKERS)
_DATED = "'^\\d{4}-\\d{2}-\\d{2}'"
_PREFIX = f"""CASE WHEN len(parts) >= 2 THEN CASE WHEN len(list_filter(range(1, len(parts)), lambda i: lower(parts[i]) IN ({_MARKS}) OR regexp_matches(parts[i], {_DATED}))) > 0
    THEN array_to_string(parts[1:list_filter(range(1, len(parts)), lambda i: lower(parts[i]) IN ({_MARKS}) OR regexp_matches(parts[i], {_DATED}))[1]], '/')
    WHEN regexp_matches(parts[len(parts)], {_DATED}) THEN array_to_string(parts[1:len(parts) - 1], '/') END END"""


def _linked(source: str, out: str, top_k: int = 20) -> str:
    """Graph signals over the rows (query_id, record_id, score, rank, rel_path, ...) of a CTE."""
    return f"""{out}_p AS (SELECT *, {_KEY.format('rel_path')} AS k FROM {source} WHERE rank <= {top_k}),
{out}_e AS (SELECT DISTINCT {_KEY.format('source_rel_path')} AS f, {_KEY.format('target_identifier')} AS t FROM vq_links),
{out}_i AS (SELECT b.query_id, b.rel_path, count(DISTINCT a.k) AS inbound FROM (SELECT DISTINCT query_id, k FROM {out}_p) a JOIN {out}_e e ON e.f = a.k AND e.f <> e.t JOIN (SELECT DISTINCT query_id, rel_path, k FROM {out}_p) b ON b.query_id = a.query_id AND b.k = e.t GROUP BY ALL),
{out}_b AS (SELECT p.* EXCLUDE (score), CASE WHEN i.inbound >= 2 THEN p.score * 1.05 ELSE p.score END AS score, string_split(trim(replace(p.rel_path, '\\', '/'), '/'), '/') AS parts
  FROM {out}_p p LEFT JOIN {out}_i i ON i.query_id = p.query_id AND i.rel_path = p.rel_path),
{out}_s AS (SELECT *, {_PREFIX} AS prefix FROM {out}_b),
{out}_d AS (SELECT * EXCLUDE (score), CASE WHEN prefix IS NOT NULL AND row_number() OVER (PARTITION BY query_id, prefix ORDER BY score DESC, rel_path, rank) > 1 THEN score * 0.95 ELSE score END AS score FROM {out}_s),
{out} AS (SELECT * EXCLUDE (rank, score, parts, prefix, k), round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path, rank) AS rank FROM {out}_d
  UNION ALL BY NAME SELECT * EXCLUDE (score), round(score, 9) AS score FROM {source} WHERE rank > {top_k})"""


def _mode_sql(mode: str, n: int = N, objects: bool = False) -> str:
    """The whole pipeline of a mode: lanes, fusion, re-ranking, links, sessions, diversity and windows."""
    simple = mode in pipeline.SIMPLE
    linked, focused = mode in pipeline.LINKED, mode == "focused"
    limits = {k: (n if v is None else max(v[0] * n, v[1])) for k, v in pipeline.SIMPLE[mode].items()} if simple else {k: fusion.lane_limit(mode, n) for k in ("title", "keyword", "semantic") if mode != "fast" or k != "semantic"}
    cte = {"title": ("tt", _tt), "keyword": ("kw", _kw_objects if objects else _kw), "semantic": ("ds", _dense)}
    ctes = [_TERMS, *[cte[k][1](v) for k, v in limits.items()]]
    if len(limits) == 1:
        (only,) = limits
        ctes.append(f"ranked AS (SELECT query_id, record_id, score, ['{only}'] AS retrieval_lanes, rank FROM {cte[only][0]})")
    else:
        fused = n if simple or mode == "fast" else fusion.fused_limit(mode, n)
        ctes.append(_fused([(cte[k][0], k, i) for i, k in enumerate(limits)], fused))
    ctes.append(_SHOWN.format(objects=_SHOWN_OBJECTS if objects else ""))
    ctes.append("r0 AS (SELECT ranked.*, shown.* EXCLUDE (record_id), q.query_text FROM ranked JOIN shown USING (record_id) JOIN q USING (query_id))")
    if simple or mode == "fast":
        ctes.append("r1 AS (SELECT * FROM r0)")
    else:
        pool, out = (max(25, 6 * n) if mode == "deep" else 25), max(n, 20) if linked else n
        ctes.append(f"""rs AS (SELECT * EXCLUDE (score), round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}]+')), regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')))
    / len(list_distinct(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}]+'))), 0), 9) AS score FROM r0 WHERE rank <= {pool}),
r1 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM rs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= {out})""")
    ctes.append(_linked("r1", "r2") if linked else "r2 AS (SELECT * FROM r1)")
    ctes.append(_factor_ctes("SELECT *, retrieval_lanes AS lanes FROM r2"))
    ctes.append("""es AS (SELECT * EXCLUDE (score), starts_with(rel_path, '88_Agents/sessions/') AS s, CASE WHEN starts_with(rel_path, '88_Agents/sessions/') THEN round(score * factor, 9) ELSE score END AS score FROM factors),
sc AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY query_id ORDER BY score DESC, rel_path, rank ROWS UNBOUNDED PRECEDING) AS seen_before FROM es),
sp AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path, rank) AS rank FROM sc WHERE NOT s OR seen_before <= 1)""")
    each, keep = (1 if focused else 2), "WHERE NOT deferred" if focused else ""
    if simple:
        ctes.append(f"final AS (SELECT *, rank AS place FROM sp WHERE rank <= {n})")
    else:
        ctes.append(f"""dv AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) > {each} AS deferred FROM sp),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS place FROM dv {keep} QUALIFY place <= {n})""")
    columns = "f.query_id, f.record_id, f.score, f.retrieval_lanes, f.rel_path, f.place"
    if focused:
        return f"WITH {', '.join(ctes)} SELECT {columns} FROM final f"
    return f"""WITH {', '.join(ctes)} SELECT {columns}, min(c.start_line) AS window_start_line, max(c.end_line) AS window_end_line, string_agg(trim(c.text_content), chr(10) ORDER BY c.chunk_index) AS window_text
FROM final f LEFT JOIN chunks c ON c.document_id = f.document_id AND c.chunk_index BETWEEN f.chunk_index - 1 AND f.chunk_index + 1 GROUP BY ALL"""


def _listed(rows: DataFrame) -> DataFrame:
    own = ["query_id", "record_id", "score", "retrieval_lanes", "rel_path", "place"]
    return rows.select(*own, *[c for c in ("window_start_line", "window_end_line", "window_text") if c in rows.columns])


def _tok(c: str) -> str:
    stop = ",".join(f"'{w}'" for w in sessions.STOP)
    return f"list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '[_-]+', ' ', 'g'), '[a-z0-9][a-z0-9]{{2,}}')), lambda w: w NOT IN ({stop}))"


def _ov(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / greatest(3, len({a})) END"


def _factor_ctes(source: str, placed: str = "chunk_index IS NOT NULL OR start_line IS NOT NULL") -> str:
    """CTEs up to factors, over rows with query_text, rel_path, title, text and lanes."""
    return f"""fj AS (SELECT *, {_tok('query_text')} AS qt, {_tok('title')} AS tt, {_tok("replace(rel_path, '/', ' ')")} AS pt, {_tok('text')} AS bt FROM ({source})),
fk AS (SELECT *, greatest(0, least(1, 0.45 * {_ov('qt', 'bt')} + 0.35 * {_ov('qt', 'tt')} + 0.20 * {_ov('qt', 'pt')} + CASE WHEN list_contains(lanes, 'keyword') THEN 0.08 ELSE 0 END)) AS spec,
  len(list_filter(list_intersect({sessions.NOISE!r}, list_concat(list_concat(tt, pt), bt)), lambda w: NOT list_contains(qt, w))) AS noise,
  len(list_intersect({sessions.EVIDENCE!r}, list_concat(list_concat(tt, pt), bt))) AS shown,
  TRY_CAST(regexp_replace(regexp_extract(rel_path || ' ' || coalesce(title, ''), '20\\d{{2}}[-_/]\\d{{2}}[-_/]\\d{{2}}'), '[_/]', '-', 'g') AS DATE) AS day FROM fj),
fm AS (SELECT *, least(1, noise / 8.0) AS gen, least(1.12, greatest(0.75, 1.0 + CASE WHEN length(text) > 0 AND length(text) <= 1800 THEN 0.06 WHEN length(text) >= 5000 THEN -0.15 ELSE 0 END + CASE WHEN {placed} THEN 0.04 ELSE 0 END)) AS focus,
  least(1.18, greatest(0.78, 1 + 0.035 * shown - 0.04 * noise)) AS evid,
  CASE WHEN day IS NULL THEN 1.0 WHEN DATE '{AS_OF}' - day < 0 THEN 0.98 WHEN DATE '{AS_OF}' - day <= 14 THEN 1.08 WHEN DATE '{AS_OF}' - day <= 90 THEN 1.04 WHEN DATE '{AS_OF}' - day <= 365 THEN 1.0 ELSE 0.94 END AS rec FROM fk),
fn AS (SELECT *, 0.65 * CASE WHEN spec < 0.12 THEN 0.42 + spec ELSE 0.76 + 0.48 * spec END * focus * evid * rec * (1 - 0.35 * gen) AS f FROM fm),
factors AS (SELECT * EXCLUDE (qt, tt, pt, bt, spec, noise, shown, day, gen, focus, evid, rec, f), round(least(0.95, greatest(0.10, CASE WHEN spec >= 0.60 AND gen <= 0.30 THEN greatest(f, 0.77) ELSE f END)), 6) AS factor FROM fn)"""


@query(f"WITH {_TERMS} SELECT term, count(*) AS records, CAST(sum(tf) AS BIGINT) AS occurrences FROM idx GROUP BY term")
def inverted_index(spark, folder):
    """Records and occurrences per term of all chunks."""
    return _index(spark, folder).groupBy("term").agg(F.count("*").alias("records"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_TERMS}, {_kw(20)} SELECT * FROM kw")
def keyword_lane(spark, folder):
    """The twenty best chunks that hold all terms of each search."""
    return _keyword(spark, folder, 20)


@query(f"WITH {_TERMS}, {_tt(20)} SELECT * FROM tt")
def title_lane(spark, folder):
    """The twenty best notes by title and path of each search."""
    return _title(spark, folder, 20)


@query(f"WITH {_TERMS}, {_bm(20)} SELECT * FROM bm")
def bm25_lane(spark, folder):
    """The twenty best chunks by BM25 of each search."""
    return _sparse(spark, folder, 20)


@query()
def english_lane(spark, folder):
    """Keyword lane over English stems: the twenty best chunks of each search."""
    from notarium.functions.stemming import english_term

    return lexical.stemmed_lane(searches(spark, folder), table(spark, folder, "vq_chunks"), "id", "text_content", english_term, 20)


@query(
    f"WITH {_TERMS}, {_tt(10)}, {_kw(15)}, {_fused([('tt', 'title', 0), ('kw', 'keyword', 1)], 5)} SELECT query_id, record_id, score, retrieval_lanes, rank FROM ranked"
)
def keyword_mode_rrf(spark, folder):
    """Keyword mode: title and keyword lanes fused, five results per search."""
    return fusion.reciprocal_ranks({"title": _title(spark, folder, 10), "keyword": _keyword(spark, folder, 15)}, N)


@query(_mode_sql("fast"))
def fast_mode(spark, folder):
    """Fast mode: title and keyword lanes, sessions held back, two results per note, the rest filled, with windows."""
    return _listed(retrieve(spark, folder, "fast"))


@query(_mode_sql("hybrid"))
def hybrid_rrf(spark, folder):
    """Hybrid mode: three lanes, re-ranked, links, sessions, two results per note, with windows."""
    return _listed(retrieve(spark, folder, "hybrid"))


@query(_mode_sql("hybrid", objects=True))
def hybrid_objects(spark, folder):
    """Hybrid mode whose keyword lane also finds knowledge objects."""
    return _listed(retrieve(spark, folder, "hybrid", objects=True))


@query(_mode_sql("focused"))
def focused_mode(spark, folder):
    """Focused mode: three short lanes, re-ranked, one result per note."""
    return _listed(retrieve(spark, folder, "focused"))


@query(_mode_sql("deep"))
def deep_mode(spark, folder):
    """Deep mode: three lanes of fifty, thirty re-ranked, links, sessions, two results per note."""
    return _listed(retrieve(spark, folder, "deep"))


@query(_mode_sql("keyword"))
def keyword_mode(spark, folder):
    """Keyword mode: title and keyword lanes fused, sessions held back, with windows."""
    return _listed(retrieve(spark, folder, "keyword"))


@query(_mode_sql("title"))
def title_mode(spark, folder):
    """Title mode: the title lane alone."""
    return _listed(retrieve(spark, folder, "title"))


@query(_mode_sql("semantic"))
def semantic_mode(spark, folder):
    """Semantic mode: the dense lane alone."""
    return _listed(retrieve(spark, folder, "semantic"))


@query(f"WITH {_TERMS}, {_dense(20)} SELECT * FROM ds")
def dense_lane(spark, folder):
    """The twenty best chunks by the cosine of hashed words, of each search."""
    return pipeline.semantic_hits(corpus_of(spark, folder), searches(spark, folder), 20, vectors.hash_embedding())


_VIEW = _mode_sql("fast").replace("f.retrieval_lanes, f.rel_path, f.place, min(c.start_line) AS window_start_line, max(c.end_line) AS window_end_line, string_agg(trim(c.text_content), chr(10) ORDER BY c.chunk_index) AS window_text", "f.retrieval_lanes, f.rel_path, f.title, f.start_line, f.chunk_index")


@query(_VIEW.replace("f.query_id, f.record_id,", "f.query_id, f.record_id AS id,"))
def result_views(spark, folder):
    """Fast mode in the debug view, without the columns that windows change."""
    rows = fusion.shape(retrieve(spark, folder, "fast").withColumnRenamed("record_id", "id"), "verbose")
    return rows.select("query_id", "id", "score", "retrieval_lanes", "rel_path", "title", "start_line", "chunk_index")


_HITS = """hits AS (SELECT query_id, point_id AS record_id, any_value(rel_path) AS rel_path, max(score) AS score, list_sort(list_distinct(flatten(list(coalesce(retrieval_lanes, []))))) AS lanes
  FROM search_hits WHERE query_id IS NOT NULL AND point_id IS NOT NULL AND NOT isnan(score) AND rel_path IS NOT NULL GROUP BY query_id, point_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM hits WHERE score IS NOT NULL)"""


def logged_hits(spark, folder) -> DataFrame:
    """(query_id, record_id, rel_path, score, lanes, rank): the logged hits, one row each, best score first."""
    from pyspark.sql import Window

    own = table(spark, folder, "search_hits").where("query_id IS NOT NULL AND point_id IS NOT NULL AND NOT isnan(score) AND rel_path IS NOT NULL")
    empty = F.array().cast("array<string>")
    lanes = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce("retrieval_lanes", empty))), lambda x: x.isNotNull())))
    hits = own.groupBy("query_id", F.col("point_id").alias("record_id")).agg(
        F.min("rel_path").alias("rel_path"), F.max("score").alias("score"), lanes.alias("lanes")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    return hits.where("score IS NOT NULL").withColumn("rank", F.row_number().over(w))


@query(
    f"""WITH {_HITS}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) > 2 AS deferred FROM hr)
  SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS place FROM m QUALIFY place <= 10"""
)
def doc_diversity(spark, folder):
    """Ten logged hits per search, two per note first."""
    return fusion.diversify(logged_hits(spark, folder), 10, 2).select("query_id", "record_id", "place")


@query(
    f"""WITH {_HITS}, o AS (SELECT * FROM hr WHERE trim(rel_path) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) = 1)
  SELECT query_id, record_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM o QUALIFY place <= 6"""
)
def source_dedupe(spark, folder):
    """Six logged hits per search, each from another note."""
    return fusion.first_per_path(logged_hits(spark, folder), 6).select("query_id", "record_id", "rel_path", "place")


@query(
    f"""WITH {_HITS} SELECT query_id, max(score) AS top, min(score) AS low, round(avg(score), 9) AS mean, round(max(score) * 0.5, 9) AS floor
  FROM hr WHERE score > 0 AND isfinite(score) GROUP BY query_id"""
)
def score_floor(spark, folder):
    """Score distribution and floor of every search."""
    return fusion.score_floor(logged_hits(spark, folder), 0.5)


@query(
    f"""WITH {_HITS}, {_TERMS}, s AS (SELECT hr.query_id, hr.record_id, hr.rank, round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.query_text), '[\\p{{L}}\\p{{N}}]+')),
    regexp_extract_all(lower(coalesce(c.text_content, '')), '[\\p{{L}}\\p{{N}}]+'))) / len(list_distinct(regexp_extract_all(lower(q.query_text), '[\\p{{L}}\\p{{N}}]+'))), 0), 9) AS rerank_score
    FROM hr JOIN q USING (query_id) JOIN chunks c ON 'chunk:' || c.id = hr.record_id WHERE rank <= 25),
  r AS (SELECT hr.query_id, hr.record_id, hr.rank AS old, s.rerank_score FROM hr LEFT JOIN s USING (query_id, record_id) WHERE hr.rank <= 25)
  SELECT query_id, record_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, old) AS rank FROM r"""
)
def rerank_overlap(spark, folder):
    """The 25 best logged hits of every search re-ranked by the query's tokens in their text."""
    hits = logged_hits(spark, folder)
    texts = chunks_of(spark, folder).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("record_id"), "text_content")
    scores = (
        hits.where("rank <= 25")
        .join(searches(spark, folder), "query_id")
        .join(texts, "record_id")
        .select("query_id", "record_id", fusion.overlap_score(F.col("query_text"), F.col("text_content")).alias("rerank_score"))
    )
    return fusion.rerank(hits, scores).select("query_id", "record_id", "rerank_score", "rank")


_FACTOR = f"""{_HITS}, q AS (SELECT query_id, max(query_text) AS query_text FROM search_hits GROUP BY query_id HAVING trim(max(query_text)) <> ''),
chunks AS (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
{_factor_ctes("SELECT hr.query_id, hr.record_id, hr.score, hr.rank, d.rel_path, d.title, coalesce(c.text_content, '') AS text, hr.lanes, q.query_text FROM hr JOIN q USING (query_id) JOIN chunks c ON 'chunk:' || c.id = hr.record_id JOIN vq_documents d ON d.id = c.document_id", "TRUE")}"""


def _factors(spark, folder) -> DataFrame:
    notes = table(spark, folder, "vq_documents").select(F.col("id").alias("document_id"), F.col("rel_path").alias("path"), "title")
    chunks = chunks_of(spark, folder).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("record_id"), "document_id", "text_content")
    rows = logged_hits(spark, folder).drop("rel_path").join(searches(spark, folder), "query_id").join(chunks, "record_id").join(notes, "document_id")
    rows = rows.withColumnRenamed("path", "rel_path").withColumnRenamed("text_content", "text").withColumn("placed", F.lit(True))
    return sessions.with_factor(rows, AS_OF)


@query(f"WITH {_FACTOR} SELECT query_id, record_id, factor FROM factors")
def session_factor(spark, folder):
    """The session factor of every logged hit, as if it were a session."""
    return _factors(spark, folder).select("query_id", "record_id", "factor")


@query(
    f"""WITH {_FACTOR}, e AS (SELECT *, starts_with(rel_path, '88_Agents/sessions/') AS s, CASE WHEN starts_with(rel_path, '88_Agents/sessions/') THEN round(score * factor, 9) ELSE score END AS effective_score FROM factors),
  c AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY query_id ORDER BY effective_score DESC, rel_path, record_id ROWS UNBOUNDED PRECEDING) AS seen FROM e)
  SELECT query_id, record_id, effective_score, row_number() OVER (PARTITION BY query_id ORDER BY effective_score DESC, rel_path, record_id) AS place FROM c WHERE NOT s OR seen <= 1"""
)
def session_cap(spark, folder):
    """Logged hits after sessions were down-ranked and held to one per search."""
    return sessions.apply_policy(_factors(spark, folder), "penalize", 1).select("query_id", "record_id", "effective_score", "place")


@query(
    f"""SELECT id, CAST(CASE WHEN day IS NULL THEN 1.0 WHEN DATE '{AS_OF}' - day < 0 THEN 0.98 WHEN DATE '{AS_OF}' - day <= 14 THEN 1.08 WHEN DATE '{AS_OF}' - day <= 90 THEN 1.04
    WHEN DATE '{AS_OF}' - day <= 365 THEN 1.0 ELSE 0.94 END AS DOUBLE) AS recency FROM (SELECT id, TRY_CAST(regexp_replace(regexp_extract(rel_path || ' ' || coalesce(title, ''), '20\\d{{2}}[-_/]\\d{{2}}[-_/]\\d{{2}}'), '[_/]', '-', 'g') AS DATE) AS day FROM vq_documents)"""
)
def recency_factor(spark, folder):
    """Recency factor of every note by the date in its path or title."""
    return table(spark, folder, "vq_documents").select("id", sessions.recency(F.concat_ws(" ", "rel_path", "title"), AS_OF).alias("recency"))


@query(f"SELECT id, prefix FROM (SELECT id, {_PREFIX} AS prefix FROM (SELECT id, string_split(trim(replace(rel_path, '\\', '/'), '/'), '/') AS parts FROM vq_documents)) WHERE prefix IS NOT NULL")
def session_prefixes(spark, folder):
    """Session prefix of every note that has one."""
    return table(spark, folder, "vq_documents").select("id", sessions.session_prefix(F.col("rel_path")).alias("prefix")).where("prefix IS NOT NULL")


_LINKS = "e AS (SELECT DISTINCT regexp_replace(trim(replace(source_rel_path, '\\', '/'), '/'), '\\.md$', '') AS f, regexp_replace(trim(replace(target_identifier, '\\', '/'), '/'), '\\.md$', '') AS t FROM vq_links)"


@query(
    f"""WITH {_HITS}, {_LINKS}, p AS (SELECT DISTINCT query_id, rel_path, regexp_replace(trim(replace(rel_path, '\\', '/'), '/'), '\\.md$', '') AS k FROM hr WHERE rank <= 20)
  SELECT b.query_id, b.rel_path, count(DISTINCT a.k) AS inbound FROM p a JOIN e ON e.f = a.k JOIN p b ON b.query_id = a.query_id AND b.k = e.t WHERE e.f <> e.t GROUP BY ALL"""
)
def adjacency_boost(spark, folder):
    """Links among the twenty best logged hits of every search."""
    return inbound_sources(logged_hits(spark, folder).where("rank <= 20"), table(spark, folder, "vq_links"))


@query(f"WITH {_HITS}, {_linked('hr', 'g')} SELECT query_id, record_id, score, rank AS place FROM g")
def session_demote(spark, folder):
    """Logged hits re-ranked by links and session prefixes."""
    return graph_signals(logged_hits(spark, folder), table(spark, folder, "vq_links")).select("query_id", "record_id", "score", "place")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)
  SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank
  FROM q JOIN embeddings e ON e.vec_id <> q.query_id QUALIFY rank <= 5"""
)
def dense_topk_batch(spark, folder):
    """The five nearest vectors of every fiftieth vector, over all vectors."""
    all_vectors = table(spark, folder, "embeddings")
    asked = all_vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(all_vectors, asked, N)


@query(
    """WITH q AS (SELECT vec_id AS seed, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT q.seed, e.vec_id AS item, round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.seed),
  g AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, item) AS n FROM s QUALIFY n <= 8 AND score >= 0.35), k AS (SELECT * FROM g WHERE n <= 5),
  a AS (SELECT q.seed, coalesce(k.item, q.seed) AS anchor FROM q LEFT JOIN k ON k.seed = q.seed AND k.n = 1)
  SELECT anchor, count(DISTINCT a.seed) AS connection_count, list_sort(list_distinct(list(a.seed))) AS seed_nodes, count(DISTINCT k.item) AS related_count, max(k.score) AS best_score FROM a LEFT JOIN k ON k.seed = a.seed GROUP BY anchor"""
)
def semantic_clusters(spark, folder):
    """Every fiftieth vector grouped by its nearest one."""
    all_vectors = table(spark, folder, "embeddings")
    asked = all_vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    related = vectors.nearest(all_vectors, asked, 8).select(F.col("query_id").alias("seed"), F.col("id").alias("item"), "score")
    return clusters.anchored_clusters(related, asked.select(F.col("query_id").alias("seed")))


@query(
    f"""WITH {_HITS}, q AS (SELECT query_id, max(query_text) AS query_text FROM search_hits GROUP BY query_id HAVING trim(max(query_text)) <> ''),
  t AS (SELECT hr.query_id, hr.record_id, list_sort(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(q.query_text), '[a-z][a-z0-9_-]{{3,}}')), lambda w: w NOT IN ({','.join(repr(w) for w in clusters.RELATED_STOP)})),
    list_filter(list_distinct(regexp_extract_all(lower(d.title || ' ' || coalesce(c.text_content, '')), '[a-z][a-z0-9_-]{{3,}}')), lambda w: w NOT IN ({','.join(repr(w) for w in clusters.RELATED_STOP)})))) AS s, lanes
    FROM hr JOIN q USING (query_id) JOIN (SELECT * FROM vq_chunks QUALIFY row_number() OVER (PARTITION BY id) = 1) c ON 'chunk:' || c.id = hr.record_id JOIN vq_documents d ON d.id = c.document_id WHERE rank <= 6)
  SELECT query_id, record_id, CASE WHEN len(s) > 0 THEN 'shared terms: ' || array_to_string(s[1:8], ', ') WHEN len(lanes) > 0 THEN 'retrieved through ' || array_to_string(lanes, ', ')
    ELSE 'retrieval score indicates semantic proximity' END AS reason FROM t"""
)
def related_work(spark, folder):
    """Why the six best logged hits of every search are related to it."""
    notes = table(spark, folder, "vq_documents").select(F.col("id").alias("document_id"), "title")
    chunks = chunks_of(spark, folder).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("record_id"), "document_id", "text_content")
    rows = logged_hits(spark, folder).where("rank <= 6").join(searches(spark, folder), "query_id").join(chunks, "record_id").join(notes, "document_id")
    text = F.concat_ws(" ", "title", F.coalesce("text_content", F.lit("")))
    return rows.select("query_id", "record_id", clusters.connection_reason(F.col("query_text"), text, F.col("lanes")).alias("reason"))


_Q = _TERMS.split("q AS (", 1)[1].split("),\nqt AS", 1)[0]
_SEEDS = """seeds AS (SELECT id, rel_path, title, json_extract_string(frontmatter_json, '$.type') AS kind, json_extract_string(frontmatter_json, '$.domain') AS domain, markdown_text FROM vq_documents
  WHERE status IN ('indexed', 'enriched') AND (starts_with(rel_path, '10_Projects/') OR starts_with(rel_path, 'Daily/')) ORDER BY updated_at DESC, rel_path, id LIMIT 25), """
_PROFILES = """SELECT id AS query_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(title) <> '' THEN trim(title) END, CASE WHEN trim(kind) <> '' THEN 'type: ' || trim(kind) END,
  CASE WHEN trim(domain) <> '' THEN 'domain: ' || trim(domain) END, CASE WHEN trim(markdown_text) <> '' THEN substring(trim(markdown_text), 1, 1600) END) AS query_text FROM seeds"""


@query(
    _mode_sql("semantic", 20).split(" SELECT f.query_id, f.record_id, f.score")[0].replace("WITH \n", "WITH ", 1).replace(_Q, _PROFILES, 1).replace("q AS (", _SEEDS + "q AS (", 1)
    + """, h AS (SELECT s.rel_path AS seed, f.rel_path AS item, f.title, round(f.score, 6) AS score, f.place FROM final f JOIN seeds s ON s.id = f.query_id WHERE f.rel_path <> s.rel_path AND NOT starts_with(f.rel_path, '88_Agents/sessions/') AND f.score >= 0.35),
  o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seed, item ORDER BY place) = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, item) AS n FROM o QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, item) <= 5),
  a AS (SELECT s.rel_path AS seed, coalesce(k.item, s.rel_path) AS anchor, coalesce(k.title, s.title, s.rel_path) AS label FROM seeds s LEFT JOIN k ON k.seed = s.rel_path AND k.n = 1),
  m AS (SELECT anchor, item, max(score) AS score, count(*) AS links FROM a JOIN k USING (seed) GROUP BY ALL),
  b AS (SELECT anchor, list(item ORDER BY score DESC, links DESC, item)[1:5] AS related_paths, max(score) AS best_score FROM m GROUP BY anchor)
  SELECT a.anchor, min(label) AS label, count(*) AS seed_count, list_sort(list(seed)) AS seed_paths, coalesce(any_value(related_paths), []) AS related_paths, coalesce(any_value(best_score), 0.0) AS best_score,
    row_number() OVER (ORDER BY count(*) DESC, coalesce(any_value(best_score), 0.0) DESC, a.anchor) AS place FROM a LEFT JOIN b ON b.anchor = a.anchor GROUP BY a.anchor"""
)
def node_clusters(spark, folder):
    """The 25 newest notes of two folders, clustered by what the dense lane finds for them."""
    return pipeline.node_clusters(corpus_of(spark, folder), pipeline.Options(as_of=AS_OF), prefixes=["10_Projects/", "Daily/"])


_THINK = _mode_sql("hybrid").split(" SELECT f.query_id, f.record_id, f.score")[0]


@query(
    _THINK
    + """, l AS (SELECT *, CASE WHEN place <= 3 AND trim(text) <> '' THEN '- ' || coalesce(CASE WHEN title <> '' THEN title END, rel_path, 'Untitled') || ': ' || substring(replace(trim(text), chr(10), ' '), 1, 360) END AS line FROM final)
  SELECT query_id, coalesce(string_agg(line, chr(10) ORDER BY place), '') AS answer, list(rel_path ORDER BY place) AS citations FROM l GROUP BY query_id"""
)
def think_answer(spark, folder):
    """Cited extract from the results of hybrid mode."""
    rows = retrieve(spark, folder, "hybrid").drop("rank").withColumnsRenamed({"place": "rank", "record_id": "id"})
    return clusters.answer(rows)
