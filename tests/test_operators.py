"""Small fixtures for the core operators, worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notarium import notes as note_files
from notarium.functions import stemming, validation
from notarium.functions import text as T
from notarium.operators import chunking, components, fusion, graph, incremental, knowledge, ranking, references, refresh, sessions, stats, vectors, windows
from notarium.sources import receipts, scan, settings
from notarium.sources.snapshots import SnapshotStore, write_lock
from notarium.streaming import watch


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- text -----------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, T.slug(F.lit("  Hello, World_again! "))) == "hello-world-again"
    assert one(spark, T.slug(F.lit(None).cast("string"))) == "untitled"
    assert one(spark, T.redacted(F.lit("Bearer abc.def token=xyz"))) == "Bearer <redacted> token=<redacted>"
    assert one(spark, T.snippet(F.lit("a b c"), 2)) == "a b ..."
    assert one(spark, T.embedding_tokens(F.lit(""))) == 1
    assert one(spark, T.embedding_tokens(F.lit("abcdefgh ab"))) == 5
    assert one(spark, T.bounded_text(F.lit(" ".join(["abcdefgh"] * 100)), 24)) == " ".join(["abcdefgh"] * 8)
    assert one(spark, T.json_object(F.lit('noise ```json {"a": 1} ``` end'))) == '{"a": 1}'
    assert one(spark, T.json_object(F.lit("none"))) is None
    assert one(spark, T.identifier_variants(F.lit("a/b.md"))) == ["a/b.md", "a/b"]
    assert one(spark, T.derived_title(F.lit(None).cast("string"), F.lit(""), F.lit("\n# Head\nx"), F.lit("a/stem.md"))) == "Head"
    assert one(spark, T.derived_title(F.lit(""), F.lit(""), F.lit(""), F.lit("a/stem.md"))) == "stem"
    parts = one(spark, T.target_parts(F.lit("vault://main/a/b")))
    assert (parts["collection"], parts["path"]) == ("main", "a/b")
    assert one(spark, T.source_class(F.lit("88_Agents/sessions/x.md"))) == "agent_session"
    assert one(spark, T.source_class(F.lit("a/context.md"))) == "vault_note"
    assert one(spark, T.source_class(F.lit("a/context.md"), compat=True)) == "imported_text"


def test_name_uuid_equals_the_standard_one(spark):
    import uuid

    assert one(spark, T.name_uuid(F.lit("notes:chunk:7"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "notes:chunk:7"))


def test_globs_cross_slashes(spark):
    assert one(spark, T.excluded(F.lit("a/b/x.tmp.md"), ["*.tmp.md"]))
    assert not one(spark, T.excluded(F.lit("a/b/x.md"), ["*.tmp.md", "[!a]*"]))


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "motoring": "motor", "sky": "sky", "happy": "happi"}
    assert {w: stemming.stem(w) for w in pairs} == pairs


def test_frontmatter_rules(spark):
    def errors(**fields):
        m = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.lit(v))])
        return one(spark, validation.frontmatter_errors(m))

    assert errors(type="note", domain="ai", created="2025-01-02") == []
    assert errors(type="odd", domain="ai", created="2025-13-02", tags="type/x, y") == ["unknown type", "created is no date", "tag mirrors a property"]
    assert one(spark, validation.path_errors(F.lit("../x.md"), [""], [])) == ["path leads up"]
    assert one(spark, validation.path_errors(F.lit("notes/x.md"), ["notes"], ["notes/private"])) == []


# --- ranking and fusion ---------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [2, 50_000])
def test_places_with_ties_and_wide_groups(spark, wide):
    values = [("a", float(v)) for v in (5, 5, 3, 2, 2, 2, 1)] + [("b", None), ("b", 4.0)] + [("c", float(i % 40)) for i in range(400)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {(r["g"], r["v"]): (r["place"], r["ties"], r["total"]) for r in ranking.places(df, ["g"], "v", wide=wide).collect()}
    assert got["a", 5.0] == (1, 2, 7) and got["a", 2.0] == (4, 3, 7) and got["b", 4.0] == (1, 1, 1)
    assert got["c", 39.0] == (1, 10, 400) and got["c", 0.0] == (391, 10, 400)


def test_reciprocal_ranks_by_hand(spark):
    lane = "query_id int, record_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], lane)
    b = spark.createDataFrame([(1, "y", 1)], lane)
    got = fusion.reciprocal_ranks({"title": a, "keyword": b}, 5).orderBy("rank").collect()
    assert [(r["record_id"], r["retrieval_lanes"]) for r in got] == [("y", ["title", "keyword"]), ("x", ["title"])]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_diversity_defers_and_fills(spark):
    df = spark.createDataFrame([(1, "a.md", 1, "a1"), (1, "a.md", 2, "a2"), (1, "a.md", 3, "a3"), (1, "b.md", 4, "b1")], "query_id int, rel_path string, rank int, id string")
    assert [r["id"] for r in fusion.diversify(df, 3, 1).orderBy("place").collect()] == ["a1", "b1", "a2"]
    assert [r["id"] for r in fusion.diversify(df, 3, 1, fill=False).orderBy("place").collect()] == ["a1", "b1"]


def test_views(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "p", "t")], "query_id int, id string, score double, rel_path string, title string")
    assert fusion.shape(df, "minimal").columns == ["query_id", "id", "score", "rel_path", "title"]
    with pytest.raises(ValueError):
        fusion.shape(df, "other")


def test_session_prefixes(spark):
    cases = {"a/Sessions/x/y.md": "a/Sessions", "a/2025-01-02-x/y.md": "a/2025-01-02-x", "a/2025-01-02.md": "a", "a/b.md": None, "x.md": None}
    assert {p: one(spark, sessions.session_prefix(F.lit(p))) for p in cases} == cases


def test_sessions_are_capped(spark):
    data = [(1, "s1", "88_Agents/sessions/a.md", 0.98, 0.3), (1, "s2", "88_Agents/sessions/b.md", 0.74, 0.9), (1, "n", "notes/c.md", 0.70, 1.0)]
    df = spark.createDataFrame(data, "query_id int, record_id string, rel_path string, score double, factor double")
    got = [r["record_id"] for r in sessions.apply_policy(df, "penalize", 1).orderBy("place").collect()]
    assert got == ["n", "s2"]
    assert sessions.apply_policy(df, "exclude").count() == 1 and sessions.apply_policy(df, "include").count() == 3


# --- graph ----------------------------------------------------------------------------------------


def test_links_in_text(spark):
    text = "See [[Note A#part|shown]] and [[work:Other]] ![[img.png]] ![x](y.png) [m](../dir/b.md#s) [w](https://x.y)\n```\n[[no]]\n```\n`[[neither]]`"
    got = {(x["target"], x["edge_type"], x["source_kind"]) for x in one(spark, graph.links_in(F.lit(text), F.create_map(F.lit("related"), F.lit("[P, Q]"))))}
    assert got == {
        ("Note A", "links_to", "wikilink"), ("Other", "wikilink:work", "wikilink"), ("img.png", "links_to", "wikilink"),
        ("../dir/b", "links_to", "markdown"), ("P", "related", "frontmatter"), ("Q", "related", "frontmatter"),
    }
    assert one(spark, graph.links_in(F.lit(None).cast("string"))) == []


def test_collapse_and_walk(spark):
    schema = "source_rel_path string, target_identifier string, edge_type string, source_kind string, anchor_text string, confidence double"
    edges = spark.createDataFrame(
        [("a.md", "b", "l", "w", "x", 0.7), ("a.md", "b", "l", "m", "", 0.9), ("b.md", "c.md", "l", "w", None, 1.0), ("c.md", "a", "l", "w", None, 1.0)], schema
    )
    top = graph.collapse_edges(edges).where("source_rel_path = 'a.md'").first()
    assert (top["provenance_count"], top["confidence"], top["anchors"]) == (2, 0.9, ["x"])
    starts = spark.createDataFrame([("a.md",)], "start string")
    assert {(r["source"], r["target"], r["level"]) for r in graph.traverse(edges, starts, 3).collect()} == {("a", "b", 1), ("b", "c", 2), ("c", "a", 3)}
    assert graph.traverse(edges, starts, 1, "in").count() == 1
    assert graph.traverse(edges, starts, 1, "both", limit=1).count() == 1
    with pytest.raises(ValueError):
        graph.traverse(edges, starts, 1, "up")


def test_graph_signals_boost_and_demote(spark):
    points = [(1, f"p{i}.md", 1.0 - i / 100, i + 1) for i in range(4)]
    df = spark.createDataFrame(points, "query_id int, rel_path string, score double, rank int")
    edges = spark.createDataFrame([("p0.md", "p3"), ("p1.md", "p3.md"), ("p3.md", "p3")], "source_rel_path string, target_identifier string")
    got = {r["rel_path"]: (r["score"], r["place"]) for r in graph.graph_signals(df, edges).collect()}
    assert got["p3.md"] == (pytest.approx(0.97 * 1.05), 1)
    assert got["p1.md"] == (pytest.approx(0.99), 3)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (1, 2)], "a int, b int")
    assert rows(components.connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- chunks, windows, knowledge -------------------------------------------------------------------


def test_chunks_keep_limits_and_lines():
    text = "intro line\n\n# A\n\n" + "\n\n".join("Word " * 150 + "end." for _ in range(4)) + "\n\n```\n# no heading\n```\n\n## B\n\nshort"
    chunks = chunking.chunk_text(text)
    assert all(c[3] <= 320 for c in chunks)
    assert chunks[0][4] == 1 and chunks[-1][5] == len(text.split("\n"))
    assert any("# no heading" in c[0] for c in chunks) and all("no heading" not in c[1] for c in chunks)
    assert chunking.chunk_text(None) == [] and chunking.chunk_text(" \n ") == []
    assert [c[3] for c in chunking.chunk_text("x " * 1000)][0] == 320


def test_ranges_and_windows(spark):
    schema = "id bigint, document_id bigint, start_line int, end_line int"
    a = spark.createDataFrame([(1, 1, 1, 200), (2, 1, 300, 301), (3, 2, 1, 5)], schema)
    b = spark.createDataFrame([(10, 1, 60, 70), (11, 1, 199, 300), (12, 2, 6, 9)], schema)
    assert rows(windows.overlapping(a, b)) == [(1, 1, 10), (1, 1, 11), (1, 2, 11)]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_adjacent_texts_across_blocks(spark, block):
    data = [(i, 1, 1, x, t) for i, (x, t) in enumerate([(0, "a"), (1, None), (2, "c"), (7, "d"), (8, "e")])] + [(9, 2, 1, 0, "x"), (10, None, 1, 0, "y"), (11, None, 1, 4, "z")]
    df = spark.createDataFrame(data, "id bigint, document_id bigint, version int, chunk_index int, text_content string")
    got = {r["id"]: (r["prev_text"], r["next_text"]) for r in windows.adjacent_texts(df, block).collect()}
    assert got == {0: (None, None), 1: ("a", "c"), 2: (None, "d"), 3: ("c", "e"), 4: ("d", None), 9: (None, None), 10: (None, "z"), 11: ("y", None)}


def test_objects_merge(spark):
    schema = "id bigint, document_id bigint, object_type string, title string, body_text string, source_chunk_ids array<bigint>, line_start int, line_end int, confidence double"
    data = [
        (1, 1, "concept", "Big Idea", "short", [3], 5, 9, 0.2), (2, 1, "concept", " big  idea", "a longer body", [1, 3], 2, 4, 0.9),
        (3, 1, "segment_summary", "Big Idea", "s", [1], 1, 1, 0.5), (4, 1, "concept", None, "x", [9], 1, 1, None),
    ]
    got = {r["id"]: r for r in knowledge.merge_objects(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1]["body_text"], got[1]["source_chunk_ids"], got[1]["line_start"], got[1]["line_end"], got[1]["confidence"]) == ("a longer body", [1, 3], 2, 9, 0.9)
    body = one(spark, knowledge.body_text("concept", F.lit('{"title": "T", "definition": "D", "signals": ["a", " ", "b"]}')))
    assert body == "Title: T\nDefinition: D\nSignals: a; b"


def test_extractor_plugin(spark):
    df = spark.createDataFrame([(1, 1, "text", 1, 2), (2, 1, None, 3, 4)], "id bigint, document_id bigint, text_content string, start_line int, end_line int")
    made = knowledge.extract_objects(df, lambda: lambda text: [{"object_type": "concept", "title": text, "confidence": 7}] if text else [])
    assert [(r["chunk_id"], r["title"], r["confidence"]) for r in made.collect()] == [(1, "text", 1.0)]


def test_health(spark):
    schema = "chunks bigint, p95_tokens double, max_tokens bigint, over_max_chunks bigint, under_min_chunks bigint"
    df = spark.createDataFrame([(1000, 305.0, 430, 12, 120), (1000, 520.0, 900, 180, 40), (0, None, None, 0, 0)], schema)
    assert [r["assessment"] for r in stats.health(df, 360).collect()] == ["healthy", "too_long", "no_chunks"]


def test_vectors_and_batches(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0])], "vec_id bigint, embedding array<double>")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vectors.nearest(v, q, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert vectors.nearest(v, q.limit(0), 2).count() == 0
    docs = spark.createDataFrame([("s", i, "w " * 6) for i in range(5)], "source_key string, item_no int, text string")
    assert [r["batch_no"] for r in vectors.pack_batches(docs, 24, 32).orderBy("item_no").collect()] == [0, 0, 1, 1, 2]
    assert [r["batch_no"] for r in vectors.pack_batches(docs, 24, 32, block=3).orderBy("item_no").collect()] == [0, 0, 1, 3, 3]


def test_hash_embedding(spark):
    got = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(vectors.hash_embedding(8)("t").alias("v")).collect()
    assert abs(sum(x * x for x in got[0]["v"]) - 1) < 1e-9 and not any(got[1]["v"]) and not any(got[2]["v"])


def test_refresh_classes(spark):
    at = datetime(2025, 1, 1)
    us = int(at.timestamp() * 1e6) if at.tzinfo else 1735689600 * 10**6
    stored = spark.createDataFrame(
        [(1, "same", f'{{"file_size": 5, "file_mtime_ns": {us * 1000}}}', at), (1, "size", f'{{"file_size": 6, "file_mtime_ns": {us * 1000}}}', at), (1, "fill", '{"file_size": 5}', at), (1, "blank", "{}", at), (1, "gone", "{}", at), (1, "stale", "{}", datetime(2024, 1, 1))],
        "collection_id bigint, rel_path string, metadata_json string, updated_at timestamp_ntz",
    )
    listed = spark.createDataFrame([(1, p, 5, at) for p in ("same", "size", "fill", "blank", "stale", "fresh")], "collection_id bigint, rel_path string, file_size bigint, file_mtime timestamp_ntz")
    got = {r["rel_path"]: r["action"] for r in refresh.classify_refresh(stored, listed).collect()}
    assert got == {"same": "unchanged", "size": "changed", "fill": "backfill", "blank": "backfill", "gone": "deleted", "stale": "changed", "fresh": "new"}


# --- incremental processing -----------------------------------------------------------------------

LISTING = "listing_id bigint, collection_id bigint, rel_path string, file_hash string, file_size bigint, file_mtime timestamp, extra string"


def listing(spark, *items):
    return spark.createDataFrame([(i, 1, p, h, 1, t, "x") for i, (p, h, t) in enumerate(items)], LISTING)


def test_checksums(spark):
    assert one(spark, incremental.checksum(F.lit("SHA256:ABcd12"))) == "abcd12"
    assert one(spark, incremental.checksum(F.lit("0xAB "))) == "ab"


def test_incremental_job_is_exactly_once(spark, tmp_path):
    t = datetime(2025, 1, 1)
    fail = {"on": True}

    def work(batch):
        if fail["on"]:
            raise RuntimeError("lost")
        return batch.select("rel_path", F.upper("rel_path").alias("out"))

    job = incremental.IncrementalJob(spark, str(tmp_path), work)
    first = listing(spark, ("a", "sha256:AA", t), ("b", "bb", t), (None, "cc", t))
    with pytest.raises(RuntimeError):
        job.run(first)
    assert job.manifest().count() == 0
    fail["on"] = False
    batch, n = job.run(first)
    assert n == 2 and job.run(first) == (None, 0)
    # output of a run that broke off before its commit is not seen, and is replaced
    again = listing(spark, ("a", "aa", t), ("b", "b2", datetime(2025, 1, 2)), ("b", "old", datetime(2024, 1, 1)))
    job._commit, keep = (lambda *a: (_ for _ in ()).throw(OSError("lost"))), job._commit
    with pytest.raises(OSError):
        job.run(again)
    assert job.results().count() == 2
    job._commit = keep
    assert job.run(again)[1] == 1 and job.results().count() == 3 and job.run(again) == (None, 0)


def test_a_listing_that_grows_during_a_run_loses_no_file(spark, tmp_path):
    """The listing is another one at each evaluation, as with a source that is read anew; claim, output and manifest agree."""
    t = datetime(2025, 1, 1)
    seen = []

    def work(batch):
        seen.append(sorted(r["rel_path"] for r in batch.collect()))
        path.write_text(path.read_text() + "\n".join(f'{{"listing_id": {50 + len(seen)}, "collection_id": 1, "rel_path": "new{len(seen)}", "file_hash": "ff", "file_size": 1}}' for _ in "x") + "\n")
        spark.catalog.clearCache()
        return spark.read.json(str(path)).select("collection_id", "rel_path").join(batch.select("rel_path"), "rel_path", "left_semi").select("collection_id", "rel_path")

    path = tmp_path / "listing.json"
    path.write_text("".join(f'{{"listing_id": {i}, "collection_id": 1, "rel_path": "f{i}", "file_hash": "a{i}", "file_size": 1}}\n' for i in range(3)))
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"), work)
    read = lambda: spark.read.schema("listing_id bigint, collection_id bigint, rel_path string, file_hash string, file_size bigint, file_mtime timestamp").json(str(path))
    assert job.run(read())[1] == 3 and job.run(read())[1] == 1 and job.run(read())[1] == 1
    assert seen == [["f0", "f1", "f2"], ["new1"], ["new2"]]
    assert sorted(r["rel_path"] for r in job.results().collect()) == ["f0", "f1", "f2", "new1", "new2"]


@pytest.mark.parametrize("step", ["_claim", "_publish", "work", "_commit"])
def test_a_run_that_breaks_off_at_any_step_is_repeated(spark, tmp_path, step):
    t = datetime(2025, 1, 1)
    job = incremental.IncrementalJob(spark, str(tmp_path), lambda batch: batch.select("collection_id", "rel_path", "checksum"))
    assert job.run(listing(spark, ("a", "aa", t)))[1] == 1
    two = listing(spark, ("a", "aa", t), ("b", "bb", t))
    keep = getattr(job, step)
    setattr(job, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        job.run(two)
    setattr(job, step, keep)
    assert [r["rel_path"] for r in job.results().collect()] == ["a"]
    # meanwhile another file came; with a claim it waits for the batch after
    three = listing(spark, ("a", "aa", t), ("b", "bb", t), ("c", "cc", t))
    runs = [job.run(three)[1] for _ in range(3)]
    assert runs == ([2, 0, 0] if step in ("_claim", "_publish") else [1, 1, 0])
    assert sorted(r["rel_path"] for r in job.results().collect()) == ["a", "b", "c"]


def test_sizes_are_compared_where_known(spark, tmp_path):
    t = datetime(2025, 1, 1)
    job = incremental.IncrementalJob(spark, str(tmp_path), lambda batch: batch.select("collection_id", "rel_path"))
    job.adopt(spark.createDataFrame([(1, "old", "aa", None), (1, "grown", "aa", 9)], "collection_id bigint, rel_path string, checksum string, file_size bigint"))
    assert job.run(listing(spark, ("old", "aa", t), ("grown", "aa", t)))[1] == 1
    assert [r["rel_path"] for r in job.results().collect()] == ["grown"]


def test_a_file_that_changes_back_is_processed_again(spark, tmp_path):
    job = incremental.IncrementalJob(spark, str(tmp_path), lambda batch: batch.select("collection_id", "rel_path", "checksum"))
    for day, hashed in enumerate(["aa", "bb", "aa"], 1):
        files = listing(spark, ("a", hashed, datetime(2025, 1, day)), ("same", "cc", datetime(2025, 1, 1)))
        assert job.run(files)[1] == (2 if day == 1 else 1) and job.run(files) == (None, 0)
        assert sorted((r["rel_path"], r["checksum"]) for r in job.results().collect()) == [("a", hashed), ("same", "cc")]


def test_batches_of_long_sources_follow_the_sql(spark, tmp_path):
    import duckdb
    from notarium.plans import store

    rows = [(i, 1 + (i >= 9000), i % 9000, "word " * (1 + i * 7919 % 700), None) for i in range(9100)]
    fields = "id bigint, document_id bigint, chunk_index int, text_content string, qdrant_point_id string"
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/vq_chunks.parquet")
    got = sorted(map(tuple, store.embed_batches(spark, str(tmp_path)).collect()))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW vq_chunks AS SELECT * FROM read_parquet('{tmp_path}/vq_chunks.parquet/*.parquet')")
    assert got == sorted(base.execute(store.SQL["embed_batches"]).fetchall())


def test_next_actions(spark):
    t = datetime(2025, 1, 1, 12)
    files = listing(spark, ("new", "aa", t), ("changed", "aa", t), ("retry", "aa", t), ("open", "aa", t), ("done", "SHA256:AA", t), ("dead", "ff", t))
    notes = spark.createDataFrame(
        [(i, 1, p, h, s, u) for i, (p, h, s, u) in enumerate([("changed", "bb", "indexed", t), ("retry", "aa", "indexed", datetime(2025, 2, 1, 1)), ("open", "aa", None, t), ("done", "aa", "indexed", t), ("dead", "aa", "deleted", t)])],
        "id bigint, collection_id bigint, rel_path string, file_hash string, status string, updated_at timestamp",
    )
    runs = spark.createDataFrame(
        [(1, datetime(2025, 1, 31, 23), datetime(2025, 2, 1, 2), "aborted"), (2, datetime(2025, 1, 1), datetime(2025, 1, 2), "succeeded"), (3, None, None, None)],
        "run_id bigint, started_at timestamp, last_heartbeat_at timestamp, status string",
    )
    chunks = spark.createDataFrame([(2, "  "), (2, "p"), (3, "p"), (None, None)], "document_id bigint, qdrant_point_id string")
    got = {r["rel_path"]: r["action"] for r in incremental.next_actions(files, notes, runs, chunks).collect()}
    assert got == {"new": "new", "changed": "changed", "retry": "retry", "open": "unembedded"}
    empty = incremental.next_actions(files.limit(0), notes, runs, chunks)
    assert empty.count() == 0
    assert {r["action"] for r in incremental.next_actions(files, notes.limit(0), runs.limit(0), chunks.limit(0)).collect()} == {"new"}


# --- references -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "written, want",
    [
        (" ./A/B%20c.md#part ", "a/b c"), ("A\\B", "a/b"), ("/x/", "x"), ("#only", None), ("mailto:a@b.c", None), ("https://x", None),
        ("100%", "100%"), ("a+b", "a+b"), ("", None), (None, None), ("Note.MD", "note"), ("b%C3%A9.md", "bé"),
    ],
)
def test_link_targets(spark, written, want):
    assert one(spark, references.link_target(F.lit(written).cast("string"))) == want


@pytest.mark.parametrize(
    "match, want",
    [
        ("simple", {1: None, 2: "missing", 3: None, 4: None, 5: None}),
        ("partial", {1: None, 2: "missing", 3: None, 4: "missing", 5: None}),
        ("full", {1: None, 2: "missing", 3: "missing", 4: "missing", 5: None}),
    ],
)
def test_composite_keys_with_nulls(spark, match, want):
    refs = spark.createDataFrame([(1, "a", "b"), (2, "a", "z"), (3, "a", None), (4, None, "q"), (5, None, None)], "id int, k1 string, k2 string").withColumn("state", F.lit("x"))
    targets = spark.createDataFrame([("a", "b"), ("c", None), (None, None)], "k1 string, k2 string")
    got = {r["id"]: r["state"] for r in references.resolve(refs, targets, ["k1", "k2"], match).collect()}
    assert got == want


def test_late_and_deleted(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    refs = spark.createDataFrame([(1, 1, t1), (2, 2, t1), (3, 3, t0), (4, 9, t0), (4, 9, t0), (5, 3, None)], "id int, k int, at timestamp")
    targets = spark.createDataFrame([(1, "x", t0), (2, "deleted", t0), (3, "x", t1)], "k int, status string, since timestamp")
    got = rows(references.resolve(refs, targets, ["k"], "simple", F.col("status") != "deleted", "since", "at").select("id", "state"))
    assert got == [(1, None), (2, "deleted"), (3, "late"), (4, "missing"), (4, "missing"), (5, None)]
    assert references.resolve(refs.limit(0), targets, ["k"]).count() == 0
    with pytest.raises(ValueError):
        references.resolve(refs, targets, ["k"], "other")


# --- sources and streaming ------------------------------------------------------------------------


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+1.md").write_text("---\ntitle: 'Given'\n---\n# Head\nbody")
    (tmp_path / "y.tmp.md").write_text("no")
    files = scan.list_files(spark, str(tmp_path), "**/*.md", ["*.tmp.md"]).collect()
    assert [(r["rel_path"], r["file_size"]) for r in files] == [("a b/x+1.md", 34)]
    note = scan.read_notes(spark, str(tmp_path), 3, excludes=["*.tmp.md"]).first()
    assert (note["collection_id"], note["title"], note["frontmatter"]) == (3, "Given", "title: 'Given'")
    only = spark.createDataFrame([("none.md",)], "rel_path string")
    assert scan.read_notes(spark, str(tmp_path), 3, only=only).count() == 0
    maps = spark.createDataFrame([("a: 1\nb:\n  - x\n  - y",), (None,), ("{{ x",)], "b string").select(scan.frontmatter_map()("b").alias("m")).collect()
    assert maps[0]["m"] == {"a": "1", "b": "x, y"} and maps[1]["m"] == {}


def test_a_second_writer_of_a_table_waits(spark, tmp_path):
    one, two = (SnapshotStore(spark, "file://" + str(tmp_path)) for _ in "ab")
    with one.lock("t"):
        one.write("t", spark.range(3))
        with pytest.raises(TimeoutError), two.lock("t", timeout=0, poll=0):
            pass
        with two.lock("t", stale=-1):
            pass
    assert two.write("t", spark.range(5)) == 2 and one.read("t").count() == 5
    assert one.update("t", lambda df: df.limit(1)) == 3 and two.read("t").count() == 1
    assert not (tmp_path / "t" / "LOCK").exists()


@pytest.mark.parametrize(
    "message, gone, kept",
    [
        ('{"api_key": "abc123", "password": "hunter2", "n": 1}', ["abc123", "hunter2"], ['"n": 1}']), ("Authorization: Bearer abc.def token=5, done", ["abc.def", "5"], [", done"]),
        ("password = 'a b c' next", ["a b c"], ["next"]), ('{"a": {"db_password":"p\\"q", "n": 3}}', ["p\\", "q"], ['"n": 3}}']), ("?api_key=zz&x=1", ["zz"], ["&x=1"]),
        ("password:\n  xyz", ["xyz"], []), ("secret: 'unclosed", ["unclosed"], []), ("the token was lost, sk-abcdefghijkl", ["sk-"], ["the token was lost"]),
    ],
)
def test_secrets_go_whatever_their_quotes(spark, message, gone, kept):
    out = one(spark, T.redacted(F.lit(message)))
    assert not any(g in out for g in gone) and all(k in out for k in kept)


def test_snapshots_and_lock(spark, tmp_path):
    store = SnapshotStore(spark, "file://" + str(tmp_path))
    assert store.version("t") is None
    with pytest.raises(LookupError):
        store.read("t")
    store.write("t", spark.range(3))
    store.update("t", lambda df: df.where("id > 0"))
    assert (store.version("t"), store.read("t").count()) == (2, 2)
    lock = str(tmp_path / "lock")
    with write_lock(lock, "a"):
        with pytest.raises(TimeoutError), write_lock(lock, "b", timeout=0, poll=0):
            pass
        with write_lock(lock, "c", stale=-1, timeout=0):
            pass


def test_settings_and_receipts(spark, tmp_path):
    assert settings.Settings.from_env({"NOTARIUM_RERANK_POOL": "7", "NOTARIUM_CHUNK_OVERLAP": "x"}).rerank_pool == 7
    path = str(tmp_path / "c.json")
    settings.write_config(settings.add_context(settings.add_collection(settings.read_config(path), "n", "/r"), "n", "/p/", "t"), path)
    assert settings.read_config(path)["contexts"] == [{"collection": "n", "prefix": "p", "text": "t"}]
    env = tmp_path / ".env"
    env.write_text("# c\nexport SOME_NOTE_KEY='v'\n")
    assert settings.load_env([str(env), "/nowhere"]) == {"SOME_NOTE_KEY": "v"}
    df = spark.createDataFrame([(datetime(2025, 1, 2), "token=abc")], "at timestamp, note string")
    receipts.append(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["note"] == "token=<redacted>"


def test_notes_are_written_safely(tmp_path):
    first = note_files.capture(str(tmp_path), "Inbox", "some text", "A Title!", datetime(2025, 3, 4))
    again = note_files.capture(str(tmp_path), "Inbox", "more", "A Title!", datetime(2025, 3, 4))
    assert (first.rel_path, again.rel_path) == ("Inbox/2025-03-04-a-title.md", "Inbox/2025-03-04-a-title-2.md")
    assert note_files.append(str(tmp_path), first.rel_path, "tail", "More").before == first.after
    for bad in ("/x.md", "../x.md", "x.txt", ""):
        with pytest.raises(ValueError):
            note_files.put(str(tmp_path), bad, "x")


def test_watch_beats():
    now = {"t": 0.0}
    calls = []

    def failing():
        raise RuntimeError

    work = {"new_files": lambda: calls.append(("new", now["t"])) or 1, "changed": failing, "pending": lambda: 2}
    got = watch.watch(work, watch.Beat(600, 86400, 300), poll=300, loops=4, clock=lambda: now["t"], sleep=lambda s: now.update(t=now["t"] + s))
    assert (got["new_files"], got["pending"], got["errors"], calls) == (2, 8, 1, [("new", 0.0), ("new", 600.0)])
    assert watch.drain(iter([3, 2, 0, 9]).__next__) == 5


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    seen = []
    for extra in ("b.md", None):
        watch.stream_new_files(spark, str(tmp_path / "in"), lambda df, i: seen.extend(r["text"] for r in df.select("text").collect()), str(tmp_path / "cp")).awaitTermination()
        if extra:
            (tmp_path / "in" / extra).write_text("two")
    assert seen == ["one", "two"]
    assert watch.status_rows(spark).count() == 0


def test_operations(spark, small):
    from notarium.engine import Engine
    from notarium.operations import OPERATIONS, check_params, list_operations, run

    engine = Engine(spark, small)
    linked = spark.read.parquet(f"{small}/vq_links.parquet").where("target_identifier NOT LIKE '%:%'").first()["target_identifier"]
    assert {o["name"] for o in list_operations()} == set(OPERATIONS)
    with pytest.raises(ValueError, match="missing parameter query; "):
        check_params(OPERATIONS["query"], {"mode": "odd"} | {"limit": True})
    assert not run(engine, "nothing")["ok"] and not run(engine, "query", {"query": 3})["ok"]
    for name, params in [("status", {}), ("chunk_stats", {"collection_name": "main_vault"}), ("get_doc", {"identifier": "#1"}), ("graph_backlinks", {"identifier": linked}), ("query", {"query": "journal", "limit": 3})]:
        assert run(engine, name, params)["data"].count() >= 1
    for mode in ("keyword", "title", "focused"):
        engine.search("journal", 3, mode, "minimal").collect()
    assert engine.think("journal").count() == 1 and engine.related("journal review").count() >= 1
    assert engine.search("   ").count() == 0
