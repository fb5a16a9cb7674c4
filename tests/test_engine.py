"""The engine end to end: index runs over files, vectors, look-ups, operations and the stages of a search."""

import math
import re
import shutil
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notarium import indexing
from notarium.engine import Engine
from notarium.operations import OPERATIONS, list_operations, run, summarize_params
from notarium.operators import clusters, lexical, pipeline, vectors
from notarium.sources.snapshots import SnapshotStore

PLAIN = pipeline.Options(as_of="2025-11-01", radius=0)
FILES = {
    "a.md": "---\ntitle: Alpha\ntype: note\n---\n# One\n\nThe kettle boils in the old kitchen.\n\n# Two\n\nA river runs.",
    "sub/b.md": "# Beta\n\nSecond note about ledgers.",
    "skip/c.md": "no",
}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "vault"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture()
def indexer(spark, tmp_path):
    return indexing.Indexer(spark, SnapshotStore(spark, "file://" + str(tmp_path / "store")))


def test_index_run_follows_the_files(spark, tree, indexer):
    go = lambda **how: indexer.run(1, str(tree), excludes=["skip/*"], **how)
    first = go()
    assert (first["indexed"], first["deleted"], first["read"]) == (2, 0, 2)
    notes = {r["rel_path"]: r for r in indexer.table("vq_documents").collect()}
    assert notes["a.md"]["title"] == "Alpha" and '"type":"note"' in notes["a.md"]["frontmatter_json"] and set(notes) == {"a.md", "sub/b.md"}
    chunks = indexer.table("vq_chunks").collect()
    assert {r["document_id"] for r in chunks} == {notes[p]["id"] for p in notes} and len({r["id"] for r in chunks}) == len(chunks)
    assert go() == {"indexed": 0, "deleted": 0, "backfilled": 0, "unchanged": 2, "read": 0}
    (tree / "a.md").write_text("# One\n\nThe kettle is cold now.")
    (tree / "sub/b.md").unlink()
    (tree / "new.md").write_text("fresh")
    assert (go(limit=1)["indexed"], indexer.table("vq_documents").count()) == (1, 2)  # nothing is dropped with a limit
    again = go()
    assert (again["indexed"], again["deleted"]) == (1, 1)
    kept = {r["rel_path"]: r["id"] for r in indexer.table("vq_documents").collect()}
    assert set(kept) == {"a.md", "new.md"} and kept["a.md"] == notes["a.md"]["id"]
    texts = " ".join(r["text_content"] for r in indexer.table("vq_chunks").collect())
    assert "cold" in texts and "boils" not in texts and "ledgers" not in texts
    assert go(force=True)["indexed"] == 2
    assert indexer.run(1, str(tree), paths=["new.md"], force=True)["indexed"] == 1


def test_stamps_are_compared_to_the_microsecond(spark):
    from notarium.operators import refresh

    times = [1_764_166_773_000_000 + 1000 * i for i in range(2000)]
    stored = spark.createDataFrame([(1, str(t), f'{{"file_size": 1, "file_mtime_ns": {t * 1000}}}') for t in times], "collection_id bigint, rel_path string, metadata_json string")
    stored = stored.withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    listed = spark.createDataFrame([(1, str(t), 1, t) for t in times], "collection_id bigint, rel_path string, file_size bigint, t bigint").withColumn("file_mtime", F.timestamp_micros("t"))
    assert refresh.classify_refresh(stored, listed).where("action <> 'unchanged'").count() == 0


def test_a_touched_file_keeps_its_chunks_and_an_unstamped_row_gets_its_stamp(spark, tree, indexer):
    import os

    indexer.run(1, str(tree))
    before = {r["id"] for r in indexer.table("vq_chunks").collect()}
    os.utime(tree / "a.md", (2_000_000_000, 2_000_000_000))
    got = indexer.run(1, str(tree))
    assert (got["read"], got["indexed"]) == (1, 0) and {r["id"] for r in indexer.table("vq_chunks").collect()} == before
    indexer.store.update("vq_documents", lambda df: df.withColumn("metadata_json", F.lit("{}")).withColumn("updated_at", F.lit("2040-01-01").cast("timestamp_ntz")))
    assert indexer.run(1, str(tree))["backfilled"] == 3
    assert indexer.run(1, str(tree))["unchanged"] == 3


@pytest.mark.parametrize("table", ["vq_vectors", "vq_objects", "vq_chunks", "vq_documents"])
def test_a_run_that_breaks_off_at_any_table_is_repeated(spark, tree, indexer, table):
    indexer.run(1, str(tree))
    (tree / "a.md").write_text("# One\n\nAll new words.")
    keep = indexer.store.write

    def broken(name, *a, **k):
        if name == table:
            raise OSError("lost")
        return keep(name, *a, **k)

    indexer.store.write = broken
    with pytest.raises(OSError):
        indexer.run(1, str(tree))
    indexer.store.write = keep
    assert indexer.run(1, str(tree))["indexed"] == 1
    chunks = indexer.table("vq_chunks")
    assert chunks.groupBy("document_id", "chunk_index").count().where("count > 1").count() == 0
    assert [r["text_content"] for r in chunks.collect() if "All new words" in r["text_content"]] and not [r for r in chunks.collect() if "boils" in r["text_content"]]


def test_objects_and_points_follow_their_notes(spark, tree, indexer):
    indexer.run(1, str(tree))
    assert indexer.embed()["embedded"] == indexer.table("vq_chunks").count() == indexer.table("vq_vectors").count()
    assert indexer.embed() == {"embedded": 0, "waiting": 0, "requests": 0}
    note = next(r for r in indexer.table("vq_documents").collect() if r["rel_path"] == "a.md")
    objects = spark.createDataFrame([(7, note["id"], "concept", "Kettle", "boils", [1], 6, 7, 0.5, "p7"), (8, 99, "concept", "Other", "x", [1], 1, 2, 0.5, "p8")], indexing.TABLES["vq_objects"])
    indexer.store.write("vq_objects", objects)
    (tree / "a.md").write_text(FILES["a.md"] + "\n\nMore.")
    indexer.run(1, str(tree))
    rows = {r["id"]: r for r in indexer.table("vq_objects").collect()}
    own = {r["id"] for r in indexer.table("vq_chunks").where(F.col("document_id") == note["id"]).collect()}
    assert rows[7]["qdrant_point_id"] is None and set(rows[7]["source_chunk_ids"]) <= own and rows[7]["source_chunk_ids"] and rows[8]["qdrant_point_id"] == "p8"
    points = {r["qdrant_point_id"] for r in indexer.table("vq_chunks").where("qdrant_point_id IS NOT NULL").collect()}
    assert {r["point_id"] for r in indexer.table("vq_vectors").collect()} == points
    assert indexer.embed(limit=1)["embedded"] == 1


def test_writes_that_are_too_large_are_halved():
    sent = []

    def send(points):
        if len(points) > 3:
            raise ValueError("413")
        sent.append(points)

    indexing.send_halving(list(range(10)), send)
    assert [x for part in sent for x in part] == list(range(10)) and max(map(len, sent)) <= 3
    calls = []
    with pytest.raises(ValueError):
        indexing.send_halving([1], lambda p: calls.append(p) or (_ for _ in ()).throw(ValueError("down")), retries=3, too_large=lambda f: False)
    assert len(calls) == 3


# --- stages of a search ---------------------------------------------------------------------------

NOTES = "id bigint, collection_id bigint, rel_path string, title string, status string, markdown_text string, frontmatter_json string, updated_at timestamp_ntz"
CHUNKS = "id bigint, document_id bigint, version int, chunk_index int, heading_path string, section_title string, text_content string, start_line int, end_line int, qdrant_point_id string"
LINKS = "source_rel_path string, target_identifier string"


def corpus(spark, notes, links=(), objects=None):
    """notes: (path, title, [chunk texts])."""
    at = datetime(2025, 1, 1)
    rows = [(i, 1, p, t, "indexed", " ".join(c), "{}", at) for i, (p, t, c) in enumerate(notes, 1)]
    chunks = [(100 * i + j, i, 1, j, "H", "S", text, 10 * j + 1, 10 * j + 9, f"p{i}-{j}") for i, (_, _, c) in enumerate(notes, 1) for j, text in enumerate(c)]
    known = None if objects is None else spark.createDataFrame(objects, indexing.TABLES["vq_objects"])
    return pipeline.Corpus(
        spark.createDataFrame(rows, NOTES), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([(1, "main")], "id bigint, name string"), spark.createDataFrame(list(links), LINKS), known
    )


def found(spark, own, query, mode, n=5, options=PLAIN):
    asked = spark.createDataFrame([(1, query)], "query_id bigint, query_text string")
    return pipeline.search(own, asked, mode, n, options).orderBy("place").collect()


def test_focused_mode_gives_one_result_a_note_and_no_window(spark):
    own = corpus(spark, [("A.md", "river", ["river one", "river two"]), ("B.md", "x", ["river three"])])
    rows = found(spark, own, "river", "focused", 2, pipeline.Options(as_of="2025-11-01", scorer=None))
    assert sorted(r["rel_path"] for r in rows) == ["A.md", "B.md"] and "window_text" not in rows[0].asDict()


def test_windows_hold_the_neighbours(spark):
    own = corpus(spark, [("A.md", "x", ["first", "the river", "last"])])
    row = found(spark, own, "river", "fast", 5, pipeline.Options(as_of="2025-11-01"))[0]
    assert (row["window_text"], row["window_start_line"], row["window_end_line"]) == ("first\nthe river\nlast", 1, 29)


def test_sessions_are_held_back(spark):
    notes = [(f"88_Agents/sessions/s{i}.md", "log", ["agent transcript river log log"]) for i in range(3)] + [("notes/n.md", "note", ["a river note"])]
    own = corpus(spark, notes)
    rows = found(spark, own, "river", "fast")
    assert [r["rel_path"] for r in rows].count("notes/n.md") == 1 and sum(r["rel_path"].startswith("88_") for r in rows) == 1 and rows[0]["rel_path"] == "notes/n.md"
    assert len(found(spark, own, "river", "fast", 5, pipeline.Options(policy="include", radius=0))) == 4
    assert [r["rel_path"] for r in found(spark, own, "river", "fast", 5, pipeline.Options(policy="exclude", radius=0))] == ["notes/n.md"]


def test_links_lift_what_two_others_name(spark):
    notes = [(f"n{i}.md", f"t{i}", [f"the river here {i}"]) for i in range(5)]
    own = corpus(spark, notes, [("n0", "n4.md"), ("n1.md", "n4"), ("n2.md", "n2")])
    assert found(spark, own, "river", "hybrid")[0]["rel_path"] == "n4.md"
    assert found(spark, own, "river", "hybrid", 5, pipeline.Options(links=False, radius=0, as_of="2025-11-01"))[0]["rel_path"] != "n4.md"


def test_knowledge_objects_are_found(spark):
    own = corpus(spark, [("A.md", "x", ["nothing"]), ("B.md", "y", ["the lantern"])], objects=[(5, 1, "concept", "Lantern", "a lantern lights", [100], 3, 4, 0.9, "k5")])
    rows = {r["record_id"]: r for r in found(spark, own, "lantern", "fast")}
    assert set(rows) == {"knowledge:5", "chunk:200"} and (rows["knowledge:5"]["rel_path"], rows["knowledge:5"]["start_line"]) == ("A.md", 3)


def test_a_query_inside_a_longer_word_finds_its_title(spark):
    own = corpus(spark, [("deep/Riverbank.md", "The Riverbanks of old", ["x"]), ("B.md", "rivers", ["y"])])
    assert [r["rel_path"] for r in found(spark, own, "erbanks of", "title")] == ["deep/Riverbank.md"]
    assert [r["rel_path"] for r in found(spark, own, "ep/riv", "title")] == ["deep/Riverbank.md"]
    assert found(spark, own, "?!", "title") == [] and found(spark, own, "  ", "hybrid") == []


def test_semantic_mode_needs_vectors(spark):
    own = corpus(spark, [("A.md", "x", ["a river flows"]), ("B.md", "y", ["ledger rows"])])
    assert found(spark, own, "river flows", "semantic", 1)[0]["rel_path"] == "A.md"
    bare = pipeline.Corpus(own.notes, own.chunks.withColumn("qdrant_point_id", F.lit(" ")), own.collections, own.links)
    assert not pipeline.has_vectors(bare) and found(spark, bare, "river", "semantic") == [] and found(spark, bare, "river", "hybrid")


def test_late_terms_change_no_bm25_result(spark):
    import random

    r = random.Random(5)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(r.choice(words[:3]) if r.random() < 0.5 else r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(300)], "id bigint, t string")
    asked = [(0, "the of and"), (1, "w1"), (2, "the w2 w3"), (3, "w4 of w5 the"), (4, "nothing here"), (5, "the")] + [(10 + i, " ".join(r.choice(words) for _ in range(3))) for i in range(30)]
    queries = spark.createDataFrame(asked, "query_id bigint, query_text string")
    index, totals = lexical.query_index(texts, "id", "t", queries), lexical.lengths(texts, "id", "t")
    for limit in (3, 10):
        early, late = (sorted(map(tuple, lexical.bm25_lane(queries, index, totals, limit, frequent=share).collect())) for share in (2.0, 0.1))
        assert early == late and len(early) > 50


@pytest.fixture
def shelves(spark):
    """Texts with many equal scores, queries that share their terms, and what a loop over all pairs finds."""
    import random

    r = random.Random(11)
    words = ["the", "of"] + [f"w{i}" for i in range(12)]
    held = {i * 7: " ".join(r.choice(words) for _ in range(r.randrange(1, 12))) for i in range(400)}
    asked = {i: " ".join(r.choice([*words, "gone"]) for _ in range(r.randrange(1, 4))) for i in range(80)} | {90: "W1 the", 91: "the w1!", 92: "w3", 93: "w3 w3", 94: "?"}
    texts = spark.createDataFrame([*held.items(), *list(held.items())[:9]], "id bigint, t string")  # nine were delivered twice
    return texts, spark.createDataFrame(list(asked.items()), "query_id bigint, query_text string"), held, asked


def _direct(held, asked, limit, digits, part, every):
    want = set()
    for q, text in asked.items():
        terms, scored = set(re.findall(r"\w+", text.lower())), []
        for i, own in held.items():
            own = own.split()
            there = [t for t in terms if t in own]
            if there and (not every or len(there) == len(terms)):
                scored.append((-round(sum(part(t, own) for t in there), digits), i))
        want |= {(q, i, round(-s, digits), n + 1) for n, (s, i) in enumerate(sorted(scored)[:limit])}
    return want


def _meets_in_blocks(lane):
    plan = lane._jdf.queryExecution().executedPlan().toString()
    return "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("block, part", [(1 << 19, 1 << 20), (300, 40)])
def test_bm25_over_blocks_equals_all_pairs(spark, shelves, monkeypatch, block, part):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PART", part)
    texts, queries, held, asked = shelves
    records, mean = len(held), sum(len(t.split()) for t in held.values()) / len(held)
    df = Counter(w for t in held.values() for w in set(t.split()))

    def score(t, own):
        tf = own.count(t)
        return math.log(1 + (records - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))

    index, totals = lexical.query_index(texts, "id", "t", queries), lexical.lengths(texts, "id", "t")
    lane = lexical.bm25_lane(queries, index, totals, 6)
    assert _meets_in_blocks(lane)  # pairs of queries and records are not shuffled
    assert set(map(tuple, lane.collect())) == _direct(held, asked, 6, 6, score, False)


@pytest.mark.parametrize("block, part", [(1 << 19, 1 << 20), (300, 40)])
def test_keyword_lane_over_blocks_equals_all_pairs(spark, shelves, monkeypatch, block, part):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PART", part)
    texts, queries, held, asked = shelves
    lane = lexical.keyword_lane(queries, lexical.query_index(texts, "id", "t", queries), 6)
    assert _meets_in_blocks(lane)
    assert set(map(tuple, lane.collect())) == _direct(held, asked, 6, 9, lambda t, own: own.count(t) / (own.count(t) + 1), True)


def test_stemmed_lane_over_blocks_equals_all_pairs(spark, monkeypatch):
    from notarium.functions.stemming import STOP_WORDS, english_term, stem

    monkeypatch.setattr(lexical, "BLOCK", 60)
    words = ["river", "rivers", "run", "running", "runs", "the", "ledger", "ledgers", "walked", "walking"]
    held = {i: " ".join(words[(i * 3 + j * (1 + i % 4)) % 10] for j in range(1 + i % 6)) for i in range(90)}
    asked = {0: "Rivers", 1: "the river", 2: "walk running", 3: "the", 4: "ledger gone", 5: "runs the ledgers", 6: "run ledger"}
    texts = spark.createDataFrame([*held.items(), *list(held.items())[:5]], "id bigint, t string")
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query_text string")
    lane = lexical.stemmed_lane(queries, texts, "id", "t", english_term, 4)
    assert _meets_in_blocks(lane)
    cut = lambda text: " ".join(stem(w) for w in text.lower().split() if w not in STOP_WORDS)
    stems = {i: cut(t) for i, t in held.items()}, {i: cut(t) for i, t in asked.items()}
    assert set(map(tuple, lane.collect())) == _direct(*stems, 4, 9, lambda t, own: own.count(t) / (own.count(t) + 1), True)


def test_words_within(spark):
    terms = spark.createDataFrame([("riverbank",), ("bank",), ("ab",), ("",)], "term string")
    needles = spark.createDataFrame([("bank",), ("verb",), ("b",), ("zzz",)], "word string")
    got = {(r["word"], r["term"]) for r in lexical.words_within(terms, needles).collect()}
    assert got == {("bank", "riverbank"), ("bank", "bank"), ("verb", "riverbank"), ("b", "riverbank"), ("b", "bank"), ("b", "ab")}


def test_nearest_in_blocks_equals_the_direct_way(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, None), (501, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    direct = sorted(map(tuple, vectors.nearest(df, asked, 4).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 30)
    assert sorted(map(tuple, vectors.nearest(df, asked, 4).collect())) == direct and len(direct) == 160


def test_requests_hold_their_limits(spark):
    rows = [(k, b, 9000 + 100 * b) for k in range(6) for b in range(5)]
    df = spark.createDataFrame([(k, i, t, b) for k, b, t in rows for i in range(3)], "source_key bigint, item_no int, tokens int, batch_no bigint")
    got = vectors.pack_requests(df, 2, most=4, most_items=9, most_tokens=60_000).groupBy("lane", "request_no").agg(F.sum("items").alias("i"), F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["i"] <= 9 and r["n"] <= 4 and (r["t"] <= 60_000 or r["n"] == 1) for r in got) and sum(r["n"] for r in got) == 30


# --- clusters, look-ups, operations ---------------------------------------------------------------


def test_seed_clusters(spark):
    seeds = spark.createDataFrame([(1, "a.md", "A"), (2, "b.md", "B"), (3, "c.md", "C")], "id bigint, rel_path string, title string")
    hits = [(1, "s.md", "Shared", 0.9, 1, 1.0), (1, "a.md", "A", 0.99, 2, 1.0), (1, "s.md", "Shared", 0.5, 3, 1.0), (2, "s.md", "Shared", 0.8, 1, 1.0), (2, "low.md", "L", 0.2, 2, 1.0), (3, "88_Agents/sessions/x.md", "S", 0.95, 1, 0.5)]
    df = spark.createDataFrame(hits, "query_id bigint, rel_path string, title string, score double, place int, factor double")
    got = [r.asDict() for r in clusters.node_clusters(clusters.related_of_seeds(df, seeds), seeds).orderBy("place").collect()]
    assert [(r["anchor"], r["label"], r["seed_paths"], r["related_paths"]) for r in got] == [("s.md", "Shared", ["a.md", "b.md"], ["s.md"]), ("c.md", "C", ["c.md"], [])]
    penal = clusters.related_of_seeds(df, seeds, policy="penalize").where("seed = 'c.md'").collect()
    assert [(r["item"], r["score"]) for r in penal] == [("88_Agents/sessions/x.md", 0.475)]
    assert clusters.related_of_seeds(df, seeds, prefixes=["88_"], policy="include").count() == 1 and clusters.related_of_seeds(df, seeds, excluded=["s"]).count() == 0
    with pytest.raises(ValueError):
        clusters.related_of_seeds(df, seeds, policy="odd")


def test_look_ups_and_related_home(spark, small):
    engine = Engine(spark, small)
    chunk = spark.read.parquet(f"{small}/vq_chunks.parquet").where("qdrant_point_id LIKE '%-%' AND document_id > 1").first()
    row = engine.fetch(chunk["qdrant_point_id"]).first()
    assert row["id"] == f"chunk:{chunk['id']}" and chunk["text_content"].strip() in row["window_text"]
    assert engine.fetch("nothing").count() == 0 and engine.fetch(f"chunk:{chunk['id']}").count() == 1
    assert engine.document(f"chunk:{chunk['id']}").first()["id"] == chunk["document_id"] and engine.document("knowledge:1").count() == 0
    path = engine.document(f"#{chunk['document_id']}").first()["rel_path"]
    assert engine.document(path, True).count() >= 1
    homes = engine.related("journal review").orderBy("place").collect()
    assert homes[0]["suggested_home"] and not any(r["suggested_home"] for r in homes[1:]) and len({r["rel_path"] for r in homes}) == len(homes)


def test_all_operations_run(spark, small, tmp_path):
    folder = tmp_path / "tables"
    shutil.copytree(small, folder)
    root = tmp_path / "notes"
    root.mkdir()
    (folder / "vq_collections.parquet").unlink()
    spark.createDataFrame([(1, "main", str(root), "*.md", [])], "id bigint, name string, root_path string, pattern string, exclude_globs array<string>").coalesce(1).write.parquet(str(folder / "vq_collections.parquet"))
    engine = Engine(spark, str(folder))
    given = {
        "search": {"query": "journal"}, "query": {"query": "journal"}, "related_work": {"idea": "journal"}, "get_doc": {"identifier": "#1"}, "graph_neighbors": {"identifier": "x"},
        "graph_backlinks": {"identifier": "x"}, "graph_traverse": {"identifier": "x"}, "think": {"question": "journal"}, "fetch": {"point_id": "chunk:1"}, "semantic_clusters": {"seed_limit": 2},
        "capture": {"text": "an idea", "kind": "idea"}, "note_put": {"rel_path": "n.md", "markdown": "---\ntype: note\ndomain: ai\ncreated: 2025-01-01\n---\nx"},
        "note_append": {"rel_path": "n.md", "text": "password: hunter2"}, "note_propose": {"title": "P", "body": "b"},
    }
    for name in OPERATIONS:
        done = run(engine, name, given.get(name, {}))
        assert done["ok"], (name, done)
        done["data"].collect()
    assert (root / "n.md").read_text().endswith("password: hunter2\n") and len(list((root / "Ideas").glob("*.md"))) == 1
    receipts = spark.read.json(str(root / ".receipts"))
    assert {r["operation"] for r in receipts.collect()} == {"capture", "note_put", "note_append", "note_propose"}
    for bad in ({"rel_path": "../n.md", "markdown": given["note_put"]["markdown"]}, {"rel_path": "m.md", "markdown": "no front matter"}):
        assert not run(engine, "note_put", bad)["ok"]
    assert not run(engine, "capture", {"text": "x", "kind": "odd"})["ok"]
    assert len(list_operations()) == len(OPERATIONS) == 21
    summary = summarize_params("capture", {"text": "private note", "kind": "idea", "weird_secret": "abc"})
    assert summary["declared_keys"] == ["kind", "text"] and summary["unknown_key_count"] == 1 and "private note" not in str(summary)


def test_links_follow_the_notes(spark):
    from notarium.operators import graph

    notes = spark.createDataFrame([(1, "a.md", "[[b]] and [x](c.md)", None, "indexed"), (1, "sub/b.md", "text", '{"related": "a"}', "indexed"), (1, "gone.md", "[[a]]", None, "deleted")], "collection_id bigint, rel_path string, markdown_text string, frontmatter_json string, status string")
    names = spark.createDataFrame([(1, "main")], "id bigint, name string")
    fields = "collection_name string, source_rel_path string, target_identifier string, edge_type string, anchor_text string, source_kind string, confidence double, stale boolean"
    stored = spark.createDataFrame([("main", "a.md", "old", "links_to", "", "wikilink", 1.0, False), ("main", "gone.md", "a", "links_to", "", "wikilink", 1.0, False), ("main", "a.md", "b", "links_to", "", "wikilink", 0.5, True)], fields)
    got = {(r["source_rel_path"], r["target_identifier"], r["edge_type"]): r["stale"] for r in graph.refresh(stored, notes, names).collect()}
    assert got == {("a.md", "b", "links_to"): False, ("a.md", "sub/b", "wikilink_basename"): False, ("a.md", "c", "links_to"): False, ("a.md", "old", "links_to"): True, ("sub/b.md", "a", "related"): False}


def test_command_line_runs(spark, tree, tmp_path, capsys):
    import json

    from notarium import cli

    store = "file://" + str(tmp_path / "store")
    assert cli.main([store, "init"]) == 0 and set(json.loads(capsys.readouterr().out)) == set(indexing.TABLES)
    assert cli.main([store, "index", "collection_id=1", f"root={tree}"]) == 0 and json.loads(capsys.readouterr().out)["indexed"] == 3
    assert cli.main([store, "embed"]) == 0 and json.loads(capsys.readouterr().out)["embedded"] >= 3
    assert cli.main([store, "operations"]) == 0 and len(json.loads(capsys.readouterr().out)) == len(OPERATIONS)


# --- small parts ----------------------------------------------------------------------------------


def test_json_is_safe_at_any_depth(spark):
    from notarium.functions import text as T

    row = spark.range(1).select(F.struct(F.lit("a\x00b").alias("x"), F.array(F.struct(F.lit("\\\\u0000").alias("y"), F.lit("\x00").alias("z"))).alias("l")).alias("v"))
    import json

    got = json.loads(row.select(T.json_safe(F.col("v"))).first()[0])
    assert got == {"x": "a\ufffdb", "l": [{"y": "\\\\u0000", "z": "\ufffd"}]}


def test_a_token_budget_waits():
    from notarium.operators.knowledge import TokenBudget

    now = {"t": 0.0}
    budget = TokenBudget(100, lambda: now["t"], lambda s: now.update(t=now["t"] + s))
    for n in (60, 40, 10, 500, 1):
        budget.take(n)
    assert now["t"] == 180.0


def test_documents_are_summarised(spark):
    from notarium.operators import knowledge

    rows = [(1, 5, "segment_summary", "t", "one", [1], 4, 9, 0.5), (2, 5, "segment_summary", "t", "two", [2], 1, 3, 0.5), (3, 6, "concept", "t", "x", [3], 1, 1, 0.5), (4, 7, "segment_summary", "t", "", [4], 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "id bigint, document_id bigint, object_type string, title string, body_text string, source_chunk_ids array<bigint>, line_start int, line_end int, confidence double")
    got = knowledge.summarise_documents(df, lambda: str.upper).collect()
    assert [tuple(r) for r in got] == [(5, "document_summary", "TWO\nONE", 1, 9)]


def test_chunks_by_a_public_vocabulary(spark):
    import os

    from notarium.functions.vocabulary import ranks_of, token_counter
    from notarium.operators.chunking import chunk_notes

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabularies here")
    counter = token_counter(ranks_of(path))
    text = "# H\n\n" + " ".join(f"Sentence number {i} about zusammengesetzte words." for i in range(200))
    rows = chunk_notes(spark.createDataFrame([(1, text), (2, None)], "id bigint, markdown_text string"), counter=counter).collect()
    count = counter()
    assert len(rows) > 5 and all(r["token_count"] == count(r["text_content"]) <= 340 for r in rows)


def test_a_store_is_made_and_reset(spark, indexer):
    assert set(indexer.init()) == set(indexing.TABLES) and indexer.init() == []
    indexer.store.write("vq_vectors", spark.createDataFrame([("p", [1.0], {})], indexing.TABLES["vq_vectors"]))
    indexer.init(reset=True)
    assert indexer.table("vq_vectors").count() == 0
