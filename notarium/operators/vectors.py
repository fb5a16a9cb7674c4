"""Dense vectors: nearest neighbours by cosine, embedding batches, and an offline embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import embedding_tokens
from notarium.runtime import materialize

#: Queries up to which they travel with the tasks; beyond it, queries and vectors meet in blocks of these sizes.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 65_536


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = np.nan_to_num(rows.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def _arrays(table: pa.Table | pa.RecordBatch, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of the rows whose vector has `dim` numbers and no null."""
    own = [(k, v) for k, v in zip(table[key].to_pylist(), table["vector"].to_pylist()) if v is not None and len(v) == dim and None not in v]
    return np.array([k for k, _ in own], np.int64), _unit(np.array([v for _, v in own], float).reshape(-1, dim))


def _keep_best(best: list, names: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int, apart: bool) -> None:
    for q, name in enumerate(names):
        keep = keys != name if apart else slice(None)
        s, i = np.r_[best[q][0], scores[q][keep]], np.r_[best[q][1], keys[keep]]
        top = np.lexsort((i, -np.round(s, 9)))[:k]
        best[q] = (s[top], i[top])


def _best_rows(names: np.ndarray, best: list) -> list[pa.Array]:
    q = np.repeat(names, [len(s) for s, _ in best]) if len(names) else np.zeros(0, np.int64)
    parts = [np.concatenate([b[j] for b in best]) if best else np.zeros(0) for j in (1, 0)]
    return [pa.array(q, pa.int64()), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.float64())]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", apart: bool = True) -> DataFrame:
    """(query_id, id, score, rank): for each query vector the k most similar vectors; with apart, those of other ids only.

    queries is a stated set (query_id, vector). Up to QUERY_BLOCK of them travel with the tasks to every partition of the
    vectors; more of them are laid out in blocks, of which each meets each block of vectors in a task of its own. Either way a
    matrix product scores the rows and k per query and task are shuffled. Null vectors and those that are not of the queries'
    usual length are left out, as are queries of another length; numbers that are not finite count as 0.
    """
    filled = F.transform(F.col("vector").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))).alias("vector")
    asked = materialize(queries.where(F.col("vector").isNotNull()).select("query_id", filled), "queries")
    usual = asked.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    asked = asked.where(F.size("vector") == dim)
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    few = asked.limit(QUERY_BLOCK + 1).collect()  # a bounded number of rows
    fields = "query_id bigint, id bigint, score double"
    if not few:
        out = vectors.sparkSession.createDataFrame([], fields)
    elif len(few) <= QUERY_BLOCK:
        names = np.array([r["query_id"] for r in few], np.int64)
        matrix = _unit(np.array([r["vector"] for r in few], float))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
            for batch in batches:
                keys, rows = _arrays(batch, "id", matrix.shape[1])
                if len(keys):
                    _keep_best(best, names, keys, matrix @ rows.T, k, apart)
            yield pa.RecordBatch.from_arrays(_best_rows(names, best), names=["query_id", "id", "score"])

        out = source.mapInArrow(run, fields)
    else:
        out = _in_blocks(source, asked, dim, k, apart, fields)
    out = out.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _in_blocks(source: DataFrame, asked: DataFrame, dim: int, k: int, apart: bool, fields: str) -> DataFrame:
    """Each block of queries against each block of vectors."""
    source = materialize(source, "vectors")
    many, more = -(-max(source.count(), 1) // VECTOR_BLOCK), -(-asked.count() // QUERY_BLOCK)
    ours = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(more))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>")))
    theirs = source.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(many))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(more - 1)).cast("array<bigint>")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, matrix = _arrays(left, "query_id", dim)
        keys, rows = _arrays(right, "id", dim)
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
        if len(names) and len(keys):
            _keep_best(best, names, keys, matrix @ rows.T, k, apart)
        return pa.Table.from_arrays(_best_rows(names, best), names=["query_id", "id", "score"])

    return ours.groupBy("qb", "vb").cogroup(theirs.groupBy("qb", "vb")).applyInArrow(run, fields)


def hash_embedding(dim: int = 64):
    """Offline embedder as a pandas UDF: signed counts of words over hashed dimensions, of unit length; zeros without words."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        rows: list[list[float]] = []
        for text in texts:
            v = np.zeros(dim)
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                if word not in known:
                    code = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
                    known[word] = (code % dim, 1.0 if (code >> 16) & 1 else -1.0)
                at, sign = known[word]
                v[at] += sign
            size = float(np.linalg.norm(v))
            rows.append((v / size if size else v).tolist())
        return pd.Series(rows)

    return embed


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks that wait for a vector: a null or blank point id."""
    return chunks.where(F.coalesce(F.trim("qdrant_point_id"), F.lit("")) == "")


def split_limit(first: DataFrame, second: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Up to limit rows of both, half from each; what one lacks the other fills. Both have the same columns."""
    both = first.withColumn("kind_no", F.lit(0)).unionByName(second.withColumn("kind_no", F.lit(1)))
    # each kind can give at most limit rows, so the global order below is over 2 * limit rows
    w = Window.partitionBy("kind_no").orderBy(*order)
    ranked = both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return ranked.orderBy("n", "kind_no").limit(limit).drop("n")


def pack_batches(docs: DataFrame, max_tokens: int = 12_000, max_items: int = 32, block: int = 4096) -> DataFrame:
    """(source_key, item_no, tokens, batch_no): consecutive items of a source packed greedily into batches.

    A batch is closed when the next item would pass max_tokens or max_items; an item above max_tokens stands alone. docs has
    source_key, item_no (from 0), text. The fold runs over each source's items in order, in blocks of `block` item numbers
    that no batch crosses, so a source of any size spreads over many tasks; numbers, not texts, are gathered. batch_no
    counts from 0 in the first block and from block * k in the k-th.
    """
    sized = docs.select("source_key", "item_no", embedding_tokens(F.col("text")).alias("tokens"))
    part = F.floor(F.col("item_no") / block).alias("part")
    items = sized.groupBy("source_key", part).agg(F.array_sort(F.collect_list(F.struct("item_no", "tokens"))).alias("items"))

    def add(state, item):
        new = (state["used"] + item["tokens"] > max_tokens) | (state["count"] >= max_items)
        first = state["count"] == 0
        opened = new & ~first
        batch = F.when(opened, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(
            F.when(opened, item["tokens"]).otherwise(state["used"] + item["tokens"]).alias("used"),
            F.when(opened, 1).otherwise(state["count"] + 1).alias("count"),
            batch.alias("batch"),
            F.concat(state["out"], F.array(batch)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("count"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))
    packed = items.withColumn("numbers", F.aggregate("items", start, add, lambda s: s["out"]))
    return packed.select("source_key", "part", F.explode(F.arrays_zip("items", "numbers")).alias("z")).select(
        "source_key", "z.items.item_no", "z.items.tokens", (F.col("z.numbers") + F.col("part") * block).alias("batch_no")
    )


def _fold(rows: DataFrame, group: str, order: list[str], sizes: list[str], limits: list[int], most: int, out: str) -> DataFrame:
    """rows with the number of the batch of each row: rows of a group are packed in order until a sum of sizes would pass its
    limit or the batch has `most` rows. Rows are sorted and folded as they stream by, so a group needs a task but no memory."""
    ordered = rows.repartition(group).sortWithinPartitions(group, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, count, number = object(), [], 0, 0
        for batch in batches:
            numbers = []
            for key, *own in zip(batch[group].to_pylist(), *[batch[c].to_pylist() for c in sizes]):
                if key != last:
                    last, used, count, number = key, own, 1, 0
                elif count >= most or any(u + o > limit for u, o, limit in zip(used, own, limits)):
                    used, count, number = own, 1, number + 1
                else:
                    used, count = [u + o for u, o in zip(used, own)], count + 1
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, out])

    return ordered.mapInArrow(fold, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + f", {out} bigint")


def pack_requests(batches: DataFrame, lanes: int = 64, most: int = 4, most_items: int = 384, most_tokens: int = 40_000) -> DataFrame:
    """(lane, source_key, batch_no, request_no, items, tokens): whole batches of pack_through packed into requests.

    Sources are spread over `lanes`, which are packed on their own and can be sent side by side.
    """
    sized = batches.groupBy("source_key", "batch_no").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    laid = sized.withColumn("lane", F.abs("source_key") % lanes)
    packed = _fold(laid, "lane", ["source_key", "batch_no"], ["items", "tokens"], [most_items, most_tokens], most, "request_no")
    return packed.select("lane", "source_key", "batch_no", "request_no", "items", "tokens")


def pack_points(points: DataFrame, lanes: int = 64, most: int = 400, most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(lane, id, size, batch_no): points (id, size in bytes) packed into writes of bounded number and bytes, lane by lane."""
    laid = points.withColumn("lane", F.col("id") % lanes)
    return _fold(laid, "lane", ["id"], ["size"], [most_bytes], most, "batch_no").select("lane", "id", "size", "batch_no")


def pack_through(docs: DataFrame, max_tokens: int = 12_000, max_items: int = 32) -> DataFrame:
    """(source_key, item_no, tokens, batch_no) as of pack_batches, but through the whole source: batches cross the borders of
    blocks and batch_no counts on from 0 without a break.

    Numbers are shuffled and sorted by source and item, and folded as they stream by, so a source of any size takes one task
    but no memory.
    """
    sized = docs.select("source_key", "item_no", embedding_tokens(F.col("text")).alias("tokens"))
    return _fold(sized, "source_key", ["item_no", "tokens"], ["tokens"], [max_tokens], max_items, "batch_no")
