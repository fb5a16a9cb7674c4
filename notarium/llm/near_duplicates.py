"""Near-duplicate texts over a whole table, by a chosen-path similarity join.

Every text becomes its set of distinct word sequences (shingles). Texts with equal sets form a class; one member stands for
it. The representatives are joined as follows.

* A shingle x is sampled by a set of n shingles where hash(x) < R / (t n), with t the threshold. Two sets of similarity t or
  more share at least R sampled shingles on average, so they share none with a chance of e^-R. The members of a bucket (a
  shingle) with at most `small` members are compared with each other.
* Texts of a larger bucket get keys of level 2: bands of two min-hashes of the whole set, as many as leave two sets of
  similarity t without a common one with the same chance e^-R at most. Texts of a larger bucket of level 2 get bands of three,
  and so on, to `depth` levels. What is still large then is compared in salted blocks, so no bucket is ever capped.
* A level hands on all members of its large buckets, so a pair is missed only if it misses at some level. The levels and the
  signature each may miss a like part of 1 - recall, and so miss no more than that together.
* Comparison inside a bucket reads set sizes and a 128-bit signature (low bits of 128 min-hashes): pairs under the number
  of equal bits that a pair at the threshold reaches are dropped. What is left is verified exactly, on all shingles.

Texts are read once for all sketches and the bands of level 2, and once more if they go deeper or are in some candidate pair.

Shuffles: sampled shingles with id and signature (about R / t rows of 40 bytes a text), the bands of texts in large buckets,
and the shingles of texts which are in some candidate pair. Texts themselves are shuffled only where more of them than can be
broadcast as ids are in large buckets or pairs.

Null, empty and short texts (fewer than min_words words) are in no pair. Null ids are left out. Of rows that occur several
times one counts. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.operators.components import connected_components
from notarium.runtime import materialize, semi_join_checked, spread

SIGNATURE_BITS = 128
#: Text characters handled at once in a Python worker.
SLICE_BYTES = 4_000_000


def _fmix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (MurmurHash3's fixed constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits of the lower-case text) and the number of words of each text."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\pL\pN]+", replacement=" ")
    lists = pc.split_pattern(pc.fill_null(pc.ascii_trim(clean, characters=" "), ""), pattern=" ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    if not len(own):
        return np.zeros(0, np.uint64), counts
    return own[coded.indices.to_numpy()], counts


def shingle_sets(texts: pa.Array, words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, ordered by both, and the number of words of each text."""
    hashes, counts = word_hashes(texts)
    place = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), counts
    mixed = np.zeros(n, np.uint64)
    for j in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    inside = (place[:n] == place[words - 1 :]) & (counts[place[:n]] >= min_words)
    at, h = place[:n][inside], _fmix(mixed[inside])
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[first], h[first], counts


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about SLICE_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(sizes):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def band_count(level: int, threshold: float, miss: float) -> int:
    """Bands of `level` min-hashes of which two sets of similarity `threshold` have none in common with a chance of at most miss."""
    same = threshold**level
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def _sketcher(words: int, min_words: int, threshold: float, runs: float, bands: tuple[tuple[int, int], ...]):
    """Sketches of texts: sizes, class keys, signature, sampled shingles, and the keys of all bands (level, count)."""
    hashes = max([SIGNATURE_BITS, *(level * count for level, count in bands)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(7)
        factors = random.integers(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1)
        offsets = random.integers(0, 2**32, hashes, dtype=np.uint32)
        for whole in batches:
            for batch in _slices(whole, "text"):
                at, h, _ = shingle_sets(batch["text"], words, min_words)
                if not len(h):
                    continue
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                own, sizes = at[starts], np.diff(np.r_[starts, len(at)])
                least = np.zeros((len(starts), hashes), np.uint32)
                low = (h >> np.uint64(11)).astype(np.uint32)
                for j in range(least.shape[1]):
                    value = low * factors[j] + offsets[j]
                    value ^= value >> np.uint32(15)
                    least[:, j] = np.minimum.reduceat(value, starts)
                packed = np.packbits((least[:, :SIGNATURE_BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
                scopes = np.asarray(batch["scope"].take(pa.array(own)).to_numpy(zero_copy_only=False), np.uint64)
                banded = []
                for level, count in bands:
                    keys = np.arange(count, dtype=np.uint64) + np.uint64(level << 32) + scopes[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    for part in range(level):
                        keys = _fmix(keys + least[:, part : level * count : level].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                    banded.append(
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(starts) + 1, dtype=np.int32) * count), pa.array(keys.reshape(-1).view(np.int64))
                        )
                    )
                # a second hash of the shingle decides on sampling; both sets of a pair see the same value
                scope = np.asarray(batch["scope"].to_numpy(zero_copy_only=False), np.uint64)[at]
                drawn = _fmix(h + np.uint64(0x51ED270B) + scope * np.uint64(0x9E3779B97F4A7C15))
                limit = np.minimum(runs / (threshold * sizes), 1.0) * (2.0**64 - 2049)
                chosen = drawn < np.repeat(limit.astype(np.uint64), sizes)
                ends = np.cumsum(np.add.reduceat(chosen.astype(np.int64), starts))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, ends].astype(np.int32)), pa.array(drawn[chosen].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["scope"].take(pa.array(own)),
                        batch["id"].take(pa.array(own)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(np.add.reduceat(h, starts).view(np.int64)),
                        pa.array(np.bitwise_xor.reduceat(_fmix(h), starts).view(np.int64)),
                        pa.array(packed[:, 0].copy()),
                        pa.array(packed[:, 1].copy()),
                        lists,
                        batch["exact"].take(pa.array(own)),
                        *banded,
                    ],
                    names=["scope", "id", "n", "k1", "k2", "s1", "s2", "tokens", "exact", *(f"keys{level}" for level, _ in bands)],
                )

    return sketch


def _full_sets(words: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                at, h, _ = shingle_sets(batch["text"], words, min_words)
                if not len(h):
                    continue
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                own = pa.array(at[starts])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[starts, len(at)].astype(np.int32)), pa.array(h.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["scope"].take(own), batch["id"].take(own), lists], names=["scope", "id", "shingles"]
                )

    return run


def least_agreeing(threshold: float, miss: float) -> int:
    """Equal bits of two signatures that a pair at the threshold falls short of with a chance of at most miss."""
    p = (1 + threshold) / 2
    under = 0.0
    for bits in range(SIGNATURE_BITS + 1):
        under += math.comb(SIGNATURE_BITS, bits) * p**bits * (1 - p) ** (SIGNATURE_BITS - bits)
        if under > miss:
            return bits
    return SIGNATURE_BITS


def _pairs_in(rows: DataFrame, threshold: float, agree: int, keys: list[str], also: str = "true") -> DataFrame:
    """Pairs of rows l and r with equal keys that pass the tests of size and signature, and `also`."""
    left, right = rows.alias("l"), rows.alias("r")
    differ = F.bit_count(F.expr("l.s1 ^ r.s1")) + F.bit_count(F.expr("l.s2 ^ r.s2"))
    on = (F.col("l.id") < F.col("r.id")) & F.expr(also)
    for key in keys:
        on = on & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    return left.join(
        right,
        on
        & (F.least("l.n", "r.n") >= threshold * F.greatest("l.n", "r.n") - 1e-9)
        & (differ <= SIGNATURE_BITS - agree),
    ).select("l.scope", F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def _in_blocks(large: DataFrame, threshold: float, agree: int, carried: list[str]) -> DataFrame:
    """All members of each path against each other, in cells of two blocks of about 512 rows, however many blocks that takes."""
    blocks = F.ceil(F.col("members") / 512).cast("int")
    block = F.pmod(F.xxhash64("scope", "id"), blocks)
    sides = large.withColumn("block", block).withColumn("blocks", blocks)
    rows = sides.withColumn(
        "cell",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y")),
            )
        ),
    ).select("path", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "block", *carried)
    apart = "l.x = l.y OR l.block <> r.block"  # rows of one block meet in its own cell only
    return _pairs_in(rows, threshold, agree, ["path", "x", "y"], apart)


def candidate_pairs(
    reps: DataFrame, banded: Callable[[DataFrame, int], DataFrame], threshold: float, agree: int, small: int = 64, depth: int = 3
) -> DataFrame:
    """Distinct pairs (scope, a, b), a < b, which meet in a bucket of some level and pass the signature.

    banded gives, for ids (scope, id) of reps and a level, their rows with the keys of that level.
    """
    carried = ["scope", "id", "n", "s1", "s2"]
    found = None
    frontier = reps.select(*carried, F.explode("tokens").alias("path"))
    for level in range(1, depth + 1):
        counts = frontier.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        shared = frontier.join(counts, "path")
        if level > 1:
            shared = materialize(shared, "paths")
        pairs = _pairs_in(shared.where(F.col("members") <= small).select("path", *carried), threshold, agree, ["path"])
        found = pairs if found is None else found.unionByName(pairs)
        large = shared.where(F.col("members") > small)
        if level == depth:
            found = found.unionByName(_in_blocks(large, threshold, agree, carried))
            break
        hot = materialize(large.select("scope", "id").distinct(), "hot")
        frontier = banded(hot, level + 1).select(*carried, F.explode("keys").alias("path"))
    return found.distinct()


def similar(
    df: DataFrame,
    scope_col: str,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    words: int = 5,
    min_words: int = 20,
    recall: float = 0.9999,
    small: int = 64,
    depth: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets and the pairs of similar representatives.

    Returns (members, pairs). members(scope, id, rep, size, exact): every text with at least min_words words, the smallest id of
    its class, the class size, and a hash of the text itself (of the least one, if an id has several). pairs(scope, a, b, similarity): representatives a < b of Jaccard similarity >= threshold.
    scope_col is a small integer that keeps several tables apart; only ids of one scope are compared.
    """
    texts = df.select(
        F.col(scope_col).cast("tinyint").alias("scope"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("exact"),
    ).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    # each level and the signature may miss a like part
    miss = (1 - recall) / (depth + 1)
    runs = math.log(1 / miss)
    id_type = texts.schema["id"].dataType.simpleString()
    fields = f"scope tinyint, id {id_type}, n int, k1 bigint, k2 bigint, s1 bigint, s2 bigint, tokens array<bigint>, exact bigint"

    def sketched(rows: DataFrame, levels: list[int]) -> DataFrame:
        bands = tuple((level, band_count(level, threshold, miss)) for level in levels)
        return spread(rows).mapInArrow(
            _sketcher(words, min_words, threshold, runs, bands), fields + "".join(f", keys{level} array<bigint>" for level in levels)
        )

    sketches = materialize(sketched(texts, [2] if depth > 1 else []).withColumn("row", F.monotonically_increasing_id()), "sketches")
    key = ["scope", "k1", "k2", "n"]
    classes = materialize(
        sketches.groupBy(*key).agg(
            F.min(F.struct("id", "exact", "s1", "s2", "tokens", "row")).alias("rep"), F.count_distinct("id").alias("size")
        ),
        "classes",
    )
    reps = classes.select("scope", "rep.id", "n", "rep.s1", "rep.s2", "rep.tokens")
    many = classes.where("size > 1").select(*key, F.col("rep.id").alias("rep"), "size")
    members = (
        classes.where("size = 1")
        .select("scope", "rep.id", F.col("rep.id").alias("rep"), "size", "rep.exact")
        .unionByName(
            sketches.groupBy(*key, "id").agg(F.min("exact").alias("exact")).join(many, key).select("scope", "id", "rep", "size", "exact")
        )
    )

    def banded(ids: DataFrame, level: int) -> DataFrame:
        columns = ["scope", "id", "n", "s1", "s2", F.col(f"keys{level}").alias("keys")]
        if level == 2:
            # the sketch that stands for a class is found by its row, so repeated rows need no shuffle of keys
            chosen = materialize(semi_join_checked(classes.select("scope", "rep.id", "rep.row"), ids, ["scope", "id"]).select("row"), "rows")
            return semi_join_checked(sketches.select(*columns, "row"), chosen, ["row"]).drop("row")
        # few texts go this deep: their bands are made when they are needed
        return sketched(semi_join_checked(texts, ids, ["scope", "id"]), [level]).select(*columns).dropDuplicates(["scope", "id"])

    agree = least_agreeing(threshold, miss)
    pairs = materialize(candidate_pairs(reps, banded, threshold, agree, small, depth), "candidates")
    needed = materialize(
        pairs.select("scope", F.explode(F.array("a", "b")).alias("id")).distinct(), "needed"
    )
    full = (
        semi_join_checked(texts, needed, ["scope", "id"])
        .mapInArrow(_full_sets(words, min_words), f"scope tinyint, id {id_type}, shingles array<bigint>")
        .dropDuplicates(["scope", "id"])
    )
    one = full.select("scope", F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = full.select("scope", F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, ["scope", "a"]).join(two, ["scope", "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    verified = both.select("scope", "a", "b", common.alias("c"), (F.size("sa") + F.size("sb") - common).alias("u"))
    exact = verified.select("scope", "a", "b", (F.col("c") / F.col("u")).alias("similarity"))
    return members, exact.where(F.col("similarity") >= threshold)


def all_pairs(members: DataFrame, pairs: DataFrame, expand: int = 1000) -> DataFrame:
    """(scope, id_a, id_b): pairs of texts, smaller id first, from members and pairs of `similar`.

    Classes are expanded in full. Only more than `expand` texts that are equal byte for byte give the pairs of the smallest id
    with each other one instead, and all their other pairs are those of that id; with `members` that is the whole result.
    """
    many = members.where(F.col("size") > expand)
    copies = many.groupBy("scope", "rep", "exact").agg(F.min("id").alias("lead"), F.count("*").alias("copies")).where(F.col("copies") > expand)
    marked = many.join(copies, ["scope", "rep", "exact"], "left")
    single = marked.where(F.col("lead").isNull() | (F.col("id") == F.col("lead")))
    small = members.where((F.col("size") > 1) & (F.col("size") <= expand)).select("scope", "rep", "id").unionByName(
        single.select("scope", "rep", "id")
    )
    within = (
        small.alias("l")
        .join(small.alias("r"), ["scope", "rep"])
        .where("l.id < r.id")
        .select("scope", F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    )
    star = marked.where(F.col("id") != F.col("lead")).select("scope", F.col("lead").alias("x"), F.col("id").alias("y"))
    left = small.select("scope", F.col("rep").alias("a"), F.col("id").alias("x"))
    right = small.select("scope", F.col("rep").alias("b"), F.col("id").alias("y"))
    across = (
        pairs.select("scope", "a", "b")
        .join(left, ["scope", "a"], "left")
        .join(right, ["scope", "b"], "left")
        .select("scope", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    union = within.unionByName(star).unionByName(across)
    return union.select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def membership(members: DataFrame) -> DataFrame:
    """(scope, id, class_id, class_size, copy_of) of every text in members: its class of equal shingle sets, named by the
    smallest id, and the smallest id of the texts that are equal to it byte for byte."""
    many = members.where("size > 1")
    copies = many.groupBy("scope", "rep", "exact").agg(F.min("id").alias("copy_of"))
    named = many.join(copies, ["scope", "rep", "exact"]).select("scope", "id", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), "copy_of")
    return named.unionByName(
        members.where("size = 1").select("scope", "id", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), F.col("id").alias("copy_of"))
    )


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scope, id, class_id, links): one row per text that is like another one.

    class_id is the smallest id of the connected component; links counts the other texts it is similar to, equal ones
    included.
    """
    members = materialize(members.where("size > 1"), "members")
    pairs = materialize(pairs, "pairs")
    edges = pairs.select(F.struct("scope", F.col("a").alias("id")).alias("a"), F.struct("scope", F.col("b").alias("id")).alias("b"))
    roots = connected_components(edges).select("node.scope", F.col("node.id").alias("rep"), F.col("component.id").alias("class_id"))
    size = members.groupBy("scope", "rep").agg(F.first("size").alias("size"))
    ends = pairs.select("scope", F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        pairs.select("scope", F.col("b").alias("rep"), F.col("a").alias("other"))
    )
    degree = (
        ends.join(size.withColumnRenamed("rep", "other"), ["scope", "other"], "left")
        .groupBy("scope", "rep")
        .agg(F.sum(F.coalesce("size", F.lit(1))).alias("linked"))
    )
    reps = (
        roots.join(size, ["scope", "rep"], "full")
        .join(degree, ["scope", "rep"], "left")
        .select(
            "scope",
            "rep",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("linked", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("links"),
        )
    )
    copies = members.select("scope", "rep", "id")
    return reps.join(copies, ["scope", "rep"], "left").select(
        "scope", F.coalesce("id", "rep").alias("id"), "class_id", "links"
    )
