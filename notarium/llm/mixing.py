"""Mixing sources to target shares of the total size, in tokens of a public tokenizer.

Texts (equal ones count as one, whatever their number of records) are summed per cell of source, language and topic. The cell
totals, a table of bounded size, are raked by iterative proportional fitting: weights are scaled in turn until the sources
have their target shares and language and topic keep, within what is selected, the shares that they have among the sources'
texts. A cell's weight is the mean number of times one of its texts is to be used, at most max_repeats of its source.

Languages are those of the data: every value of lang (trimmed, lower case) with at least LEAST_LANGUAGE of the usable tokens
is one, all others are 'other', so there are at most 1 / LEAST_LANGUAGE. Topics come from the texts: the distinct words of a
text are hashed into DIMENSIONS signed counts, from which the mean of the text's language over all usable texts is taken,
and the nearest of TOPICS directions is its topic. The directions are fitted on all usable texts, a pass for each first
direction and for each round, in whole multiples of 1 / UNIT: all sums are exact, so the order of the rows changes nothing.

Whole repeats are given to every text of a cell. The remaining fraction is sampled with its calibrated probability by
sequential Poisson sampling: texts are ordered by a permanent random number divided by their probability and taken until the
source's tokens reach the target, so the share is met to within one text. The running sum is cut into ranges of that order,
so a source with any share of the rows is summed by many tasks.

Sources without a target, and null ones, get no records; targets without texts are reported with share 0, and the other
targets are scaled to make up for them. Null and empty texts have no tokens and are not used. Of equal texts the smallest
doc_id stands for all, so no text is used more than max_repeats times; null ids come last. Equal inputs give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notarium.llm.near_duplicates import _slices, word_hashes
from notarium.llm.tokenizer import PATTERN, TOKENIZER_DIR, read_ranks
from notarium.llm.truncation import _hashed
from notarium.runtime import materialize, spread

#: Share of the usable tokens from which a language is raked on its own.
LEAST_LANGUAGE = 0.005
#: Topics, dimensions of the hashed words, and steps of a direction's length (exact sums of up to 2 ** 33 texts a task).
TOPICS, DIMENSIONS, UNIT = 8, 64, 2.0**20
RANGES, PART = 1024, 1024
ROUNDS, TOLERANCE = 500, 1e-9


def word_counts(batch: pa.RecordBatch) -> np.ndarray:
    """Signed counts of the distinct words of each text over DIMENSIONS, as bytes."""
    hashes, counts = word_hashes(batch["text"])
    at = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, at))
    at, hashes = at[order], hashes[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    at, hashes = at[first], hashes[first]
    place = at * DIMENSIONS + (hashes % np.uint64(DIMENSIONS)).astype(np.int64)
    sign = np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    sums = np.bincount(place, sign, minlength=len(counts) * DIMENSIONS).reshape(len(counts), DIMENSIONS)
    return np.clip(sums, -127, 127).astype(np.int8)


def _token_counter(ranks: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # the pattern's (?U) flag is Java's; this library knows Unicode classes anyway
        coder = tiktoken.Encoding(name="own", pat_str=PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
        for whole in batches:
            for batch in _slices(whole, "text"):
                sizes = [len(coder.encode_ordinary(t)) for t in batch["text"].to_pylist()]
                vectors = pa.array([v.tobytes() for v in word_counts(batch)], pa.binary())
                columns = [batch[c] for c in ("doc_id", "source", "lang", "k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, vectors, pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "k1", "k2", "vector", "tokens"]
                )

    return count


def _centred(vectors: np.ndarray, means: np.ndarray) -> np.ndarray:
    rows = vectors - means
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose rows of doubles stay in a core's cache."""
    for batch in batches:
        for begin in range(0, batch.num_rows, PART):
            yield batch.slice(begin, PART)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch["vector"].cast(pa.binary())
    if not len(column):
        return np.zeros((0, DIMENSIONS), np.int8)
    _, offsets, data = column.buffers()
    begin, end = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.int8)[begin:end].reshape(-1, DIMENSIONS)


def _unit_rows(batch: pa.RecordBatch, means: dict[str, np.ndarray]) -> np.ndarray:
    """The texts' vectors without the mean of their language, of length UNIT and rounded, so that products and sums are exact.

    A text that is its language's mean, as one that is alone in it, has no direction there; the mean of all, under '', is taken off.
    """
    langs, vectors = batch["lang"].dictionary_encode(), _vectors(batch)
    if not len(vectors):
        return np.zeros((0, DIMENSIONS))
    rows = vectors - np.stack([means[x] for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
    alone = ~rows.any(axis=1)
    rows[alone] = vectors[alone] - means[""]
    size = np.sqrt((rows * rows).sum(axis=1))
    rows *= (UNIT / np.where(size == 0, 1.0, size))[:, None]
    return np.rint(rows, out=rows)


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, sums): one row per language and task."""
    sums: dict[str, np.ndarray] = {}
    counts: dict[str, int] = {}
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        which, vectors = langs.indices.to_numpy(), _vectors(batch)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            rows = vectors[which == i]
            sums[lang] = sums.get(lang, 0) + rows.sum(axis=0, dtype=np.int64)
            counts[lang] = counts.get(lang, 0) + len(rows)
    columns = [pa.array(list(sums), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "sums"])


def _farthest(means: dict[str, np.ndarray], centres: np.ndarray):
    """(near, k1, k2, row): a task's text that is least like its nearest centre, of equal ones that with the least key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in _parts(batches):
            rows = _unit_rows(batch, means)
            near = (rows @ centres.T).max(axis=1, initial=-np.inf)
            some = np.flatnonzero(rows.any(axis=1))
            if len(some):
                k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
                least = some[near[some] == near[some].min()]
                at = least[np.lexsort((k2[least], k1[least]))[0]]
                best = [min([*best, (float(near[at]), int(k1[at]), int(k2[at]), rows[at].tolist())])]
        kinds = (pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in best], kind) for i, kind in enumerate(kinds)], names=["near", "k1", "k2", "row"])

    return find


def _centre_sums(means: dict[str, np.ndarray], centres: np.ndarray):
    """(topic, sums): the sums of a task's rows by their nearest centre."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape)
        for batch in _parts(batches):
            rows = _unit_rows(batch, means)
            own = np.argmax(rows @ centres.T, axis=1)
            sums += (own == np.arange(len(centres))[:, None]).astype(float) @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["topic", "sums"])

    return add


def directions(texts: DataFrame, means: dict[str, np.ndarray], k: int = TOPICS, rounds: int = 30) -> np.ndarray:
    """k vectors of length UNIT that all texts (lang, vector, k1, k2) group around (spherical k-means, first ones spread apart, no chance).

    Every pass brings at most k rows per task to the driver.
    """
    centres = np.zeros((0, DIMENSIONS))
    keyed = texts.select("lang", "vector", "k1", "k2")
    while len(centres) < k:
        found = keyed.mapInArrow(_farthest(means, centres), "near double, k1 bigint, k2 bigint, row array<double>").collect()
        row = np.array(min(found)["row"]) if found else None
        if row is None or (centres == row).all(axis=1).any():
            break
        centres = np.vstack([centres, row])
    if not len(centres):
        return np.zeros((1, DIMENSIONS))
    slim = texts.select("lang", "vector")
    for _ in range(rounds):
        before, sums = centres, np.zeros(centres.shape, np.int64)
        for r in slim.mapInArrow(_centre_sums(means, centres), "topic int, sums array<double>").collect():
            sums[r["topic"]] += np.array(r["sums"]).astype(np.int64)
        moved = np.rint(_centred(sums.astype(float), np.zeros(DIMENSIONS)) * UNIT)
        centres = np.where(sums.any(axis=1, keepdims=True), moved, before)
        if (centres == before).all():
            break
    return centres


def _topics(means: dict[str, np.ndarray], centres: np.ndarray, names: list[str]):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics = np.argmax(_unit_rows(batch, means) @ centres.T, axis=1)
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f"topic-{t}" for t in topics], pa.string())], names=[*names, "topic"])

    return name


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, tuple[float, float]]) -> dict[tuple[str, str, str], float]:
    """Weight per cell (source, language, topic, tokens), given (target share, max repeats) per source.

    The total is the largest at which no source needs more than max_repeats of all its tokens.
    """
    cells = [c for c in cells if c[0] in targets and c[3] > 0 and targets[c[0]][0] > 0 and targets[c[0]][1] > 0]
    if not cells:
        return {}
    tokens = np.array([c[3] for c in cells])
    caps = np.array([targets[c[0]][1] for c in cells])
    groups = []
    for position in range(3):
        names = sorted({c[position] for c in cells})
        groups.append((names, np.array([names.index(c[position]) for c in cells])))
    names, which = groups[0]
    size = np.bincount(which, tokens)
    share = np.array([targets[n][0] for n in names])
    share = share / share.sum()
    total = min(size * np.array([targets[n][1] for n in names]) / share)
    wanted = [share * total]
    for _, member in groups[1:]:
        own = np.bincount(member, tokens)
        wanted.append(own / own.sum() * total)
    weight = np.ones(len(cells))
    for _ in range(ROUNDS):
        before = weight.copy()
        for (_, member), want in list(zip(groups, wanted))[::-1]:
            have = np.bincount(member, weight * tokens, minlength=len(want))
            weight = np.minimum(weight * (want / np.maximum(have, 1e-300))[member], caps)
        if np.max(np.abs(weight - before) / np.maximum(before, 1e-300)) < TOLERANCE:
            break
    # caps may have kept a source below its target: its other cells make up for it, as the source's share comes first
    for i, want in enumerate(wanted[0]):
        own = which == i
        for _ in range(100):
            missing = want - (weight[own] * tokens[own]).sum()
            free = own & (weight < caps - 1e-12)
            if missing <= 1e-6 * want or not free.any():
                break
            weight[free] = np.minimum(weight[free] * (1 + missing / (weight[free] * tokens[free]).sum()), caps[free])
    return {(a, b, c): float(w) for (a, b, c, _), w in zip(cells, weight)}


def sized_texts(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, lang, tokens, k1, k2, vector) of all texts that are not empty, one row per record."""
    id_type = dict(df.dtypes)["doc_id"]
    base = df.where(F.length("text") > 0).select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    kinds = f"doc_id {id_type}, source string, lang string, text string, k1 bigint, k2 bigint"
    counted = spread(base).mapInArrow(_hashed, kinds).mapInArrow(
        _token_counter(read_ranks(name, folder)), f"doc_id {id_type}, source string, lang string, k1 bigint, k2 bigint, vector binary, tokens bigint"
    )
    return materialize(counted, "sizes")


def with_topics(texts: DataFrame, least: float = LEAST_LANGUAGE, topics: int = TOPICS) -> DataFrame:
    """texts (a materialized table, which is read once a pass) with lang narrowed to the frequent languages and topic instead of vector."""
    sizes = texts.groupBy("lang").agg(F.sum("tokens").alias("tokens"))
    whole = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    frequent = [r["lang"] for r in sizes.where((F.col("tokens") >= least * whole) & (F.col("lang") != "")).collect()]  # at most 1 / least rows
    known = texts.withColumn("lang", F.when(F.col("lang").isin(frequent), F.col("lang")).otherwise("other") if frequent else F.lit("other"))
    summed = known.select("lang", "vector").mapInArrow(_language_sums, "lang string, n bigint, sums array<bigint>")
    summed = summed.groupBy("lang").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(DIMENSIONS)])
    sums = {r["lang"]: np.array(r[1:], np.int64) for r in summed.collect()}  # at most 1 / least rows and 'other'; '' is no language there
    sums[""] = sum(sums.values(), np.zeros(DIMENSIONS + 1, np.int64))
    means = {lang: row[1:] / max(row[0], 1) for lang, row in sums.items()}
    centres = directions(known, means, topics)
    names = [c for c in known.columns if c != "vector"]
    fields = ", ".join(f"{c} {dict(known.dtypes)[c]}" for c in names)
    return known.mapInArrow(_topics(means, centres, names), f"{fields}, topic string")


def select_texts(df: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """(selected, usable): the selected texts (doc_id, source, lang, topic, tokens, repeats), and (source, lang, topic, tokens) of all usable ones."""
    spark = df.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    texts = sized_texts(df, name, folder)
    # one record stands for all with the same text: the first with a target
    known = texts.join(wanted.select("source"), "source", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", "lang", "tokens", "vector"))
    single = known.groupBy("k1", "k2").agg(first.alias("r")).select("k1", "k2", "r.doc_id", "r.source", "r.lang", "r.tokens", "r.vector")
    one = materialize(with_topics(materialize(single, "single")), "texts")
    # at most (number of targets) x (languages) x (topics) rows
    cells = [tuple(r) for r in one.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double")).collect()]
    shares = {r["source"]: (float(r["target_share"] or 0), float(r["max_repeats"] or 0)) for r in wanted.collect()}
    weights = rake(cells, shares)
    rows = [(*cell, w) for cell, w in weights.items()]
    raked = spark.createDataFrame(rows, "source string, lang string, topic string, weight double")
    goal: dict[str, float] = {}
    for source, lang, topic, size in cells:
        goal[source] = goal.get(source, 0.0) + weights.get((source, lang, topic), 0.0) * size
    floors = {}
    for source, lang, topic, size in cells:
        floors[source] = floors.get(source, 0.0) + float(np.floor(weights.get((source, lang, topic), 0.0) + 1e-9)) * size
    rest = spark.createDataFrame([(s, goal[s] - floors[s]) for s in goal] or [], "source string, rest double")

    weighed = one.join(F.broadcast(raked), ["source", "lang", "topic"])
    whole = F.floor(F.col("weight") + 1e-9)
    draw = (F.pmod(F.xxhash64("k1", "k2"), F.lit(2**40)) + 1) / float(2**40)
    drawn = weighed.select(
        "doc_id", "source", "lang", "topic", "tokens", "k1", "k2", whole.cast("int").alias("whole"), (F.col("weight") - whole).alias("chance"), draw.alias("draw")
    ).withColumn("order", F.when(F.col("chance") > 1e-9, F.col("draw") / F.col("chance")))
    # running tokens in this order, by ranges of the order: chances are met around order 1
    ranged = drawn.where(F.col("order").isNotNull()).withColumn("range", F.least(F.floor(F.col("order") * (RANGES // 2)), F.lit(RANGES - 1)))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("order", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        ranged.withColumn("upto", F.sum("tokens").over(inside))
        .join(offsets, ["source", "range"])
        .join(F.broadcast(rest), "source")
        .withColumn("extra", (F.col("offset") + F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
        .select("doc_id", "source", "lang", "topic", "tokens", "whole", "extra")
    )
    fixed = drawn.where(F.col("order").isNull()).select("doc_id", "source", "lang", "topic", "tokens", "whole", F.lit(0).alias("extra"))
    repeats = (F.col("whole") + F.col("extra")).alias("repeats")
    selected = running.unionByName(fixed).select("doc_id", "source", "lang", "topic", "tokens", repeats).where("repeats > 0")
    return selected, one.select("source", "lang", "topic", "tokens")


def mix(df: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens, repeats): the selected texts and how often each is used."""
    return select_texts(df, targets, name, folder)[0].select("doc_id", "source", "tokens", "repeats")


def marginals(df: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(margin, value, wanted_share, actual_share): the shares that were raked for and those that were reached, of languages and topics.

    A language's or topic's wanted share is its share among the usable texts.
    """
    selected, usable = select_texts(df, targets, name, folder)
    selected = materialize(selected.groupBy("lang", "topic").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("tokens")), "selected")
    usable = materialize(usable.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")), "usable")

    def margin(rows: DataFrame, column: str, out: str) -> DataFrame:
        sums = rows.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("tokens"))
        return sums.select("value", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))), 6).alias(out))

    parts = [
        margin(usable, c, "wanted_share").join(margin(selected, c, "actual_share"), "value", "left").select(
            F.lit(label).alias("margin"), "value", "wanted_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share")
        )
        for c, label in (("lang", "language"), ("topic", "topic"))
    ]
    return parts[0].unionByName(parts[1])


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, records, tokens, actual_share) of a selection, one row per target."""
    used = selected.groupBy("source").agg(
        F.sum("repeats").alias("records"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens")
    )
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    report = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"))
    joined = report.join(used, "source", "left").select(
        "source", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    return joined.withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("tokens"), whole), 6), F.lit(0.0)))
