"""Full-text search: an inverted index, and title and keyword lanes for a batch of queries.

A lane scores all queries at once. Queries with the same terms are scored once. The title lane joins query terms with its index;
the lanes over texts lay the index out in blocks of records, in each of which the posting lists are arrays and every query
keeps its best rows, so pairs of queries and records never move. Only records with all of a query's terms match (in
bm25_lane: with any). The lanes return (query_id, record_id, score, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import simple_tokens
from notarium.runtime import BROADCAST_ROWS, materialize, semi_join_checked, spread


def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, record_id, tf): term frequencies of every record."""
    return (
        df.select(F.col(id_col).alias("record_id"), F.explode(simple_tokens(F.col(text_col))).alias("term"))
        .groupBy("term", "record_id")
        .agg(F.count("*").alias("tf"))
    )


def query_index(df: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> DataFrame:
    """(term, record_id, tf, length): the part of the inverted index that the queries touch, with each record's length.

    Tokens that no query asks for are dropped before any shuffle: the queries' terms are counted and broadcast up to a bound,
    beyond it both sides shuffle. The result is written once, as several lanes read it. Rows that were delivered twice (equal ids) count once: their counts are divided by the
    number of copies, which takes a shuffle of ids instead of texts.
    """
    asked = materialize(query_terms(queries).select("term").distinct(), "terms")
    counted = semi_join_checked(_tokens(df, id_col, text_col), asked, ["term"]).groupBy("term", "record_id", "length").agg(F.count("*").alias("n"))
    return materialize(_once(counted, df, id_col), "index")


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, length, term): a row per token."""
    own = simple_tokens(F.col(text_col))
    return spread(df.select(id_col, text_col)).select(F.col(id_col).alias("record_id"), own.alias("own")).select(
        "record_id", F.size("own").alias("length"), F.explode("own").alias("term")
    )


def _once(counted: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """counted (term, record_id, length, n) with n divided by the copies of the record, as tf."""
    copies = materialize(df.groupBy(F.col(id_col).alias("record_id")).agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    each = F.coalesce("copies", F.lit(1))
    return counted.join(copies, "record_id", "left").select("term", "record_id", "length", (F.col("n") / each).cast("bigint").alias("tf"))


def lengths(df: DataFrame, id_col: str, text_col: str) -> tuple[int, float]:
    """Number of records with tokens, and their mean length; equal ids count once."""
    sizes = spread(df.select(id_col, text_col)).select(id_col, F.size(simple_tokens(F.col(text_col))).alias("n")).where("n > 0").distinct()
    row = sizes.agg(F.count("*").alias("records"), F.avg("n").alias("mean")).first()
    return row["records"], row["mean"] or 1.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, terms): distinct terms of each query and their number; blank queries have none."""
    own = queries.select("query_id", F.array_distinct(simple_tokens(F.col("query_text"))).alias("own"))
    return own.select("query_id", F.explode("own").alias("term"), F.size("own").alias("terms"))


def best(scored: DataFrame, limit: int, tie: str = "record_id") -> DataFrame:
    """The `limit` best rows per query with their rank, by score, then tie."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, df): records per term."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


#: Index rows of a block of records, and query terms of a part of the queries; each block meets each part in a task of its own.
BLOCK, PART = 1 << 19, 1 << 20
#: Index rows from which a block is worth a task of its own.
LEAST_BLOCK = 50_000


def term_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, set_id) and (set_id, term, terms): queries with the same terms share a set.

    sets has query_id and own, the sorted distinct terms of the query; those without terms have no set.
    """
    shared = F.min("query_id").over(Window.partitionBy("own"))
    held = materialize(sets.where(F.size("own") > 0).withColumn("set_id", shared), "sets")
    each = held.where("query_id = set_id").select("set_id", F.explode("own").alias("term"), F.size("own").alias("terms"))
    return held.select("query_id", "set_id"), each


def _query_sets(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return term_sets(queries.select("query_id", F.array_sort(F.array_distinct(simple_tokens(F.col("query_text")))).alias("own")))


class _Postings:
    """The index rows of a block, in the order of their terms and records; a record's place is its rank among the block's ids."""

    def __init__(self, rows: pa.Table, terms: pa.Table) -> None:
        words = rows["term"].combine_chunks().dictionary_encode()
        self.ids, places = np.unique(rows["record_id"].to_numpy(), return_inverse=True)
        codes = words.indices.to_numpy().astype(np.int64)
        self.order = np.argsort(codes * max(len(self.ids), 1) + places, kind="stable")
        self.codes, self.places = codes[self.order], places[self.order]
        self.starts = np.searchsorted(self.codes, np.arange(len(words.dictionary) + 1))
        self.sizes = np.diff(self.starts)
        #: the code of each query term in this block, -1 where no record has it
        self.asked = pc.fill_null(pc.index_in(terms["term"].combine_chunks(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)

    def column(self, rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].to_numpy()[self.order].astype(np.float64)

    def at(self, code: int) -> slice:
        return slice(self.starts[code], self.starts[code + 1])

    def found(self, code: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places a term's list holds, and at which rows."""
        own = self.places[self.at(code)]
        i = np.minimum(np.searchsorted(own, places), len(own) - 1)
        return own[i] == places, i + self.starts[code]


def _first(places: np.ndarray, scores: np.ndarray, limit: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The `limit` best by rounded score, then place."""
    if len(scores) > limit:
        least = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        near = np.flatnonzero(scores >= least - 10.0**-digits)
        places, scores = places[near], scores[near]
    scores = np.floor(scores * 10.0**digits + 0.5) / 10.0**digits
    top = np.lexsort((places, -scores))[:limit]
    return places[top], scores[top]


def _of_sets(sets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each set with its rows; rows of a set are neighbours."""
    edges = np.flatnonzero(sets[1:] != sets[:-1]) + 1
    for a, b in zip([0, *edges], [*edges, len(sets)]):
        yield a, slice(a, b)


def _in_blocks(asked: DataFrame, index: DataFrame, score: Callable[[pa.Table, pa.Table], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(set_id, record_id, score): the best rows of every set in every block of records.

    score gets the sorted query terms and the index rows of a block and gives a row number of the former with the best ids and scores of its set.
    """
    asked = materialize(asked, "asked")
    rows, slots = index.count(), index.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // BLOCK), min(slots, rows // LEAST_BLOCK))
    parts = max(1, -(-asked.count() // PART))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "set_id"), (index, "record_id"))}
    spans = {n: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")) for n, k in (("block", blocks), ("part", parts))}
    ours = asked.withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(parts))).withColumn("block", spans["block"])
    theirs = index.withColumn("block", F.pmod(F.xxhash64("record_id"), F.lit(blocks))).withColumn("part", spans["part"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = []
        if len(left) and len(right):
            left = left.sort_by([("set_id", "ascending"), ("term", "ascending")])
            best = [x for x in score(left, right) if len(x[1])]
        sizes = [len(ids) for _, ids, _ in best]
        sets = left["set_id"].take(pa.array(np.repeat(np.array([a for a, _, _ in best], np.int64), sizes)))
        ids = pa.array(np.concatenate([x for _, x, _ in best]), right.schema.field("record_id").type) if best else pa.array([], right.schema.field("record_id").type)
        scores = pa.array(np.concatenate([x for _, _, x in best]) if best else np.zeros(0), pa.float64())
        return pa.table({"set_id": sets, "record_id": ids, "score": scores})

    fields = f"set_id {kinds['set_id']}, record_id {kinds['record_id']}, score double"
    return ours.groupBy("part", "block").cogroup(theirs.groupBy("part", "block")).applyInArrow(run, fields)


def _best_of_queries(scored: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    ranked = best(scored.withColumnRenamed("set_id", "query_id"), limit).withColumnRenamed("query_id", "set_id")
    return members.join(ranked, "set_id").select("query_id", "record_id", "score", "rank")


def all_terms(sets: tuple[DataFrame, DataFrame], index: DataFrame, limit: int) -> DataFrame:
    """Records holding all terms of a query, scored by the sum of tf / (tf + 1); sets from term_sets, index has term, record_id, tf.

    In a block a query starts from its rarest term: only the records of that one are looked up for the others.
    """
    members, asked = sets

    def score(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = _Postings(right, left)
        tf = held.column(right, "tf")
        values = tf / (tf + 1)
        for a, own in _of_sets(left["set_id"].to_numpy()):
            codes = held.asked[own]
            if codes.min() < 0:
                continue
            rare, *others = codes[np.argsort(held.sizes[codes], kind="stable")]
            places, scores = held.places[held.at(rare)], values[held.at(rare)]
            for code in others:
                there, rows = held.found(code, places)
                places, scores = places[there], scores[there] + values[rows[there]]
            places, scores = _first(places, scores, limit, 9)
            yield a, held.ids[places], scores

    return _best_of_queries(_in_blocks(asked, index.select("term", "record_id", "tf"), score), members, limit)


def keyword_lane(queries: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """Records holding all terms of a query, scored by the sum of tf / (tf + 1); index from query_index."""
    return all_terms(_query_sets(queries), index, limit)


def stemmed_lane(queries: DataFrame, df: DataFrame, id_col: str, text_col: str, stem: Callable[[str], Column], limit: int) -> DataFrame:
    """Keyword lane over stems: records that hold words of all stems of a query.

    stem gives the stem of a column of words, null for words that count for nothing. Words are stemmed once each; only those whose stem a
    query has are counted in the texts.
    """
    terms = query_terms(queries)
    stems = terms.select("term").distinct().withColumn("stem", stem("term")).where("stem IS NOT NULL")
    own = materialize(terms.join(stems, "term").groupBy("query_id").agg(F.array_sort(F.collect_set("stem")).alias("own")), "stems")
    sets = term_sets(own)
    tokens = _tokens(df, id_col, text_col)
    words = materialize(tokens.select("term").distinct(), "words").withColumn("stem", stem("term"))
    wanted = materialize(words.join(own.select(F.explode("own").alias("stem")).distinct(), "stem", "left_semi").select("term", "stem"), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = tokens.join(F.broadcast(wanted) if few else wanted, "term").select("record_id", "length", F.col("stem").alias("term"))
    counted = held.groupBy("term", "record_id", "length").agg(F.count("*").alias("n"))
    return all_terms(sets, materialize(_once(counted, df, id_col), "index"), limit)


#: Length of the pieces by which words inside longer words are found.
GRAM = 3


def words_within(terms: DataFrame, needles: DataFrame) -> DataFrame:
    """(word, term): distinct terms that hold each word as a part of theirs, over pieces of GRAM characters.

    terms has term, needles has word. Both are vocabularies, not texts. A word shorter than GRAM is looked up as a piece itself.
    """
    sizes = F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("term")))
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring(F.col("term"), i, n))))
    held = terms.where("term <> ''").distinct().select("term", F.explode(F.array_distinct(pieces)).alias("piece"))
    wanted = needles.where("word <> ''").distinct().withColumn("piece", F.substring("word", 1, GRAM))
    return wanted.join(held, "piece").where(F.contains("term", F.col("word"))).select("word", "term")


def title_lane(queries: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """Titles or paths that hold all terms of a query, or the whole query as it stands, also inside longer words.

    The score is 1 for each title term and 0.4 for each path term if all terms are there, plus 2 for an equal title, 1 for one that
    contains the query, 0.5 for such a path. titles has record_id, title, rel_path. What contains the query is searched by its
    longest word: only titles with a word that holds it are compared. A query without letters and digits finds nothing.
    """
    parts = titles.select("record_id", F.col("title").alias("text"), F.lit(1.0).alias("weight")).unionByName(
        titles.select("record_id", F.regexp_replace("rel_path", r"\.md$", "").alias("text"), F.lit(0.4).alias("weight"))
    )
    index = materialize(
        parts.select("record_id", "weight", F.explode(F.array_distinct(simple_tokens(F.col("text")))).alias("term"))
        .groupBy("term", "record_id")
        .agg(F.sum("weight").alias("weight")),
        "titles",
    )
    found = (
        query_terms(queries)
        .join(index, "term")
        .groupBy("query_id", "record_id")
        .agg(F.count("*").alias("found"), F.first("terms").alias("terms"), F.sum("weight").alias("base"))
        .where(F.col("found") == F.col("terms"))
        .select("query_id", "record_id", "base")
    )
    needle = queries.select("query_id", F.lower(F.trim("query_text")).alias("needle"))
    own = F.transform(F.array_distinct(simple_tokens(F.col("needle"))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    longest = materialize(needle.select("query_id", F.array_max(own)["w"].alias("word")).where("word IS NOT NULL"), "needles")
    within = words_within(index.select("term"), longest.select("word"))
    inside = longest.join(within, "word").join(index.select("term", "record_id"), "term").select("query_id", "record_id").distinct()
    both = inside.join(found, ["query_id", "record_id"], "full").join(needle, "query_id").join(titles, "record_id")
    title, path = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("rel_path", F.lit("")))
    in_title, in_path = F.contains(title, F.col("needle")), F.contains(path, F.col("needle"))
    score = (
        F.coalesce("base", F.lit(0.0))
        + F.when(title == F.col("needle"), 2.0).otherwise(0.0)
        + F.when(in_title, 1.0).otherwise(0.0)
        + F.when(in_path, 0.5).otherwise(0.0)
    )
    return best(both.where(F.col("base").isNotNull() | in_title | in_path).select("query_id", "record_id", F.round(score, 9).alias("score")), limit)


#: Share of a block's records from which a term is frequent for bm25_lane.
FREQUENT = 0.1


def bm25_lane(
    queries: DataFrame, index: DataFrame, totals: tuple[int, float], limit: int, k1: float = 1.2, b: float = 0.75, frequent: float = FREQUENT
) -> DataFrame:
    """Records holding any term of a query, by BM25; index from query_index, totals from lengths (over the whole table).

    In a block of records the parts of a query's terms are summed in an array over its records. Frequent terms are looked up
    late: where a query's `limit`-th best score over its other terms alone is above the sum of what the frequent ones add at most, no
    record without one of the other terms can be among the best of the block, and of the rest only records within that sum of
    that score are completed. Queries that cannot be settled so are summed over all their terms. The result is exact either way.
    """
    records, mean = totals
    members, asked = _query_sets(queries)
    df = F.col("df")
    weighed = asked.join(_frequencies(index), "term").select("set_id", "term", F.log(1 + (records - df + 0.5) / (df + 0.5)).alias("idf"))

    def score(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = _Postings(right, left)
        idf = np.zeros(len(held.sizes))
        known = held.asked >= 0
        idf[held.asked[known]] = left["idf"].to_numpy()[known]
        tf, length = held.column(right, "tf"), held.column(right, "length")
        parts = idf[held.codes] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        most = np.maximum.reduceat(parts, held.starts[:-1])
        # a list's limit-th best part is a bound of the limit-th best score of any query that has the term
        bound = np.zeros(len(held.sizes))
        for code in np.flatnonzero(held.sizes >= limit):
            bound[code] = np.partition(parts[held.at(code)], held.sizes[code] - limit)[held.sizes[code] - limit]
        sums = np.zeros(len(held.ids))

        def add(codes: np.ndarray) -> None:
            for code in codes:
                sums[held.places[held.at(code)]] += parts[held.at(code)]

        for a, own in _of_sets(left["set_id"].to_numpy()):
            codes = held.asked[own]
            codes = codes[codes >= 0]
            if not len(codes):
                continue
            if len(codes) == 1:
                places, scores = _first(held.places[held.at(codes[0])], parts[held.at(codes[0])], limit, 6)
                yield a, held.ids[places], scores
                continue
            late = held.sizes[codes] > frequent * len(held.ids)
            sums[:] = 0.0
            add(codes[~late])
            places = None
            if late.any() and not late.all():
                more = most[codes[late]].sum()
                places = np.flatnonzero(sums > 0)
                least = np.partition(sums[places], len(places) - limit)[len(places) - limit] if len(places) >= limit else 0.0
                # scores are rounded at the end, so the bounds keep clear of that
                if least > more + 1e-5:
                    places = places[sums[places] + more + 1e-5 >= least]
                    scores = sums[places]
                    for code in codes[late]:
                        there, rows = held.found(code, places)
                        scores[there] += parts[rows[there]]
                else:
                    places = None
            if places is None:
                add(codes[late])
                least = bound[codes].max()
                places = np.flatnonzero(sums >= least - 1e-5 if least > 1e-5 else sums > 0)
                scores = sums[places]
            places, scores = _first(places, scores, limit, 6)
            yield a, held.ids[places], scores

    return _best_of_queries(_in_blocks(weighed, index, score), members, limit)
