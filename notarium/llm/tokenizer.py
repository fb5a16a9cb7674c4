"""Encoding of a corpus with a byte-level BPE vocabulary, inside the JVM.

The text is cut into words by the vocabulary's pattern. A word that is a vocabulary entry gets its id at once. Every other
distinct word is folded exactly once for the whole corpus: a higher-order `aggregate` starts from the word's single bytes
and merges, step by step, the adjacent pair of least rank. Ranks come from a literal map that is part of the plan; it is
split into buckets by CRC-32, as a map lookup is a linear search. The vocabulary has a fixed size, so the literal does not
grow with the data.

Texts of known words only leave before any shuffle. Of the others the ids of known words are shuffled once as plain lists with
holes, and the folded words by the text they belong to. Words with a 1 / HOT share of all folded ones are at most HOT
in number and are broadcast; all others are joined by a shuffle, in which none of them is hot. Texts are never shuffled.

Null and empty texts give an empty list. Null ids are kept as a key of their own. Rows that occur several times come out as
often. Other columns of the input are ignored. Strings that look like special tokens are ordinary text. A word of n bytes
costs n steps of native array copies of length n; words above LONG bytes are cut first wherever two neighbouring bytes are
together in no token at all, which no merge can cross, so the result stays exact and the pieces short. Only a long run that
is all made of such byte pairs (one letter, say) keeps the quadratic cost; there is no limit on its length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.runtime import materialize, spread

#: Where the vocabulary files are; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: The fixed pattern that goes with the byte_bpe_50k ranks; (?U) lets \\s cover all white space, as the vocabulary's own splitter does.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 8192
#: Folded words whose share of all occurrences is at least 1 / HOT are broadcast.
HOT = 50_000
#: Bytes of a word from which it is cut where no token can lie.
LONG = 48
NO_RANK = 2**31 - 1


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one constant: an array of maps, indexed by CRC-32 of the token, a byte being one Latin-1 character."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def word_literal(ranks: dict[bytes, int]) -> Column:
    """The tokens that are whole texts, as one constant like rank_literal, keyed by the text itself."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        try:
            buckets[zlib.crc32(token) % BUCKETS][token.decode()] = rank
        except UnicodeDecodeError:
            continue  # no text has these bytes as a word
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def seam_pattern(ranks: dict[bytes, int]) -> str:
    """Pattern of the places between two bytes (as Latin-1 characters) that are neighbours in no token."""
    after: dict[int, set[int]] = {}
    for token in ranks:
        for one, two in zip(token, token[1:]):
            after.setdefault(one, set()).add(two)
    follow: dict[frozenset[int], list[int]] = {}
    for one in range(256):
        follow.setdefault(frozenset(after.get(one, ())), []).append(one)

    def chars(codes) -> str:
        return "".join(f"\\x{c:02x}" for c in sorted(codes))

    return "|".join(f"(?<=[{chars(ones)}])(?=[^{chars(twos)}])" if twos else f"(?<=[{chars(ones)}])(?=[\\x00-\\xff])" for twos, ones in follow.items())


def _rank(ranks: Column, token: Column) -> Column:
    return F.try_element_at(F.get(ranks, F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")), token)


def _with(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_word(ranks: Column, word: Column) -> Column:
    """Ids of one word, given as Latin-1 text of its bytes.

    The state holds the parts and, for every adjacent pair, the rank of its concatenation, so that a merge looks up two
    pairs only.
    """
    none = F.lit(NO_RANK)

    def pair(left: Column, right: Column) -> Column:
        return F.coalesce(_rank(ranks, F.concat(left, right)), none)

    def start(parts: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda right, i: pair(F.get(parts, i), right),
        )
        return F.struct(parts.alias("parts"), pairs.alias("pairs"))

    def step(state: Column, _: Column) -> Column:
        parts, pairs = state["parts"], state["pairs"]

        def merge(place: Column) -> Column:
            # place counts from 1; the pair joins parts place and place + 1
            one = F.concat(F.get(parts, place - 1), F.get(parts, place))
            left = F.get(parts, place - 2)
            right = F.get(parts, place + 1)
            new_pairs = F.concat(
                F.slice(pairs, 1, F.greatest(place - 2, F.lit(0))),
                F.when(place > 1, F.array(pair(left, one))).otherwise(F.array().cast("array<int>")),
                F.when(right.isNotNull(), F.array(pair(one, right))).otherwise(F.array().cast("array<int>")),
                F.slice(pairs, place + 2, F.greatest(F.size(pairs) - place - 1, F.lit(0))),
            )
            new_parts = F.concat(
                F.slice(parts, 1, place - 1),
                F.array(one),
                F.slice(parts, place + 2, F.greatest(F.size(parts) - place - 1, F.lit(0))),
            )
            return F.struct(new_parts.alias("parts"), new_pairs.alias("pairs"))

        least = F.coalesce(F.array_min(pairs), none)
        return F.when(least == none, state).otherwise(
            _with(F.array_position(pairs, F.array_min(pairs)).cast("int"), merge)
        )

    letters = F.split(word, "")
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    done = _with(letters, lambda parts: F.aggregate(steps, start(parts), step, lambda state: state["parts"]))
    return F.transform(done, lambda part: _rank(ranks, part))


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """(id_col, ids array<int>): one row per row of df."""
    tokens = read_ranks(name, folder)
    ranks = rank_literal(tokens)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def lookup(r: Column) -> Column:
        return _with(words, lambda own: F.struct(own.alias("words"), F.transform(own, lambda w: _rank(r, w)).alias("ids")))

    def unknown(found: Column) -> Column:
        return F.filter(
            F.transform(found["words"], lambda w, i: F.when(F.get(found["ids"], i).isNull(), F.struct(i.alias("pos"), w.alias("word")))),
            lambda x: x.isNotNull(),
        )

    looked_up = _with(word_literal(tokens), lambda r: _with(lookup(r), lambda found: F.struct(found["ids"].alias("ids"), unknown(found).alias("other"))))
    rows = materialize(
        spread(df.select(id_col, text_col))
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), looked_up.alias("r"))
        .select("row", "id", "r.ids", "r.other"),
        "words",
    )
    other = rows.select("row", F.explode("other").alias("o")).select("row", "o.pos", "o.word")
    # few bytes but much work: folding is spread over all tasks
    distinct = other.groupBy("word").agg(F.count("*").alias("n")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    latin = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    seams = seam_pattern(tokens)

    def fold(r: Column) -> Column:
        pieces = _with(latin, lambda w: F.when(F.length(w) > LONG, F.split(w, seams)).otherwise(F.array(w)))
        return F.flatten(F.transform(pieces, lambda piece: fold_word(r, piece)))

    folded = materialize(distinct.select("word", "n", _with(ranks, fold).alias("ids")), "folded")
    total = folded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT >= total
    tagged = other.join(F.broadcast(folded.where(hot).select("word", "ids")), "word", "left")
    found = (
        tagged.where(F.col("ids").isNotNull())
        .select("row", "pos", "ids")
        .unionByName(tagged.where(F.col("ids").isNull()).drop("ids").join(folded.where(~hot).select("word", "ids"), "word").select("row", "pos", "ids"))
    )
    holed = F.size("other") > 0
    both = (
        rows.where(holed)
        .select("row", F.struct("id", "ids").alias("own"), F.lit(None).cast("struct<pos:int,ids:array<int>>").alias("part"))
        .unionByName(found.select("row", F.lit(None).cast(f"struct<id:{dict(rows.dtypes)['id']},ids:array<int>>").alias("own"), F.struct("pos", "ids").alias("part")))
    )
    whole = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list("part").alias("parts"))
    filled = _with(F.transform(F.sort_array("parts"), lambda p: p["ids"]), lambda parts: _fill(F.col("own.ids"), parts))
    return rows.where(~holed).select(F.col("id").alias(id_col), "ids").unionByName(whole.select(F.col("own.id").alias(id_col), filled.alias("ids")))


def _fill(ids: Column, parts: Column) -> Column:
    """ids, whose null places are replaced by the parts in turn."""
    holes = F.filter(F.transform(ids, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())

    def run(found: Column) -> Column:
        def between(hole: Column, k: Column) -> Column:
            end = F.coalesce(F.get(found, k), F.size(ids))
            return F.slice(ids, hole + 2, end - hole - 1)

        runs = F.transform(F.concat(F.array(F.lit(-1)), found), between)
        return F.flatten(F.zip_with(runs, parts, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<int>")))))

    return _with(holes, run)


def decode_ids(
    df: DataFrame, ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, out: str = "text"
) -> DataFrame:
    """df with the text of its ids: the tokens' bytes are concatenated and read as UTF-8. A null list gives null."""
    ranks = read_ranks(name, folder)
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex()
    pieces = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    joined = _with(pieces, lambda p: F.array_join(F.transform(F.col(ids_col), lambda i: F.get(p, i)), ""))
    return df.withColumn(out, F.decode(F.unhex(joined), "UTF-8"))
