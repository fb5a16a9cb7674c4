"""Cutting oversized items at natural boundaries, by content-defined chunking.

Words are runs of non-blank characters. A rolling hash over the last words marks landmarks that depend on the content only.
From the start of a piece the first landmark between the least and the greatest size that has a natural boundary (before a
heading, at a blank line, at a sentence end) within EVERY words snaps to the nearest one; where there is none, the last
boundary of the best kind in the range is the cut (a line end is the least kind), and where it has none at all, a landmark or the
size limit. So an edit moves the neighbouring cuts only. Each piece repeats the last words of the piece before.

Everything happens within one row (a note or a chunk), in Arrow batches without any shuffle but the one that brings a
chunk to its note's collection; that one carries only chunks which are too long for the smallest limit.

Null and empty texts, unknown collections and chunks without a note give no pieces. Null or negative overlaps count as 0, an
overlap that leaves no room is cut to the limit less one word. Null limits mean no limit. Very long texts are cut in linear
time. Repeated rows give the same pieces once; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.runtime import spread

PIECES = (
    "source_table string, record_id bigint, section_no int, piece_no int, heading_path string, token_count int, "
    "first_word int, last_word int, text string"
)
#: Landmarks come once in so many words, and depend on so many words.
EVERY, ROLL = 24, 4
_BASE, _MODULUS = 1_000_003, 2**32

_WORD = re.compile(r"\S+")
_HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)\s*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_CLOSE = re.compile(r"[\"'”’)\]*_]*$")
#: Sentence ends, as fixed characters.
_STOPS = ".!?。！？…"


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters, blanks as Python's str.split has them."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def sections(text: str) -> list[tuple[int, str, str]]:
    """(number, heading path, text) of the sections; section 0 is what stands before the first heading."""
    found: list[tuple[int, str, list[str]]] = [(0, "", [])]
    open_mark, titles = "", []
    for line in text.split("\n"):
        fence = _FENCE.match(line)
        bare = line.strip()
        if open_mark:
            if bare and set(bare) == {open_mark[0]} and len(bare) >= len(open_mark):
                open_mark = ""
        elif fence:
            open_mark = fence[1]
        elif heading := _HEADING.match(line):
            level = len(heading[1])
            titles = [t for t in titles if t[0] < level] + [(level, heading[2])]
            found.append((len(found), " > ".join(t for _, t in titles), []))
        found[-1][2].append(line)
    return [(n, path, "\n".join(lines)) for n, path, lines in found]


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words and, for each word, the worth of a cut after it: 4 before a heading, 3 at a blank line, 2 at a
    sentence end, 1 at a line end, 0 elsewhere."""
    spans = [m.span() for m in _WORD.finditer(text)]
    worth = []
    for (_, end), (begin, _) in zip(spans, spans[1:]):
        gap = text[end:begin]
        if "\n" in gap:
            after = _HEADING.match(text, begin) if text[begin] == "#" else None
            worth.append(4 if after else 3 if gap.count("\n") > 1 else 1)
        else:
            worth.append(0)
        if worth[-1] < 2:
            last = _CLOSE.sub("", text[max(0, end - 8) : end])
            if last and last[-1] in _STOPS:
                worth[-1] = 2
    return spans, [*worth, 5] if spans else []


def landmarks(codes: list[int]) -> list[int]:
    """Numbers of words behind which a landmark stands: the rolling hash of the last ROLL words is a multiple of EVERY.

    The hash is a polynomial: a step takes the word that leaves the window out and the new one in.
    """
    leaving = pow(_BASE, ROLL, _MODULUS)
    found, rolled = [], 0
    for i, code in enumerate(codes):
        out = codes[i - ROLL] if i >= ROLL else 0
        rolled = (rolled * _BASE + code - out * leaving) % _MODULUS
        if rolled % EVERY == 0:
            found.append(i + 1)
    return found


def cuts(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of the words and the (first, past last) words of each piece."""
    spans, worth = boundaries(text)
    n = len(spans)
    if n <= limit:
        return spans, [(0, n)] if n else []
    overlap = max(0, min(overlap, limit - 1))
    marks = landmarks([zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")) for a, b in spans])
    natural = [i + 1 for i, w in enumerate(worth) if w >= 2]
    pieces, start = [], 0
    while start < n:
        room = limit - (overlap if pieces else 0)
        if n - start <= room:
            cut = n
        else:
            least, most = start + max(1, room // 3), start + room
            inside = natural[bisect.bisect_left(natural, least) : bisect.bisect_right(natural, most)]
            cut = 0
            # the first landmark that has a natural boundary close by
            for mark in marks[bisect.bisect_left(marks, least) : bisect.bisect_right(marks, most)]:
                at = bisect.bisect_left(inside, mark)
                close = [i for i in inside[max(0, at - 1) : at + 1] if abs(i - mark) <= EVERY]
                if close:
                    cut = min(close, key=lambda i: (abs(i - mark), -worth[i - 1], i))
                    break
            if not cut:
                near = range(least, most + 1)
                best = max(worth[i - 1] for i in near)
                cut = max(i for i in near if worth[i - 1] == best) if best else next(iter(marks[bisect.bisect_left(marks, least) : bisect.bisect_right(marks, most)]), most)
        pieces.append((max(0, start - overlap) if pieces else 0, cut))
        start = cut
    return spans, pieces


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for table, record, by_section, path, text, limit, overlap in zip(
            *[batch[c].to_pylist() for c in ("source_table", "record_id", "by_section", "path", "text", "limit", "overlap")]
        ):
            limit = max(1, limit)
            for number, own, part in sections(text) if by_section else [(0, path or "", text)]:
                if len(part.split()) <= limit:
                    continue
                spans, pieces = cuts(part, limit, overlap or 0)
                for k, (a, b) in enumerate(pieces):
                    rows.append((table, record, number, k, own, b - a, a, b - 1, part[spans[a][0] : spans[b - 1][1]]))
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def split_oversized(notes: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces (see PIECES) of all sections of notes, and all chunks, that have more words than their collection allows.

    Words and pieces count from 0 within their section or chunk; token_count is in words, overlap included.
    """
    bound = (
        limits.where(F.col("max_words").isNotNull() & F.col("collection_id").isNotNull())
        .groupBy("collection_id")
        .agg(F.min("max_words").alias("limit"), F.max("overlap_words").alias("overlap"))
    )
    least = bound.agg(F.min("limit")).first()[0]
    if least is None:
        least = 2**31 - 1
    whole = (
        notes.select("id", "collection_id", F.col("markdown_text").alias("text"))
        .where(F.col("text").isNotNull())
        .join(bound, "collection_id")
        .where(word_count(F.col("text")) > F.col("limit"))
        .select(
            F.lit("vq_documents").alias("source_table"),
            F.col("id").cast("bigint").alias("record_id"),
            F.lit(True).alias("by_section"),
            F.lit(None).cast("string").alias("path"),
            "text",
            "limit",
            "overlap",
        )
    )
    long = chunks.select("id", "document_id", "heading_path", F.col("text_content").alias("text")).withColumn(
        "words", word_count(F.col("text"))
    )
    homes = notes.select(F.col("id").alias("document_id"), "collection_id").distinct()
    part = (
        long.where(F.col("words") > least)
        .join(homes, "document_id")
        .join(bound, "collection_id")
        .where(F.col("words") > F.col("limit"))
        .select(
            F.lit("vq_chunks").alias("source_table"),
            F.col("id").cast("bigint").alias("record_id"),
            F.lit(False).alias("by_section"),
            F.col("heading_path").alias("path"),
            "text",
            "limit",
            "overlap",
        )
    )
    pieces = spread(whole).mapInArrow(_split, PIECES).unionByName(part.mapInArrow(_split, PIECES))
    return pieces.dropDuplicates(["source_table", "record_id", "section_no", "piece_no"])
