"""Cutting notes into chunks of bounded length along headings, paragraphs and sentences.

Each note is cut within its row, in Arrow batches: sections by headings, sections into pieces of at most `most` tokens, small
pieces merged forward, and an overlap with the piece before. Lines count from 1 in the whole text. Headings in fenced code
are none, and text before the first heading is a section of its own. Tokens are words and punctuation marks unless a counter
over a public vocabulary is passed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.runtime import spread
from notarium.operators.stats import MAX_TOKENS, MIN_TOKENS, TARGET_TOKENS

OVERLAP = 0.12
CHUNKS = (
    "id bigint, chunk_index int, heading_path string, section_title string, text_content string, token_count int, "
    "char_count int, start_line int, end_line int"
)
_TOKENS = re.compile(r"\w+|[^\w\s]")
_HEAD = re.compile(r"(#{1,6})\s+(.+)$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def count_tokens(text: str) -> int:
    """Words and punctuation marks."""
    return len(_TOKENS.findall(text))


def sections(text: str) -> Iterator[tuple[str, str, int, list[str]]]:
    """(heading path, title, first line, lines) of every section."""
    trail: list[tuple[int, str]] = []
    title, begin, lines, fence = "", 1, [], ""
    for number, line in enumerate(text.split("\n"), 1):
        mark = _FENCE.match(line)
        if fence:
            bare = line.strip()
            if bare and len(bare) >= len(fence) and not bare.strip(fence[0]):
                fence = ""
        elif mark:
            fence = mark[1]
        elif head := _HEAD.match(line):
            yield " > ".join(t for _, t in trail), title, begin, lines
            title, begin, lines = head[2].strip(), number, []
            trail = [t for t in trail if t[0] < len(head[1])] + [(len(head[1]), title)]
        lines.append(line)
    yield " > ".join(t for _, t in trail), title, begin, lines


def _slices(text: str, most: int) -> list[str]:
    """Token slices of a text without any better boundary."""
    spans = [m.span() for m in _TOKENS.finditer(text)]
    return [text[spans[i][0] : spans[min(i + most, len(spans)) - 1][1]] for i in range(0, len(spans), most)]


def _packed(parts: list[tuple[str, int, int]], glue: str, most: int, count: Callable[[str], int]) -> list[tuple[str, int, int]]:
    """Consecutive parts joined while they stay within most tokens; sizes are kept as running sums."""
    out: list[list] = []
    size = 0
    for text, first, last in parts:
        own = count(text)
        if out and size + own <= most:
            out[-1][0].append(text)
            out[-1][2] = last
            size += own
        else:
            out.append([[text], first, last])
            size = own
    return [(glue.join(texts), first, last) for texts, first, last in out]


def _pieces(begin: int, lines: list[str], most: int, count: Callable[[str], int]) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of a section in pieces of at most `most` tokens."""
    paragraphs: list[tuple[str, int, int]] = []
    run: list[str] = []
    for number, line in enumerate([*lines, ""], begin):
        if line.strip():
            run.append(line)
        elif run:
            paragraphs.append(("\n".join(run).strip(), number - len(run), number - 1))
            run = []
    parts: list[tuple[str, int, int]] = []
    for text, first, last in paragraphs:
        if count(text) <= most:
            parts.append((text, first, last))
            continue
        sentences: list[tuple[str, int, int]] = []
        for sentence in _SENTENCE.split(text):
            cut = [sentence] if count(sentence) <= most else _slices(sentence, most)
            sentences.extend((s.strip(), first, last) for s in cut if s.strip())
        parts.extend(_packed(sentences, " ", most, count))
    return _packed(parts, "\n\n", most, count)


def chunk_text(
    text: str | None,
    least: int = MIN_TOKENS,
    target: int = TARGET_TOKENS,
    most: int = MAX_TOKENS,
    overlap: float = OVERLAP,
    count: Callable[[str], int] = count_tokens,
) -> list[tuple[str, str, str, int, int, int]]:
    """(text, heading path, title, tokens, first line, last line) of the chunks; none for null or blank text."""
    if not text or not text.strip():
        return []
    merged: list[list] = []
    for path, title, begin, lines in sections(text):
        for piece, first, last in _pieces(begin, lines, most, count):
            if merged and count(merged[-1][0]) < least and count(merged[-1][0]) + count(piece) <= most:
                before = merged[-1]
                merged[-1] = [f"{before[0]}\n\n{piece}", before[1] or path, before[2] or title, before[3], last]
            else:
                merged.append([piece, path, title, first, last])
    tail = int(target * overlap)
    out = []
    for i, (piece, path, title, first, last) in enumerate(merged):
        whole = piece
        if i and tail > 0:
            spans = [m.start() for m in _TOKENS.finditer(merged[i - 1][0])]
            shared = merged[i - 1][0][spans[max(0, len(spans) - tail)] :].strip() if spans else ""
            if shared and count(shared) + count(piece) <= most:
                whole = f"{shared}\n\n{piece}"
        out.append((whole, path, title, count(whole), first, last))
    return out


def chunk_notes(
    notes: DataFrame, id_col: str = "id", text_col: str = "markdown_text", counter: Callable[[], Callable[[str], int]] | None = None, most: int = MAX_TOKENS
) -> DataFrame:
    """Chunks (see CHUNKS) of every note; counter makes a token counter in each task, such as vocabulary.token_counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else count_tokens
        for batch in batches:
            rows = [
                (i, n, path, title, text, tokens, len(text), first, last)
                for i, note in zip(batch["id"].to_pylist(), batch["text"].to_pylist())
                for n, (text, path, title, tokens, first, last) in enumerate(chunk_text(note, most=most, count=count))
            ]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) if rows else [()] * 9
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return spread(notes.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, CHUNKS)
