"""Texts that stop before their own end.

Two kinds of evidence meet.

* Near-copies. A cut copy is a beginning of its longer copy, so it is looked for by containment, not by likeness of the wholes.
  Every text gets bands of two min-hashes of its beginnings of 4, 8, 16, ... five-word shingles. A text without a full stop at
  its end looks with the bands of its longest such beginning, which is at least half of it; every other text answers with the
  bands of all its beginnings. Pairs in which at least CONTAINED of the shorter text's shingles stand in the longer one are
  aligned on their words: where the shorter text ends, the longer one either goes on inside a word or a sentence (then the
  shorter one is cut) or not. The number of bands brings pairs at that threshold, edits spread evenly, together with a chance
  of RECALL at least; plain cut copies agree in all bands. Buckets with many texts are split by the last words of the shorter
  ones, which the longer ones must hold too, or the ends cannot align. There a text meets PROBES longer ones first, and then all
  others that can still change its verdict: none if it is cut against one; if it is whole against one, those where it may be
  cut; else all. So the result is that of all pairs, whatever the size of a bucket.
* Closing words. Whatever a tool appended is taken off first (cut markers, signatures, addresses, tags). Cut markers are learnt:
  a bracketed phrase at the end is one if at least half of the texts that end with it stop in running text before it. A text is
  whole if it then ends a sentence, a code block, a table row or an element; cut if an element of markup was begun and not
  filled, or prose stops without an end. List items, headings and short lines have no full stop; there the closing word
  decides, by its terminality: how often the word closes a line of that kind, against how often words of such lines close
  them at all. It is no end if it closes less than TERMINAL of that and the shortfall is no chance (CHANCE, by the
  Chernoff bound). Words too rare to tell are judged by the pooled rate of all rare words, and are no end if they begin a
  known word. Short lines also have a shape (first word and number of words), which counts by its rate: of all lines
  with that first word that get as far, how many end there without a stop. A closing word that is known not to be an end is
  overruled only by a shape in which nearly all of them end. The judged text and cut texts are left out of the counts.
  A text whose length is a field limit of its source (a length that stands out among its neighbours) must close with a word
  that closes at least as often as words do.

Null, empty and blank texts are never cut. Null ids and sources are kept as they are; repeated rows give one row in found().
Texts are read whole and once, in one pass that gives endings, counts and bands; a second pass reads the texts of candidate
pairs only. Extra columns are ignored. Shuffles: bands, word counts of lines after a count per batch, and texts of candidate pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notarium.llm.markup import _fences
from notarium.llm.near_duplicates import _fmix, _slices, word_hashes
from notarium.runtime import materialize, semi_join_checked, spread

#: Words of a shingle, share of the shorter text's shingles that a longer copy holds, and the chance to bring such a pair together.
WORDS, CONTAINED, RECALL = 5, 0.8, 0.999
#: Shingles of the first beginning; each further one has twice as many. Min-hashes of a band.
FIRST, ROWS = 4, 2
#: Pairs of a bucket up to which all are aligned at once, and longer copies that a text of a larger one meets at first.
BUCKET_PAIRS, PROBES = 4096, 16
#: Occurrences from which a word, shape or phrase is known; share of the usual closing rate under which a word is no end; chance.
LEAST, TERMINAL, CHANCE = 3, 0.3, 0.005
#: The share for a short line behind much other text.
FRAMED = 0.7
#: Rate of a shape under which it is no end, and from which it overrules a closing word.
SHAPED, SURE_SHAPE = 0.3, 0.9
#: Share of the texts with a phrase at their end that stop in running text before it, from which the phrase is a cut marker.
MARKED = 0.5
#: Numbers of words from here on are one shape: no short line has as many.
MOST_WORDS = 41

#: Dots in brackets that tools put behind a cut, as a fixed pattern; a replacement character at the end is half a character.
_ELLIPSIS = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\))\s*$")
#: A bracketed phrase at the end.
_PHRASE = re.compile(r"\s*(?:\[([^\[\]\n]{2,60})\]|\(([^()\n]{2,60})\)|<([^<>=/\"\n]{1,40} [^<>=/\"\n]{1,40})>)\s*$")
_DOTS = re.compile(r"\s*(?:…|\.{3,})\s*$")
#: Phrases that end a whole text with three dots.
_CONTINUED = re.compile(r"(?:to be continued|fortsetzung folgt|à suivre|continuará|つづく|続く)$", re.I)
_SIGNATURE = re.compile(r"\n-- ?\n(?:[^\n]{0,60}\n?){1,4}$")
#: Longest signature, and the characters at an end in which a phrase or dots stand.
SIGNED, PHRASED = 256, 96
_ADDRESS = re.compile(r"[ \t]*(?:(?:https?://|www\.|mailto:)\S+|<?[\w.+-]+@[\w-]+(?:\.[\w-]+)+>?)[ \t]*")
_CLOSED = re.compile(r"\s*</(?:html|body|main|article|section|div)>\s*$", re.I)
_TAGS = re.compile(r"[ \t]*(?:#[^\s#]+[ \t]*)+")
_STOPS = ".!?。！？"
_CLOSERS = "\"'”’»)]」』*_`"
_LISTED = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_EMPTY_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)]|#{1,6}|>+|\||- \[[ x]?\]?)[ \t]*$")
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
SHORT = 80


def _strip(text: str) -> str:
    """Without white space and control characters at the end."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cc", "Cf") and text[end - 1] != "‍"):
        end -= 1
    return text[:end]


def _open_markup(text: str, last: str) -> bool:
    """Whether the text ends in an element of markup that was begun and not filled."""
    fenced = _fences(text)
    if fenced and fenced[-1][2] == fenced[-1][3]:
        return True
    if fenced and fenced[-1][3] >= len(text):
        return False
    if _EMPTY_ITEM.match(last):
        return True
    at, parts = 0, []
    for begin, _, _, past in fenced:
        parts.append(text[at:begin])
        at = past
    outside = "".join([*parts, text[at:]])
    block = outside[outside.rfind("\n\n") + 1 :]
    if re.search(r"!?\[[^\[\]\n]*$|\]\([^()\n]*$|\{\{[^{}]*$|\[\[[^\[\]\n]*$", last):
        return True
    if re.search(r"<(?:[A-Za-z/!][^<>]*)?$|&(?:#?[A-Za-z0-9]{0,8})$", last) or outside.rfind("<!--") > outside.rfind("-->"):
        return True
    bare = re.sub(r"`[^`\n]*`", "", block)
    return bare.count("**") % 2 == 1 or bare.count("~~") % 2 == 1 or bare.count("`") % 2 == 1


def _is_symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Mn", "Cf") and not c.isalnum() or "\U0001f1e6" <= c <= "\U0001f1ff"


def kind_of(line: str) -> str:
    """'list', 'head', 'short' or 'prose'."""
    if _LISTED.match(line):
        return "list"
    if line.startswith("#"):
        return "head"
    return "short" if len(line) <= SHORT and not _CJK.search(line) else "prose"


def closing_word(line: str) -> str:
    """The last word of a line in lower case, numbers as 0."""
    words = _TOKEN.findall(line)
    return re.sub(r"\d+", "0", words[-1].lower()) if words else ""


def phrase_class(m: re.Match) -> str:
    """A bracketed phrase in lower case, numbers as 0."""
    return re.sub(r"\d+", "0", " ".join(m[0].lower().split()))


def _phrase_at_end(body: str) -> re.Match | None:
    return _PHRASE.search(body, max(0, len(body) - PHRASED)) if body[-1:] in ("]", ")", ">") else None


def _appended(body: str, markers: frozenset[str]) -> tuple[int, str]:
    """Where the last thing begins that a tool appended to a stripped text, and its kind ('tail', 'mark'); (-1, '') if none."""
    if m := _SIGNATURE.search(body, max(0, len(body) - SIGNED)):
        return m.start(), "tail"
    line = body.rfind("\n") + 1
    last = body[line:]
    if _ADDRESS.fullmatch(last) or (last.lstrip()[:1] == "#" and _TAGS.fullmatch(last)):
        return max(0, line - 1), "tail"
    if body[-1:] == ">" and (m := _CLOSED.search(body, max(0, len(body) - PHRASED))):
        return m.start(), "tail"
    if body[-1:] in ("]", ")") and (m := _ELLIPSIS.search(body, max(0, len(body) - PHRASED))):
        return m.start(), "mark"
    if markers and (m := _phrase_at_end(body)) and phrase_class(m) in markers:
        return m.start(), "mark"
    if body[-1:] in ("…", ".") and (m := _DOTS.search(body, max(0, len(body) - PHRASED))) and not _CONTINUED.search(body[max(0, m.start() - PHRASED) : m.start()]):
        return m.start(), "mark"
    return -1, ""


def end_phrase(text: str) -> str:
    """The class of the bracketed phrase at a text's end, before signatures and the like; '' if there is none."""
    body = _strip(text)
    while body:
        begin, kind = _appended(body, frozenset())
        if kind != "tail":
            break
        body = _strip(body[:begin])
    m = _phrase_at_end(body)
    return phrase_class(m) if m and not _ELLIPSIS.search(m[0]) else ""


def closing(text: str, markers: frozenset[str] = frozenset()) -> tuple[str, str, str]:
    """(verdict, kind, word): 'whole', 'cut', or 'unsure' with the kind of the last line and its closing word.

    markers are the classes of phrases that are cut markers. Of a short line, word is its frame and the closing word. After much
    other text its kind is 'frame': only the shape of a message makes it whole. Of a text cut before a marker, word is the
    kind of its last line.
    """
    body = _strip(text)
    marked = tail = False
    while True:
        begin, kind = _appended(body, markers)
        if begin < 0:
            break
        marked, tail = marked or kind == "mark", tail or kind == "tail"
        if not begin and not marked:
            return "whole", "", ""
        body = _strip(body[:begin])
    if not body:
        return ("cut" if marked else "whole"), "", ""
    last = body[body.rfind("\n") + 1 :]
    if body[-1] == "\ufffd":
        return "cut", "bytes", ""
    if _open_markup(body, last):
        return "cut", "markup", ""
    if _DOTS.search(body, max(0, len(body) - PHRASED)):
        return "whole", "", ""
    core = body.rstrip(_CLOSERS)
    if (core or body)[-1] in _STOPS:
        return "whole", "", ""
    if (m := _phrase_at_end(body)) and _strip(body[: m.start()]).rstrip(_CLOSERS)[-1:] in tuple(_STOPS):
        return "whole", "", ""  # a remark behind a sentence
    if marked:
        return "cut", "marker", kind_of(last)
    if re.match(r"\s*(?:```|~~~)", last) or re.match(r"\s*\|.*\|$", last) or (last[-1] == ">" and re.search(r"</?[A-Za-z][^<>]*>$|-->$", last)):
        return "whole", "", ""
    if last.lstrip().startswith("|") or re.search(r"(?:[^\W\d_]| )-$", body[-2:]):
        return "cut", "", ""
    if re.search(r"(?:\$\$|\\\]|\\end\{[^{}]*\}|\}\}|\|\})$", last) or _is_symbol(body[-1]):
        return "whole", "", ""
    kind = kind_of(last)
    if kind == "prose":
        return "cut", kind, ""
    if last[-1] in ",;:(" or (tail and kind == "short" and "\n" in body):
        return "cut", kind, ""
    if kind != "short":
        return "unsure", kind, closing_word(last)
    return "unsure", "frame" if len(body) > 2 * SHORT else kind, frame(last) + " " + closing_word(last)


def _alone(text: str) -> bool:
    """Whether the text is one line, which then counts among the lines of the corpus."""
    return "\n" not in _strip(text)


def frame(line: str) -> str:
    """First word and number of words of a line: the shape of a short message."""
    words = line.split(None, MOST_WORDS)
    return f"{words[0].lower()} {min(len(words), MOST_WORDS)}" if words else ""


def _count_lines(text: str, verdict: str, counts: dict[tuple[str, str], list[int]]) -> None:
    """Add the occurrences (n) and closings (e) of the words of a text's list items, headings and short lines, and of frames.

    n of a frame counts all lines of that shape in text (no list items, no headings), e the short ones without a stop. Lines
    that end with a stop tell nothing about those that do not, and the last line of a longer text and texts of one line that
    are cut are left out, as whether they are whole is the question.
    """
    lines = text.split("\n")[:-1]
    if _alone(text):
        lines = [_strip(text)] if verdict != "cut" else []
    for line in lines:
        line = line.strip()
        if not line:
            continue
        kind = kind_of(line)
        if kind in ("short", "prose"):
            counts["frame", frame(line)][0] += 1
        if kind == "prose" or line.rstrip(_CLOSERS)[-1:] in tuple(_STOPS):
            continue
        words = [re.sub(r"\d+", "0", w.lower()) for w in _TOKEN.findall(line)]
        for w in words:
            counts[kind, w][0] += 1
        if words:
            counts[kind, words[-1]][1] += 1
        if kind == "short":
            counts["frame", frame(line)][1] += 1


def band_count(contained: float = CONTAINED, recall: float = RECALL) -> int:
    """Bands that bring two beginnings together with the given chance, if one holds `contained` of the other's shingles."""
    same = (contained / (2 - contained)) ** ROWS
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def beginnings(batch: pa.RecordBatch, count: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Shingles of each text, and the band keys of its beginnings: one array of `count` keys per level, text after text."""
    hashes, words = word_hashes(batch["text"])
    starts = np.r_[0, np.cumsum(words)[:-1]].astype(np.int64)
    sizes = np.maximum(words - WORDS + 1, 0)
    n = len(hashes) - WORDS + 1
    mixed = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(mixed)]
    mixed = _fmix(mixed)
    levels = np.where(sizes >= FIRST, np.log2(np.maximum(sizes, 1) / FIRST + 1e-12).astype(np.int64) + 1, 0)
    random = np.random.default_rng(11)
    factors = random.integers(0, 2**32, count * ROWS, dtype=np.uint32) | np.uint32(1)
    offsets = random.integers(0, 2**32, count * ROWS, dtype=np.uint32)
    # segments of 4, 4, 8, 16, ... shingles; the least values of a beginning are the running least ones of its segments
    owners = np.repeat(np.arange(len(words)), levels)
    level = np.arange(len(owners)) - np.repeat(np.cumsum(levels) - levels, levels)
    begin = starts[owners] + np.where(level == 0, 0, FIRST << np.maximum(level - 1, 0))
    end = starts[owners] + (FIRST << level)
    if not len(owners):
        return sizes, [], []
    edges = np.stack([begin, end], axis=1).reshape(-1)
    low = (mixed >> np.uint64(11)).astype(np.uint32)
    low = np.r_[low, np.zeros(1, np.uint32)]  # reduceat wants every edge inside
    least = np.empty((len(owners), count * ROWS), np.uint32)
    for j in range(count * ROWS):
        value = low * factors[j] + offsets[j]
        value ^= value >> np.uint32(15)
        value[-1] = np.uint32(2**32 - 1)
        least[:, j] = np.minimum.reduceat(value, edges)[::2]
    for depth in range(1, int(levels.max())):
        at = np.flatnonzero(level == depth)
        least[at] = np.minimum(least[at], least[at - 1])
    keys = (np.arange(count, dtype=np.uint64) + np.uint64(1 << 20) * level.astype(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    for part in range(ROWS):
        keys = _fmix(keys + least[:, part::ROWS].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return sizes, list(keys.view(np.int64)), list(owners)


def _reader(count: int):
    """One pass over texts: endings, band keys, and, with the first text of a batch, the counts of its lines."""
    names = "doc_id source length k1 k2 verdict kind word phrase verdict2 kind2 word2 own asked answers counts".split()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                texts = batch["text"].to_pylist()
                counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
                first, second, phrases, own, asks = [], [], [], [], []
                for text in texts:
                    plain = closing(text)
                    phrase = end_phrase(text)
                    other = closing(text, frozenset([phrase])) if phrase else ("", "", "")
                    if phrase:
                        counts["phrase", phrase][0] += 1
                        counts["phrase", phrase][1] += other[1:] == ("marker", "prose")
                    _count_lines(text, plain[0], counts)
                    first.append(plain)
                    second.append(other)
                    phrases.append(phrase)
                    own.append(int(plain[0] != "cut" and _alone(text)))
                    bare = _strip(text).rstrip(_CLOSERS)
                    asks.append(bare[-1:] not in tuple(_STOPS))
                digests = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
                _, rows, owners = beginnings(batch, count)
                offsets = np.searchsorted(np.array(owners, np.int64), np.arange(len(texts) + 1))
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                answers = pa.ListArray.from_arrays(pa.array((offsets * count).astype(np.int32)), pa.array(flat))
                # the keys of the longest beginning are the last ones of a text
                top = np.where((np.diff(offsets) > 0) & np.array(asks, bool), count, 0)
                picked = [np.arange(e * count - t, e * count) for e, t in zip(offsets[1:], top)]
                asked = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(top)].astype(np.int32)), pa.array(flat[np.concatenate(picked).astype(np.int64)] if picked else flat)
                )
                counted = [[{"kind": k, "word": w, "n": n, "e": e} for (k, w), (n, e) in counts.items()]] + [[]] * (len(texts) - 1)
                columns = [
                    batch["doc_id"],
                    batch["source"],
                    batch["length"],
                    pa.array(np.array([d >> 64 for d in digests], np.uint64).view(np.int64)),
                    pa.array(np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)),
                    *[pa.array([v[i] for v in first], pa.string()) for i in range(3)],
                    pa.array(phrases, pa.string()),
                    *[pa.array([v[i] for v in second], pa.string()) for i in range(3)],
                    pa.array(own, pa.int32()),
                    asked,
                    answers,
                    pa.array(counted, pa.list_(pa.struct([("kind", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("e", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return read


def _body(text: str) -> str:
    """A text without what tools appended; a bracketed phrase at its end counts as appended."""
    body = _strip(text)
    while body:
        m = _phrase_at_end(body)
        begin = m.start() if m else _appended(body, frozenset())[0]
        if begin < 0:
            break
        body = _strip(body[:begin])
    return body


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}


def contained(short: str, long: str) -> float:
    """Share of the five-word shingles of the shorter text, its last word left out, that stand in the longer one."""
    own = _shingles(re.findall(r"[^\W_]+", _body(short).lower())[:-1])
    return len(own & _shingles(re.findall(r"[^\W_]+", long.lower()))) / len(own) if own else 0.0


def _words_key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


def tail(text: str) -> tuple[int | None, str | None, str | None, str | None]:
    """Key of the inner four of the six words before a text's last one, the first and sixth of these, and the last word."""
    own = _body(text).split()
    if len(own) < 8:
        return None, None, None, None
    return _words_key(own[-6:-2]), own[-7], own[-2], own[-1].rstrip("-") or own[-1]


def windows(text: str) -> list[tuple[int, str, str, str | None, bool]]:
    """All places at which a shorter text's tail may stand: key of four words, the words before, behind and after that, and goes on.

    Only the inner words of a tail must be whole words here: ends_early also finds a tail whose rims are parts of words. The
    last value tells whether a text that ends with the word after that stops inside a sentence.
    """
    spans = list(re.finditer(r"\S+", text))
    words = [m[0] for m in spans]
    stops = [w.rstrip(_CLOSERS)[-1:] in tuple(_STOPS) or w[-1] in _STOPS for w in words]
    goes_on = [not stops[j] and text[spans[j].end()] not in "\n\r" for j in range(len(words) - 1)] + [False, False]
    found = [
        (_words_key(words[i : i + 4]), words[i - 1], words[i + 4], words[i + 5] if i + 5 < len(words) else None, goes_on[i + 5])
        for i in range(1, len(words) - 4)
    ]
    return list(dict.fromkeys(found))


def ends_early(short: str, long: str) -> str:
    """How the shorter text ends against its longer copy: 'cut', 'whole', or '' if the ends do not align.

    The last full words of the shorter text are found in the longer one; what follows there tells.
    """
    body = _body(short)
    spans = list(re.finditer(r"\S+", body))
    if len(spans) < 8:
        return ""
    last = spans[-1][0].rstrip("-") or spans[-1][0]
    anchor = [m[0] for m in spans[-7:-1]]
    place = long.rfind(" ".join(anchor)) if " ".join(anchor) in long else -1
    if place < 0:
        found = re.search(r"\s+".join(map(re.escape, anchor)), long)
        if not found:
            return ""
        begin = found.end()
    else:
        begin = place + len(" ".join(anchor))
    rest = long[begin:].lstrip()
    if not rest.startswith(last):
        return ""
    after = rest[len(last) :]
    if not after.strip():
        return ""
    if after[0] in "\n\r" or last[-1] in _STOPS or (after[0].isspace() and last.rstrip(_CLOSERS)[-1:] in tuple(_STOPS)):
        return "whole" if not (after[0] in "\n\r" and after.lstrip("\r\n")[:1].islower() and "\n\n" not in after[:2]) else ""
    if not _TOKEN.match(after.lstrip()[:1]) and after[0] in _STOPS + _CLOSERS:
        # only the stop itself is missing
        return "cut" if after[0] in _STOPS else ""
    return "cut"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["short"].to_pylist(), batch["long"].to_pylist())
        verdicts = [ends_early(a, b) if contained(a, b) >= CONTAINED else "apart" for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(verdicts, pa.string())], names=["k1", "k2", "ends"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tail(t) for t in batch["text"].to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.string() if i else pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch["s"], *columns], names=["s", "end", "first", "sixth", "last"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
    for whole in batches:
        for batch in _slices(whole, "text"):
            found = [windows(t) for t in batch["text"].to_pylist()]
            owners = np.repeat(np.arange(len(found)), [len(f) for f in found])
            rows = [row for f in found for row in f]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["g"].take(pa.array(owners)), *columns], names=["g", "end", "before", "behind", "after", "goes_on"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit text keys, so that equal texts can be grouped."""
    for batch in batches:
        keys = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
        k1 = np.array([k >> 64 for k in keys], np.uint64).view(np.int64)
        k2 = np.array([k & (2**64 - 1) for k in keys], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1), pa.array(k2)], names=[*batch.schema.names, "k1", "k2"])


def aligned(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, ends): how each text s of pairs (s, g) ends against its longer copy g; ends is 'apart' if g is none."""
    needed = materialize(pairs.select(F.explode(F.array("s", "g")).alias("id")).distinct(), "needed")
    texts = materialize(semi_join_checked(bodies, needed, ["id"]).dropDuplicates(["id"]), "bodies")
    both = pairs.join(texts.select(F.col("id").alias("s"), F.col("text").alias("short")), "s").join(
        texts.select(F.col("id").alias("g"), F.col("text").alias("long")), "g"
    )
    rows = both.select("s.k1", "s.k2", "short", "long").mapInArrow(_align, "k1 bigint, k2 bigint, ends string")
    return rows.select(F.struct("k1", "k2").alias("id"), "ends")


def copies_of(rows: DataFrame, bodies: DataFrame, bucket_pairs: int = BUCKET_PAIRS, probes: int = PROBES) -> DataFrame:
    """(id, copy_cut): texts with a longer near-copy whose end aligns, and whether they stop early against any.

    rows has k1, k2, length and the band keys `asked` (of texts that may be cut) and `answers`; bodies has id (k1, k2) and text.
    """
    one = materialize(rows.groupBy(F.struct("k1", "k2").alias("id")).agg(F.first("length").alias("length"), F.first("asked").alias("asked"), F.first("answers").alias("answers")), "banded")
    asking = one.select(F.col("id").alias("s"), F.col("length").alias("sl"), F.explode("asked").alias("band"))
    count = asking.groupBy("band").agg(F.count("*").alias("asking"))
    held = materialize(one.select(F.col("id").alias("g"), F.col("length").alias("gl"), F.explode("answers").alias("band")).join(count, "band"), "held")
    full = held.groupBy("band").agg(F.count("*").alias("n"), F.first("asking").alias("asking")).where("n > 1")
    full = materialize(full.select("band", (F.col("n") * F.col("asking") > bucket_pairs).alias("large")), "buckets")
    longs, shorts = materialize(held.drop("asking").join(full, "band"), "longs"), asking.join(full, "band")
    longer = F.col("gl") > F.col("sl")
    direct = shorts.where(~F.col("large")).join(longs.where(~F.col("large")).drop("large"), "band").where(longer).select("s", "g").distinct()
    ends = aligned(materialize(direct, "pairs"), bodies)
    if not full.where("large").limit(1).count():
        return _ended(ends)
    # large buckets: the longer copy must hold the last words of the shorter one
    ends = materialize(ends, "ends")
    shorts, longs = materialize(shorts.where("large").drop("large"), "asking"), longs.where("large").drop("large")
    hot = materialize(shorts.select(F.col("s").alias("id")).union(longs.select("g")).distinct(), "hot")
    texts = materialize(semi_join_checked(bodies, hot, ["id"]).dropDuplicates(["id"]), "texts")
    id_type = "struct<k1:bigint,k2:bigint>"
    enders = texts.join(shorts.select(F.col("s").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("s"), "text")
    tails = materialize(enders.mapInArrow(_tails, f"s {id_type}, end bigint, first string, sixth string, last string").where("end IS NOT NULL"), "tails")
    ending = materialize(shorts.join(tails, "s"), "ending")
    asked = materialize(tails.select("end").distinct(), "asked")
    places = texts.select(F.col("id").alias("g"), "text").mapInArrow(
        _windows, f"g {id_type}, end bigint, before string, behind string, after string, goes_on boolean"
    )
    holding = materialize(longs.join(semi_join_checked(places, asked, ["end"]), "g"), "holding")
    inside = F.startswith("behind", F.concat("sixth", "last"))
    follows = (F.col("behind") == F.col("sixth")) & F.startswith("after", "last")
    meets = longer & F.endswith("before", "first") & (inside | follows)
    may_cut = inside | (F.col("after") != F.col("last")) | F.col("goes_on")
    first = Window.partitionBy("band", "end").orderBy(F.xxhash64("g"))
    few = holding.withColumn("at", F.row_number().over(first)).where(F.col("at") <= probes).drop("at")
    probed = materialize(ending.join(few, ["band", "end"]).where(meets).select("s", "g").distinct(), "probed")
    tried = materialize(aligned(probed, texts), "tried")
    # a text that is cut against one longer copy is cut; all others meet every longer copy that can still change that
    settled = materialize(_ended(ends.unionByName(tried)).withColumnRenamed("id", "s"), "settled")
    left = ending.join(settled, "s", "left").where(~F.coalesce("copy_cut", F.lit(False)))
    rest = left.join(holding, ["band", "end"]).where(meets & (F.col("copy_cut").isNull() | may_cut)).select("s", "g").distinct()
    rest = materialize(rest.join(probed, ["s", "g"], "left_anti"), "rest")
    return _ended(ends.unionByName(tried).unionByName(aligned(rest, texts)))


def _ended(ends: DataFrame) -> DataFrame:
    return ends.where(~F.col("ends").isin("apart", "")).groupBy("id").agg(F.max(F.col("ends") == "cut").alias("copy_cut"))


def field_limits(lengths: DataFrame) -> DataFrame:
    """(source, length): text lengths that stand out among their neighbours (five times the mean of ten on each side)."""
    counted = lengths.groupBy("source", "length").agg(F.count("*").alias("n"))
    around = F.sum("n").over(Window.partitionBy("source").orderBy("length").rangeBetween(-10, 10))
    return counted.withColumn("around", around).where((F.col("n") >= 8) & (F.col("n") > 5 * (F.col("around") - F.col("n")) / 20)).select("source", "length")


def judge(df: DataFrame) -> DataFrame:
    """(doc_id, source, cut, evidence): one row per row of df (doc_id, text, source) with a text that is not blank.

    evidence is 'copy', 'ending', 'terminality' or 'limit' for cut texts, null for whole ones.
    """
    id_type = dict(df.dtypes)["doc_id"]
    base = df.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where(
        F.col("text").rlike(r"(?U)\S")
    )
    fields = (
        f"doc_id {id_type}, source string, length int, k1 bigint, k2 bigint, verdict string, kind string, word string, phrase string, "
        "verdict2 string, kind2 string, word2 string, own int, asked array<bigint>, answers array<bigint>, "
        "counts array<struct<kind:string,word:string,n:bigint,e:bigint>>"
    )
    rows = materialize(spread(base).withColumn("length", F.length("text")).mapInArrow(_reader(band_count()), fields), "endings")
    counted = rows.select(F.explode("counts").alias("c")).groupBy("c.kind", "c.word").agg(F.sum("c.n").alias("n"), F.sum("c.e").alias("e"))
    stats = materialize(counted, "counts")
    bodies = base.mapInArrow(_keyed, "k1 bigint, k2 bigint, text string").select(F.struct("k1", "k2").alias("id"), "text")
    copies = copies_of(rows, bodies)

    # cut markers are learnt from all texts that end with the same phrase
    markers = stats.where((F.col("kind") == "phrase") & (F.col("n") >= LEAST) & (F.col("e") >= MARKED * F.col("n"))).select(F.col("word").alias("phrase"), F.lit(True).alias("marker"))
    slim = rows.select("doc_id", "source", "length", "k1", "k2", "verdict", "kind", "word", "phrase", "verdict2", "kind2", "word2", "own")
    plain, phrased = slim.where("phrase = ''"), slim.where("phrase <> ''").join(markers, "phrase", "left")
    second = phrased.select(
        "doc_id", "source", "length", "k1", "k2", *[F.when(F.col("marker"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("verdict", "kind", "word")], "own"
    )
    closings = plain.select(second.columns).unionByName(second)
    ending = F.when(F.col("verdict") == "cut", "ending")
    decided = closings.where("verdict <> 'unsure'").select("doc_id", "source", "k1", "k2", ending.alias("evidence"), F.lit(False).alias("open"))
    unsure = _terminality(closings.where("verdict = 'unsure'"), stats, field_limits(rows.select("source", "length")))
    judged = decided.unionByName(unsure).withColumn("id", F.struct("k1", "k2")).join(copies, "id", "left")
    evidence = F.when(F.col("copy_cut"), "copy").when(~F.col("open") | F.col("copy_cut").isNull(), F.col("evidence"))
    return judged.select("doc_id", "source", evidence.isNotNull().alias("cut"), evidence.alias("evidence"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _hashed(pa.RecordBatch.from_arrays([b["text"]], names=["text"]) for b in batches):
        yield batch.select(["k1", "k2", "text"])


def _terminality(unsure: DataFrame, stats: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, source, k1, k2, evidence, open): texts without a sure end, judged by closing word and shape."""
    words = stats.where("kind NOT IN ('frame', 'phrase')")
    rare = F.col("n") < LEAST
    usual = words.groupBy(F.col("kind").alias("lines")).agg(
        (F.sum("e") / F.sum("n")).alias("base"),
        F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rare_n"),
        F.sum(F.when(rare, F.col("e")).otherwise(0)).alias("rare_e"),
    )
    first, size = F.substring_index("word", " ", 1), F.substring_index("word", " ", -1).cast("int")
    further = Window.partitionBy(first).orderBy(size.desc())
    frames = stats.where("kind = 'frame'").select(F.col("word").alias("shape"), F.col("e").alias("ended"), F.sum("n").over(further).alias("reached"))
    # a short line has both: its shape, and behind it the closing word
    short = F.col("kind").isin("short", "frame")
    asked = unsure.withColumn("shape", F.when(short, F.substring_index("word", " ", 2)))
    asked = asked.withColumn("word", F.when(short, F.substring_index("word", " ", -1)).otherwise(F.col("word")))
    asked = materialize(asked.withColumn("lines", F.when(short, "short").otherwise(F.col("kind"))), "unsure")
    # begun words: rare closing words with which a known word begins
    heads = words.where(~rare).select("word", F.length("word").alias("size")).distinct()
    heads = heads.select(F.explode(F.expr("transform(sequence(1, size - 1), i -> substring(word, 1, i))")).alias("word")).where("word <> ''")
    wanted = materialize(asked.select("word").distinct(), "closing")
    begun = semi_join_checked(heads, wanted, ["word"]).distinct().withColumn("begun", F.lit(True))
    joined = (
        asked.join(words.select(F.col("kind").alias("lines"), "word", "n", "e"), ["lines", "word"], "left")
        .join(F.broadcast(usual), "lines", "left")
        .join(begun, "word", "left")
        .join(frames, "shape", "left")
        .join(limits.withColumn("at_limit", F.lit(True)), ["source", "length"], "left")
    )
    own = F.col("own")
    known = F.coalesce(F.col("n") - own >= LEAST, F.lit(False))
    n = F.when(known, F.col("n") - own).otherwise(F.greatest(F.col("rare_n") - own, F.lit(0)))
    e = F.when(known, F.col("e") - own).otherwise(F.greatest(F.col("rare_e") - own, F.lit(0)))
    rate = F.coalesce(F.try_divide(e, n), F.lit(1.0))
    base = F.least(F.coalesce("base", F.lit(0.0)), F.lit(1 - 1e-9))
    part = F.when(rate > 0, rate * F.log(rate / base)).otherwise(0.0) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    low = (base > 0) & (rate < TERMINAL * base) & (F.exp(-n * part) < CHANCE)
    bad = F.coalesce(low, F.lit(False)) | (~known & F.coalesce("begun", F.lit(False)))
    shaped = F.when(F.coalesce(F.col("reached") - own >= LEAST, F.lit(False)), (F.col("ended") - own) / (F.col("reached") - own)).otherwise(0.0)
    no_end = (
        F.when(~short, bad)
        # behind much other text a short line is likelier cut, so no significance is asked for
        .when(F.col("kind") == "frame", (shaped < SHAPED) | (known & (rate < FRAMED * base) & (shaped < SURE_SHAPE)))
        .otherwise(bad & (shaped < F.when(known, SURE_SHAPE).otherwise(SHAPED)))
    )
    limit = F.coalesce("at_limit", F.lit(False)) & (rate < base) & (~short | (shaped < SURE_SHAPE))
    evidence = F.when(no_end, "terminality").when(limit, "limit")
    return joined.select("doc_id", "source", "k1", "k2", evidence.alias("evidence"), F.lit(True).alias("open"))


def found(df: DataFrame) -> DataFrame:
    """(doc_id): documents whose text stops before its own end."""
    return judge(df).where("cut").select("doc_id").distinct()


def rates(df: DataFrame) -> DataFrame:
    """(source, texts, cut, rate): how often each source cuts texts; texts that are not blank count."""
    return (
        judge(df)
        .groupBy("source")
        .agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
        .withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))
    )
