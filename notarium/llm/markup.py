"""Clean text from notes that mix Markdown, wiki, HTML and LaTeX markup.

A text is cut into regions first: front matter, fenced code, pre elements, inline code, comments, formulas. Regions keep
their content as it is; everything else is stripped of markup by family, while headings, lists, code blocks, tables and
formulas stay visible in one plain form. Characters that only look like markup (a == b, 3 > 0, $4 to $83, C:\\31, a[9],
#tags) stay.

Both results come from line-block distributions: lengths per line are summed over sliding windows of lines, and a block lies
between the line where the sum surges and the line where it dives.

* Markup. The characters that stripping takes away are summed per family and line; a block of residue is where the sum of a
  family rises from nothing and falls to nothing again. A record has the families of which it has a block.
* Text. What is left after stripping is summed per line, the text of links left out. A block of text surges where the sum
  passes a threshold (a share of the record's densest window) and dives where it falls to a quarter of it. The record's
  content reaches from its first surge to its last dive; code, formulas, and headings that stand right before it belong to it. Lines outside are
  page chrome and are dropped, and so are runs of lines inside that hold links only. Only pages (records with HTML blocks) lose
  lines, as chrome comes with pages; in other notes short lines are headings, lists and tables, which must stay.

A formula ends at its closing mark; an unclosed mark, or one that is closed only behind a blank line, is no formula. Formulas of any
length are kept.

Row by row, in Arrow batches, without a shuffle. Null and empty texts give null or empty text and no family. Very long texts
are handled in whole. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.runtime import spread

CLEANED = "source_table string, record_id bigint, clean_text string, markup array<string>, first_line int, last_line int"
FAMILIES = ("markdown", "wiki", "html", "latex")

#: Element names of HTML, as fixed values.
_TAGS = (
    "a abbr acronym address article aside audio b base big blockquote body br button canvas caption center cite code col "
    "colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 "
    "h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol "
    "optgroup option output p param picture pre progress q s samp script section select small source span strike strong "
    "style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_FRONT = re.compile(r"\A---[ \t]*\n(?:.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_OPEN = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_NAME = r"(?:" + "|".join(_TAGS.split()) + r")"
_TAG = re.compile(rf"</?{_NAME}(?=[\s/>])[^<>]*>", re.I)
_DECLARATION = re.compile(r"<!DOCTYPE[^>]*>|<\?xml[^>]*>|<!\[CDATA\[", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
#: Regions in which nothing else counts, longest first where two begin at one place.
_REGION = re.compile(
    r"(?P<pre><pre(?=[\s>])[^<>]*>.*?(?:</pre\s*>|\Z))"
    r"|(?P<raw><(?P<rawname>script|style)(?=[\s>])[^<>]*>.*?(?:</(?P=rawname)\s*>|\Z))"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<code>(?P<ticks>(?<!`)`+)(?!`)(?:[^\n]|\n(?!\s*\n))+?(?<!`)(?P=ticks)(?!`))"
    r"|(?P<math>(?<![\\$\w])\$(?![\s$])(?:[^$\n\\]|\\.)+?(?<!\s)\$(?![\d$]))",
    re.S | re.I,
)
_TRIGGER = re.compile(r"[<`$\\]")
#: Marks around a formula, and its environments.
_FORMULA = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
_ENVIRONMENT = re.compile(r"\\begin(\{(?:equation|align|gather|multline|displaymath|math|eqnarray)\*?\})")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_COMMAND = re.compile(r"(?<![A-Za-z]:)(?<!\\)\\(?:[A-Za-z]+\*?|[%&$#_{}]|\\|['`^\"~=.](?:\{|(?=[A-Za-z])))")

_HEADING = re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S")
_SETEXT = re.compile(r"(?m)^(?![ \t]*(?:[-=|>*+#\n]|\d+[.)]|$))[^\n]+\n(?:={2,}|-{3,})[ \t]*$")
_LIST = re.compile(r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
_QUOTE = re.compile(r"(?m)^ {0,3}>(?!\s*[\d.]+\))[ \t]?")
_GRID = re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$")
_STRONG = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*])\1(?![\w*])|(?<![\w_\\])(_{1,3})(?![\s_])([^_\n]+?)(?<![\s_])\3(?![\w_])")
_STRIKE = re.compile(r"~~(?![\s~])([^\n]+?)(?<![\s~])~~")
_IMAGE = re.compile(r"!\[([^\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\]\n]*\])")
_LINK = re.compile(r"(?<![\[!\w])\[([^\[\]\n]+)\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ \t]+[\"'(][^\n]*?[\"')])?[ \t]*\)|\[[^\[\]\n]*\])")
_DEFINED = re.compile(r"(?m)^ {0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]+\S+.*$")
_NOTE = re.compile(r"\[\^[^\]\s\[]+\]:?")
_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")

_WIKILINK = re.compile(r"!?\[\[(?!\s*\])([^\[\]\n]+)\]\]")
_TEMPLATE = re.compile(r"\{\{(?=[\s#]*\w)([^{}]*)(?:\}\}|\Z)")
_QUOTES = re.compile(r"'{2,}(?=\S)")
_EQUALS = re.compile(r"(?m)^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$")
_WIKITABLE = re.compile(r"(?m)^[ \t]*\{\|[^\n]*$")
_WIKIEND = re.compile(r"(?m)^[ \t]*\|\}[ \t]*$")


def _fences(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, content begin, content end, end) of fenced code; an open fence runs to the end of the text."""
    if "```" not in text and "~~~" not in text:
        return []
    found, at, mark, begin, inner = [], 0, "", 0, 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if mark:
            if bare and len(bare) >= len(mark) and not bare.strip(mark[0]):
                found.append((begin, inner, at, at + len(line)))
                mark = ""
        elif (opened := _OPEN.match(line)) and not (opened[1][0] == "`" and "`" in opened[2]):
            mark, begin, inner = opened[1], at, at + len(line)
        at += len(line)
    if mark:
        found.append((begin, inner, at, at))
    return found


def _formula_end(text: str, at: int, gone: set[str], blank: list[int]) -> int:
    """End of the formula that begins at a place, -1 if none does.

    gone collects closing marks that do not come again, blank holds the next blank line; so a text is read once.
    """
    mark = text[at : at + 2]
    close, inner = _FORMULA.get(mark), at + 2
    if close is None:
        m = _ENVIRONMENT.match(text, at) if mark == "\\b" else None
        if not m:
            return -1
        close, inner = "\\end" + m[1], m.end()
    if close in gone:
        return -1
    end = text.find(close, inner + (mark in _FORMULA))
    if end < 0:
        gone.add(close)
        return -1
    if mark in _FORMULA:
        if blank[0] < inner:
            m = _BLANK_LINE.search(text, inner)
            blank[0] = m.start() if m else len(text)
        if blank[0] < end:
            return -1
    return end + len(close)


def regions(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with each region replaced by \\x00number\\x00, and (kind, content) of the regions."""
    kept: list[tuple[str, str]] = []
    text = text.replace("\x00", "\ufffd")

    def hide(kind: str, content: str) -> str:
        kept.append((kind, content))
        return f"\x00{len(kept) - 1}\x00"

    parts, at = [], 0
    if front := _FRONT.match(text):
        at = front.end()
        parts.append(hide("front", front[0]))
    base = at
    for begin, inner, end, past in _fences(text[base:]):
        begin, inner, end, past = begin + base, inner + base, end + base, past + base
        parts.append(text[at:begin])
        parts.append(hide("fence", text[inner:end]) + ("\n" if past > end or text[past - 1 : past] == "\n" else ""))
        at = past
    parts.append(text[at:])
    rest = "".join(parts)
    # each region begins with one of four characters; only there the pattern is tried
    parts, at = [], 0
    gone: set[str] = set()
    blank = [-1]
    for trigger in _TRIGGER.finditer(rest):
        begin = trigger.start()
        if begin < at:
            continue
        end = _formula_end(rest, begin, gone, blank) if trigger[0] in "$\\" else -1
        if end >= 0:
            parts.append(rest[at:begin])
            parts.append(hide("math", rest[begin:end]))
            at = end
        elif m := _REGION.match(rest, begin):
            parts.append(rest[at:begin])
            parts.append(hide(next(k for k in ("pre", "raw", "comment", "code", "math") if m[k] is not None), m[0]))
            at = m.end()
    rest = "".join([*parts, rest[at:]])
    return rest, kept


#: Patterns of what stripping takes away, by family; a pattern is tried only where its characters occur.
_RESIDUE = {
    "latex": (("\\", _COMMAND),),
    "html": (("<", _TAG), ("<", _DECLARATION), ("&", _ENTITY)),
    "wiki": (("[[", _WIKILINK), ("{{", _TEMPLATE), ("''", _QUOTES), ("=", _EQUALS), ("{|", _WIKITABLE), ("|}", _WIKIEND)),
    "markdown": (
        ("#", _HEADING), ("", _LIST), (">", _QUOTE), ("](", _LINK), ("][", _LINK), ("![", _IMAGE), ("[^", _NOTE), ("]:", _DEFINED), ("*", _STRONG), ("_", _STRONG),
        ("~~", _STRIKE), ("--", _GRID), ("\n==", _SETEXT), ("\n--", _SETEXT), ("<", _AUTO),
    ),
}
#: Family of the marks around a region.
_REGION_FAMILY = {"fence": "markdown", "code": "markdown", "pre": "html", "raw": "html", "comment": "html", "math": "latex"}
_HIDDEN = re.compile(r"\x00(\d+)\x00")


def residue_lengths(rest: str, kept: list[tuple[str, str]]) -> dict[str, list[tuple[int, int]]]:
    """Per family the (line, characters of markup) of a text's lines that have any, in order."""
    spans: dict[str, list[tuple[int, int]]] = {f: [] for f in FAMILIES}
    for m in _HIDDEN.finditer(rest) if kept else ():
        if family := _REGION_FAMILY.get(kept[int(m[1])][0]):
            spans[family].append((m.start(), 1))
    for family, patterns in _RESIDUE.items():
        done = set()
        for needle, pattern in patterns:
            if needle in rest and pattern not in done:
                done.add(pattern)
                spans[family] += [(m.start(), max(1, m.end() - m.start())) for m in pattern.finditer(rest)]
    breaks = [m.start() for m in re.finditer("\n", rest)] if any(spans.values()) else []
    lines: dict[str, list[tuple[int, int]]] = {}
    for family, own in spans.items():
        sums: dict[int, int] = {}
        for begin, size in own:
            line = bisect.bisect_left(breaks, begin)
            sums[line] = sums.get(line, 0) + size
        lines[family] = sorted(sums.items())
    return lines


def residue_blocks(lengths: list[tuple[int, int]], width: int = 3) -> list[tuple[int, int, int]]:
    """(first line, last line, characters) of the blocks of one family's markup, by the line-block distribution.

    The window sum surges at a line with markup after a window without, and dives where a whole window holds none again.
    """
    blocks: list[tuple[int, int, int]] = []
    for line, size in lengths:
        if blocks and line - blocks[-1][1] <= width:
            blocks[-1] = (blocks[-1][0], line, blocks[-1][2] + size)
        else:
            blocks.append((line, line, size))
    return blocks


_H = re.compile(r"<h([1-6])(?=[\s>])[^<>]*>(.*?)</h\1\s*>", re.I | re.S)
_ITEM = re.compile(r"\s*<li(?=[\s>])[^<>]*>\s*", re.I)
_ANCHOR = re.compile(r"<a(?=[\s>])[^<>]*>([^<>]*)</a\s*>", re.I)
_PAGE = re.compile(r"<(?:html|body|nav|header|footer|main|article|section|aside|div|p|ul|ol|table|h[1-6])(?=[\s/>])", re.I)
_CELL = re.compile(r"</t[dh]\s*>\s*(?=<t[dh])", re.I)
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|div|tr|table|ul|ol|section|article|blockquote|details|summary|header|footer|nav)(?=[\s/>])[^<>]*>", re.I)
_TITLE = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_TITLES = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_ACCENT = re.compile(r"\\(['`^\"~=.])\{?([A-Za-z])\}?")
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_DROPPED = re.compile(r"~?\\(?:label|ref|eqref|cite[a-z]*|documentclass|usepackage|begin|end|index|pageref)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*")
_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_BARE = re.compile(r"\\(?:ldots|dots)\b")
_WORDLESS = re.compile(r"(?<![A-Za-z]:)\\[A-Za-z]+\*?[ \t]?")


def _together(text: str) -> str:
    """The text without blank lines between two rows of a table."""
    if "\t" not in text:
        return text
    out: list[str] = []
    for line in text.split("\n"):
        if "\t" in line.strip():
            while len(out) > 1 and not out[-1].strip():
                at = len(out) - 1
                while at and not out[at].strip():
                    at -= 1
                if "\t" not in out[at].strip():
                    break
                del out[at + 1 :]
        out.append(line)
    return "\n".join(out)


def _plain_line_markup(text: str) -> str:
    """Markup of all families but code and formulas, replaced by plain text."""
    if "{|" in text or "|}" in text or "\n|" in text:
        text = _WIKITABLE.sub("", _WIKIEND.sub("", text))
        text = re.sub(r"(?m)^\|-[^\n]*$\n?", "", text)
        text = re.sub(r"(?m)^[|!](?![|}-])[ \t]*([^\n]*?)[ \t]*\|?[ \t]*$", lambda m: m[1].replace("||", "\t").replace(" | ", "\t"), text)
        text = _GRID.sub("", text)
    if "<" in text:
        text = _DECLARATION.sub("", text)
        text = _H.sub(lambda m: f"\n{'#' * int(m[1])} {' '.join(_TAG.sub('', m[2]).split())}\n", text)
        text = _AUTO.sub(r"\1", text)
        text = _CELL.sub("\t", _ITEM.sub("\n- ", text))
        text = _ANCHOR.sub("\x01\\1\x02", text)
        text = _together(_TAG.sub("", _BREAK.sub("\n", text)))
    if "\\\\" in text and "&" in text:
        text = _TABULAR.sub(lambda m: re.sub(r"[ \t]*(?<!\\)&[ \t]*", "\t", m[1]).rstrip(), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "\\" in text:
        text = _TITLE.sub(lambda m: f"{'#' * _TITLES[m[1]]} {m[2]}", text)
        text = _ACCENT.sub(lambda m: m[2] + _ACCENTS[m[1]], text)
        text = _BARE.sub("…", text)
        text = text.replace("\\item ", "- ")
        text = _DROPPED.sub("", text)
        for _ in range(3):
            text, n = _ARGUMENT.subn(r"\1", text)
            if not n:
                break
        text = re.sub(r"[ \t]*\\\\[ \t]*(?=\n|$)", "", text)
        text = re.sub(r"\\([%&$#_{}*\[\]~`])", r"\1", text)
        text = _WORDLESS.sub("", text)
    if "=" in text:
        text = _EQUALS.sub(lambda m: f"{'#' * len(m[1])} {m[2]}", text)
        text = re.sub(r"(?m)^(?![ \t]*$)([^\n]+)\n={2,}[ \t]*$", r"# \1", text)
    if "\n--" in text:
        text = re.sub(r"(?m)^(?![ \t]*(?:[-=|>*+#]|$))([^\n]+)\n-{3,}[ \t]*$", r"## \1", text)
    if "{{" in text:
        for _ in range(3):
            text, n = _TEMPLATE.subn(lambda m: m[1].split("|")[0].strip() if "|" not in m[1] else "", text)
            if not n:
                break
    if "[" in text:
        text = _WIKILINK.sub(lambda m: "" if m[0][0] == "!" else m[1].split("|")[-1].split("#")[0] or m[1].strip("#"), text)
        text = _DEFINED.sub("", _NOTE.sub("", _LINK.sub("\x01\\1\x02", _IMAGE.sub(r"\1", text))))
        text = re.sub(r"(?m)^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+", r"\1- ", text)
    text = re.sub(r"(?m)^([ \t]*)[*+][ \t]+(?=\S)", r"\1- ", text)
    text = re.sub(r"(?m)^ {0,3}>[ \t]?(?:\[![a-z]+\][ \t]*)?", "", text)
    if "''" in text:
        text = re.sub(r"'{2,}", "", text)
    if "*" in text or "_" in text:
        text = _STRONG.sub(lambda m: m[2] or m[4], text)
    return _STRIKE.sub(r"\1", text)


_LINKED = re.compile(r"\x01([^\x01\x02]*)\x02")
_HEAD_LINE = re.compile(r"(?:\x00\d+\x00)?#{1,6} ")
#: A field of a box, and a row of a LaTeX table.
_FIELD = re.compile(r"\s*\w[\w ]{0,30}[ \t]=[ \t]\S")
_TABULAR = re.compile(r"(?m)^([^\n&]*(?:(?<!\\)&[^\n&]*)+?)\\\\[ \t]*$")
#: Lines without a heading that a heading may stand above the content.
NEAR = 3
#: Least length of a row of a table or box.
ROW = 20


def line_lengths(lines: list[str], kept: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """Characters of each line without white space: of its text outside links, and of its links. Regions count with their content."""
    text, links = [], []
    for line in lines:
        linked = sum(len("".join(m[1].split())) for m in _LINKED.finditer(line)) if "\x01" in line else 0
        bare = _LINKED.sub("", line) if linked else line
        size = 0
        for m in _HIDDEN.finditer(bare) if "\x00" in bare else ():
            kind, content = kept[int(m[1])]
            size += len("".join(content.split())) if kind in ("fence", "pre", "code", "math") else 0
        own = "".join(_HIDDEN.sub("", bare).split())
        # marks of lists and separators between links are no text
        length = len(own.strip("-|•·>#/"))
        text.append(size + (max(length, ROW) if length and ("\t" in bare.strip() or _FIELD.match(bare)) else length))
        links.append(linked)
    return text, links


def text_blocks(lengths: list[int], width: int = 3, share: float = 0.2, most: int = 48) -> list[tuple[int, int]]:
    """(first, last) lines of the blocks of text, by the line-block distribution.

    Window i sums the lengths of lines i to i + width - 1. A block surges where the sum passes the threshold, a share of the
    densest window and at most `most`, and dives where it falls to a quarter of the threshold; short lines at its rim, with
    less than a line's part of the threshold, do not belong to it.
    """
    sums, running = [], sum(lengths[: width - 1])
    for i in range(len(lengths)):
        running += lengths[i + width - 1] if i + width - 1 < len(lengths) else 0
        sums.append(running)
        running -= lengths[i]
    if not sums or not max(sums):
        return []
    threshold = min(share * max(sums), most)
    blocks, begin = [], -1
    for i, total in enumerate([*sums, 0]):
        if begin < 0 and total > threshold:
            begin = i
        elif begin >= 0 and total <= threshold / 4:
            # sums of windows from i on are low: the text ends before line i
            first, last = begin, i - 1
            while first < last and lengths[first] <= threshold / width:
                first += 1
            while last > first and lengths[last] <= threshold / width:
                last -= 1
            blocks.append((first, last))
            begin = -1
    return blocks


def content_lines(lines: list[str], kept: list[tuple[str, str]]) -> list[bool]:
    """Which lines of a stripped page belong to its content; see the module."""
    text, links = line_lengths(lines, kept)
    blocks = text_blocks(text)
    if not blocks:
        return [True] * len(lines)
    first, last = blocks[0][0], blocks[-1][1]
    # code and formulas are content, however short
    for i, line in enumerate(lines):
        if "\x00" in line and any(kept[int(m[1])][0] in ("fence", "pre", "math") for m in _HIDDEN.finditer(line)):
            first, last = min(first, i), max(last, i)
    # headings right before the content
    at, passed = first - 1, 0
    while at >= 0 and passed < NEAR:
        if _HEAD_LINE.match(lines[at]):
            first, passed = at, 0
        elif lines[at].strip():
            passed += 1
        at -= 1
    # a paragraph ends with its last line, however short
    while last + 1 < len(lines) and lines[last + 1].strip() and lines[last].strip() and not re.match(r"\s*(?:- |\d+[.)] |#)", lines[last + 1]):
        last += 1
    keep = [first <= i <= last for i in range(len(lines))]
    # runs of lines that hold links only
    run: list[int] = []
    for i in range(first, last + 2):
        if i <= last and links[i] and text[i] * 4 <= links[i]:
            run.append(i)
        elif i > last or lines[i].strip():
            if len(run) >= 3:
                for j in run:
                    keep[j] = False
            run = []
    return keep


def clean(text: str | None) -> tuple[str | None, list[str], int, int]:
    """Clean text, families of markup, and the first and last kept line of the stripped text."""
    if text is None:
        return None, [], 0, 0
    rest, kept = regions(text.replace("\x01", "\ufffd").replace("\x02", "\ufffd"))
    lengths = residue_lengths(rest, kept)
    found = [f for f in FAMILIES if residue_blocks(lengths[f])]
    page = "html" in found and bool(_PAGE.search(rest))
    if found or kept:
        rest = _plain_line_markup(rest)
    lines = rest.split("\n")
    keep = content_lines(lines, kept) if page else [True] * len(lines)
    numbers = [i for i, (line, k) in enumerate(zip(lines, keep)) if k and line.strip()]
    out = "\n".join(line.rstrip() for line, k in zip(lines, keep) if k or not line.strip())
    out = out.replace("\x01", "").replace("\x02", "")

    def show(m: re.Match) -> str:
        kind, content = kept[int(m[1])]
        if kind in ("front", "raw", "comment"):
            return ""
        if kind == "fence":
            return f"```\n{content.rstrip()}\n```"
        if kind == "pre":
            return f"```\n{html.unescape(_TAG.sub('', content)).strip()}\n```"
        return content.strip("`").strip() if kind == "code" else content

    out = _HIDDEN.sub(show, out)
    return re.sub(r"\n{3,}", "\n\n", out).strip(), found, (numbers or [0])[0], (numbers or [0])[-1]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [clean(t) for t in batch["text"].to_pylist()]
        texts, found, first, last = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch["source_table"],
                batch["record_id"],
                pa.array(texts, pa.string()),
                pa.array(found, pa.list_(pa.string())),
                pa.array(first, pa.int32()),
                pa.array(last, pa.int32()),
            ],
            names=["source_table", "record_id", "clean_text", "markup", "first_line", "last_line"],
        )


def strip_markup(df: DataFrame) -> DataFrame:
    """Rows (see CLEANED) for rows (source_table, record_id, text)."""
    rows = df.select("source_table", F.col("record_id").cast("bigint").alias("record_id"), "text")
    return spread(rows).mapInArrow(_run, CLEANED)


def found_families(df: DataFrame) -> DataFrame:
    """(source_table, record_id, markup): one row per record and family."""
    return strip_markup(df).select("source_table", "record_id", F.explode("markup").alias("markup")).distinct()
