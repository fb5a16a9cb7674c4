"""Column expressions on text: cleaning, tokens, estimates, paths, names and identifiers.

All of them are null in, null out unless stated, and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of plain tokens: runs of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
#: Fixed bytes of the URL namespace of name-based identifiers.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def simple_tokens(text: Column) -> Column:
    """Lower-case tokens in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space; an empty array for null or blank."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def snippet(text: Column, most: int = 24) -> Column:
    """The first words of a text, with ' ...' if there are more."""
    own = words(text)
    return F.when(F.size(own) <= most, F.array_join(own, " ")).otherwise(
        F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit(" ..."))
    )


def clean_nul(text: Column) -> Column:
    """NUL characters replaced by the replacement character."""
    return F.translate(text, "\x00", "�")


def json_safe(value: Column) -> Column:
    """A struct, map or array as JSON, NUL characters at any depth replaced by the replacement character."""
    return F.regexp_replace(F.to_json(value), r"(?<!\\)((?:\\\\)*)\\u0000", "$1\ufffd")


def content_hash(text: Column) -> Column:
    """SHA-256 of the cleaned text."""
    return F.sha2(clean_nul(text), 256)


def stable_hash(*parts: Column) -> Column:
    """MD5 over the parts, one per line; null parts are left out."""
    return F.md5(F.concat_ws("\n", *parts))


def embedding_tokens(text: Column) -> Column:
    """Estimated tokens: a third of each word's characters, two at least, and a third of all; 1 for empty text."""
    clean = collapsed(text)
    by_word = F.aggregate(
        words(text), F.lit(0), lambda total, w: total + F.greatest(F.lit(2), F.floor((F.length(w) + 2) / 3).cast("int"))
    )
    return F.greatest(F.lit(1), by_word, F.floor((F.length(clean) + 2) / 3).cast("int"))


def bounded_text(text: Column, most: int = 6000) -> Column:
    """The longest prefix of whole words within `most` estimated tokens; the first 3 * most characters if no word fits."""
    clean = collapsed(text)

    def add(state: Column, w: Column) -> Column:
        used = state["used"] + F.greatest(F.lit(2), F.floor((F.length(w) + 2) / 3).cast("int"))
        chars = state["chars"] + F.when(state["kept"] > 0, 1).otherwise(0) + F.length(w)
        fits = ~state["full"] & (F.greatest(used, F.floor((chars + 2) / 3).cast("int")) <= most)
        return F.struct(
            F.when(fits, used).otherwise(state["used"]).alias("used"),
            F.when(fits, chars).otherwise(state["chars"]).alias("chars"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
            (~fits).alias("full"),
        )

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("chars"), F.lit(0).alias("kept"), F.lit(False).alias("full"))
    kept = F.aggregate(words(text), start, add, lambda s: s["chars"])
    return F.when(embedding_tokens(text) <= most, clean).otherwise(
        F.when(kept > 0, F.substring(clean, F.lit(1), kept)).otherwise(F.trim(F.substring(clean, 1, 3 * most)))
    )


def _prose_counts(text: Column) -> tuple[Column, Column]:
    """Words and punctuation marks of a text."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b")), F.regexp_count(text, F.lit(r"(?U)[^\w\s]"))


def _prose_size(words_: Column, marks: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words_ * F.lit(1.35) + marks * F.lit(0.35)).cast("int"))


def prose_tokens(text: Column) -> Column:
    """Second estimate: 1.35 per word and 0.35 per punctuation mark, rounded up, 1 at least."""
    return _prose_size(*_prose_counts(F.coalesce(text, F.lit(""))))


def truncated_prose(text: Column, most: int) -> Column:
    """The text if its second estimate is within most, else its first words as long as they stay under it; null as ''."""
    own = F.coalesce(text, F.lit(""))

    def add(state: Column, word: Column) -> Column:
        w, m = _prose_counts(word)
        w, m = state["w"] + w, state["m"] + m
        fits = ~state["full"] & (_prose_size(w, m) < most)
        return F.struct(
            F.when(fits, w).otherwise(state["w"]).alias("w"), F.when(fits, m).otherwise(state["m"]).alias("m"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"), (~fits).alias("full"),
        )

    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("m"), F.lit(0).alias("kept"), F.lit(False).alias("full"))
    kept = F.aggregate(words(own), start, add, lambda s: s["kept"])
    return F.when(prose_tokens(own) <= most, own).otherwise(F.array_join(F.slice(words(own), F.lit(1), kept), " "))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, at most 80 characters; 'untitled' if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s_-]", ""), r"[\s_]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(base, r"-+", "-"), 1, 80), r"^-+|-+$", "")
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


#: Names whose values are secret. A name may be quoted, and so may the value: in JSON, YAML, assignments and addresses.
SECRET_NAMES = r"(?:api[_-]?key|access[_-]?key|token|password|passwd|secret|authorization)"
#: A bare value: up to white space, a comma, a quote or a bracket.
_BARE = r"[^\s,;&}\])\"'<]+"


def redacted(text: Column) -> Column:
    """Bearer tokens, values of secret names (quoted or not) and keys with the usual prefix replaced; names and quotes stay."""
    out = F.regexp_replace(text, r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1<redacted>")
    name = rf"(?i)(\\?[\"']?\b[\w-]*{SECRET_NAMES}\\?[\"']?\s*[=:]\s*\\?)"
    # a scheme word before a token that was replaced already is no secret
    out = F.regexp_replace(out, name + r"(?!\"?'?Bearer\s)([\"'])(?:(?!\2)[^\\]|\\.)*(\2?)", "$1$2<redacted>$3")
    out = F.regexp_replace(out, name + r"(?!Bearer\s)" + _BARE, "$1<redacted>")
    return F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{8,}", "<redacted>")


def clean_path(path: Column) -> Column:
    """Forward slashes, none at the ends; null as ''."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def identifier_variants(path: Column) -> Column:
    """The identifier with and without .md."""
    bare = F.regexp_replace(path, r"\.md$", "")
    return F.array_distinct(F.array(path, F.when(F.endswith(path, F.lit(".md")), bare).otherwise(F.concat(path, F.lit(".md")))))


#: Path parts and markers of imported text, as fixed values.
IMPORTED = (
    "article articles blog blogs clipping clippings import imported libraries library readwise resource resources source "
    "sources text texts"
).split()


def source_class(path: Column, compat: bool = False) -> Column:
    """agent_session, agent_workspace, imported_text or vault_note.

    Markers are matched as path words; with compat also as substrings.
    """
    p = clean_path(path)
    parts = F.split(F.lower(p), r"[/ ._-]+")
    marked = F.arrays_overlap(parts, F.array(*[F.lit(m) for m in IMPORTED]))
    if compat:
        marked = marked | F.lower(p).rlike("|".join(IMPORTED))
    return (
        F.when(F.startswith(p, F.lit("88_Agents/sessions/")), "agent_session")
        .when(F.startswith(p, F.lit("14_Agent_Workspace/")), "agent_workspace")
        .when(marked, "imported_text")
        .otherwise("vault_note")
    )


def name_uuid(name: Column) -> Column:
    """Name-based (version 5) identifier in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def finite(vector: Column) -> Column:
    """Numbers that are not finite as 0."""
    return F.transform(
        vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double"))
    )


def json_object(text: Column) -> Column:
    """The outermost {...} of noisy model output, if it parses; else null."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def frontmatter_block(text: Column) -> Column:
    """Text between the leading --- lines; '' if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A---\n(.*?)\n---\n?", 1)


def body_of(text: Column) -> Column:
    """The text behind the front matter."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def derived_title(title: Column, name: Column, body: Column, path: Column) -> Column:
    """Front matter title, its name, the first line (its heading text, or 120 characters), or the file's stem."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    first = F.trim(F.get(lines, F.lit(0)))
    heading = F.when(F.startswith(first, F.lit("# ")), F.trim(F.substring(first, 3, 100_000))).otherwise(F.substring(first, 1, 120))
    given = [F.when(F.trim(c) != "", F.trim(c)) for c in (title, name)]
    return F.coalesce(*given, F.when(heading != "", heading), stem_of(path))


def workspace_title(text: Column, path: Column) -> Column:
    """The first heading of level one, or the file's stem in words with capitals."""
    heading = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^# +(\S.*)$", 1))
    return F.when(heading != "", heading).otherwise(F.initcap(F.regexp_replace(stem_of(path), "[-_]+", " ")))


def normal_topics(topics: Column) -> Column:
    """Topics in lower case without blanks around, each once, blank ones left out."""
    return F.array_distinct(F.filter(F.transform(topics, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def target_parts(target: Column) -> Column:
    """Collection and path of an address such as scheme://collection/path; null without a scheme."""
    rx = r"^[A-Za-z]+://([^/]+)/?(.*)$"
    return F.when(
        target.rlike(rx),
        F.struct(F.regexp_extract(target, rx, 1).alias("collection"), F.regexp_extract(target, rx, 2).alias("path")),
    )


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern in which * also crosses slashes."""
    out = ""
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "/_- " else "\\" + c
        i += 1
    return f"^(?s:{out})$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether any shell pattern matches the path."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for glob in globs:
        hit = hit | slashed.rlike(glob_pattern(glob))
    return hit


def matches_prefix(path: Column, prefixes: list[str]) -> Column:
    """Whether the path begins with any of the prefixes; an empty list matches all."""
    hit = F.lit(not prefixes)
    for prefix in prefixes:
        hit = hit | F.startswith(path, F.lit(prefix))
    return hit
