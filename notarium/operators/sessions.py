"""Down-ranking of agent sessions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.functions.text import clean_path

#: Fixed word lists.
STOP = (
    "about again also and are because been being but can could does from have into like more need notes only over should that "
    "the their them then there this those use with would your"
).split()
NOISE = (
    "agent assistant chatter continue generic housekeeping log logs raw run session status transcript unrelated update updates"
).split()
EVIDENCE = (
    "bug debug decision evidence failure fix handoff implementation receipt result root summary test tested trace verification"
).split()
MARKERS = ("chat", "chats", "run", "runs", "session", "sessions")
PREFIX = "88_Agents/sessions/"


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def is_session(path: Column) -> Column:
    """Whether a path lies under the sessions folder."""
    return F.startswith(clean_path(path), F.lit(PREFIX))


def terms(text: Column) -> Column:
    """Distinct words of three or more characters without stop words; _ and - separate."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]+", " ")
    return F.array_except(F.array_distinct(F.regexp_extract_all(spaced, F.lit("[a-z0-9][a-z0-9]{2,}"), F.lit(0))), _list(STOP))


def overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's terms that the candidate has, over three terms at least; 0 if either is empty."""
    both = F.size(F.array_intersect(query, candidate)) / F.greatest(F.lit(3), F.size(query))
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), 0.0).otherwise(both)


def recency(text: Column, as_of: str | None) -> Column:
    """Factor from the first date in a path or title, on the given day, or today."""
    rx = r"(20\d{2})[-_/](\d{2})[-_/](\d{2})"
    day = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(text, rx, i) for i in (1, 2, 3)]), "yyyy-MM-dd")
    age = F.date_diff(F.lit(as_of).cast("date") if as_of else F.current_date(), day)
    return F.when(day.isNull(), 1.0).when(age < 0, 0.98).when(age <= 14, 1.08).when(age <= 90, 1.04).when(age <= 365, 1.0).otherwise(0.94)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def with_factor(rows: DataFrame, as_of: str | None, penalty: float = 0.65) -> DataFrame:
    """rows with `factor`, from 0.10 to 0.95 for a session hit: what it shares with the query, against noise, length,
    evidence and age.

    rows has query_text, rel_path, title, text, lanes (array) and placed (whether the hit has a chunk index or start line).
    Term sets are columns of their own, so that each is built once per row.
    """
    path = clean_path(F.col("rel_path"))
    own = rows.withColumns(
        {
            "_q": terms(F.col("query_text")),
            "_t": terms(F.col("title")),
            "_p": terms(F.replace(path, F.lit("/"), F.lit(" "))),
            "_b": terms(F.col("text")),
        }
    )
    own = own.withColumn("_all", F.array_union(F.array_union("_t", "_p"), "_b"))
    q = F.col("_q")
    lane = F.when(F.array_contains(F.coalesce("lanes", F.array().cast("array<string>")), "keyword"), 0.08).otherwise(0.0)
    shared = 0.45 * overlap(q, F.col("_b")) + 0.35 * overlap(q, F.col("_t")) + 0.20 * overlap(q, F.col("_p")) + lane
    own = own.withColumns(
        {
            "_specific": _clamp(shared, 0.0, 1.0),
            "_noise": F.size(F.array_except(F.array_intersect(_list(NOISE), "_all"), "_q")),
            "_shown": F.size(F.array_intersect(_list(EVIDENCE), "_all")),
            "_age": recency(F.concat_ws(" ", path, "title"), as_of),
            "_length": F.length(F.coalesce("text", F.lit(""))),
        }
    )
    length, specific, noise = F.col("_length"), F.col("_specific"), F.col("_noise")
    generic = _clamp(noise / 8.0, 0.0, 1.0)
    size = F.when((length > 0) & (length <= 1800), 0.06).when(length >= 5000, -0.15).otherwise(0.0)
    focus = _clamp(1.0 + size + F.when(F.col("placed"), 0.04).otherwise(0.0), 0.75, 1.12)
    evidence = _clamp(1.0 + 0.035 * F.col("_shown") - 0.04 * noise, 0.78, 1.18)
    base = min(max(penalty, 0.05), 0.95)
    by_share = F.when(specific < 0.12, 0.42 + specific).otherwise(0.76 + 0.48 * specific)
    factor = base * by_share * focus * evidence * F.col("_age") * (1.0 - 0.35 * generic)
    factor = F.when((specific >= 0.60) & (generic <= 0.30), F.greatest(factor, F.lit(min(0.95, base + 0.12)))).otherwise(factor)
    return own.withColumn("factor", F.round(_clamp(factor, 0.10, 0.95), 6)).select(*rows.columns, "factor")


def apply_policy(rows: DataFrame, policy: str = "penalize", most: int = 1, tie: str = "record_id") -> DataFrame:
    """rows (query_id, rel_path, score, factor) with effective_score and place.

    exclude drops sessions; include keeps them as they are; penalize multiplies a session's score by its factor, sorts again
    by score and path, and keeps the first `most` sessions of a query. Without penalties the order of the column rank holds,
    if there is one.
    """
    session = is_session(F.col("rel_path"))
    if policy == "exclude":
        rows = rows.where(~session)
    effective = F.when(session, F.round(F.col("score") * F.col("factor"), 9)).otherwise(F.col("score")) if policy == "penalize" else F.col("score")
    ranked = rows.withColumn("effective_score", effective)
    w = Window.partitionBy("query_id").orderBy(F.desc("effective_score"), "rel_path", tie)
    if policy != "penalize" and "rank" in rows.columns:
        w = Window.partitionBy("query_id").orderBy("rank")
    if policy == "penalize":
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumn("_seen", F.sum(session.cast("int")).over(upto)).where(~session | (F.col("_seen") <= most)).drop("_seen")
    return ranked.withColumn("place", F.row_number().over(w))


def session_prefix(path: Column) -> Column:
    """The path up to its first session folder (a marker or a date), or the parent of a dated leaf; else null."""
    parts = F.split(clean_path(path), "/")
    dated = r"^\d{4}-\d{2}-\d{2}"
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.filter(
        F.transform(inner, lambda x, i: F.when(F.lower(x).isin(*MARKERS) | x.rlike(dated), i + 1)), lambda i: i.isNotNull()
    )
    leaf = F.get(parts, F.size(parts) - 1)
    return F.when(
        F.size(parts) >= 2,
        F.when(F.size(at) > 0, F.array_join(F.slice(parts, 1, F.get(at, F.lit(0))), "/")).when(
            leaf.rlike(dated), F.array_join(inner, "/")
        ),
    )
