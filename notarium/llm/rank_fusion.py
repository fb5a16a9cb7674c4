"""One ranking per query from scores of different scales, by robust rank aggregation.

Scores are replaced by their places, so no score counts for more because of its range. A hit's normalised ranks (place over
the number of values of that score in the query) are sorted; for the k-th of m, the chance that the k-th smallest of m
uniform numbers is no greater comes from the beta distribution (a binomial tail). The least of these chances, times m and at
most 1, is the hit's significance; the ranking goes from the least significance upwards, equal ones share a place.

Hits that must lead are searched among those whose significance is at most what their condition allows at worst (three first
places, the other scores at the end of the upper half), by the same aggregation; the exact condition is checked on these.

Of several rows of one query and hit the one with the latest searched_at counts, then the greatest hit_id. NaN counts as
null; infinite values are ordinary ones. A hit without any score has significance 1. Rows without query_id or point_id are
left out. Ties share a place. Queries with up to `wide` rows are ranked in windows, after one shuffle by query; a query
may hold any share of the rows, as larger ones go through `places`, which cuts wide groups.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.operators.ranking import WIDE_GROUP, places
from notarium.runtime import materialize

SCORES = ("title_score", "keyword_score", "semantic_score", "score", "session_effective_score")


def latest_hits(hits: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(query_id, point_id, scores): one row per query and hit, NaN as null."""
    value = [F.nanvl(F.col(s), F.lit(None).cast("double")).alias(s) for s in scores]
    newest = F.max(F.struct("searched_at", "hit_id", *value)).alias("row")
    rows = hits.where(F.col("query_id").isNotNull() & F.col("point_id").isNotNull())
    return rows.groupBy("query_id", "point_id").agg(newest).select("query_id", "point_id", *[f"row.{s}" for s in scores])


def significance(ranks: Column) -> Column:
    """Corrected minimum of the order statistics' chances for an array of normalised ranks; 1 for an empty array.

    At most len(SCORES) ranks are expected. The array is sorted once, and its values are bound once.
    """

    def tail(r: Column, k: int, m: int) -> Column:
        total = F.lit(0.0)
        for i in range(k, m + 1):
            total = total + F.lit(float(comb(m, i))) * F.pow(r, F.lit(float(i))) * F.pow(1 - r, F.lit(float(m - i)))
        return total

    def least(ordered: Column) -> Column:
        result = F.lit(1.0)
        for m in range(1, len(SCORES) + 1):
            chances = [tail(F.get(ordered, F.lit(k - 1)), k, m) for k in range(1, m + 1)]
            own = chances[0] if m == 1 else F.least(*chances)
            result = F.when(F.size(ordered) == m, F.least(own * m, F.lit(1.0))).otherwise(result)
        return result

    return F.get(F.transform(F.array(F.sort_array(ranks)), least), F.lit(0))


def _evidence(ranked: list[Column], rows: DataFrame) -> DataFrame:
    """Evidence from one struct (place, ties, total) per score, null where the hit has none."""
    own = F.filter(F.array(*ranked), lambda r: r["place"].isNotNull())
    upper = lambda r: r["place"] <= F.ceil(r["total"] / 2)
    first = lambda r: (r["place"] == 1) & (r["ties"] == 1)
    return rows.withColumn("own", own).select(
        "query_id",
        "point_id",
        F.size("own").alias("present"),
        F.size(F.filter("own", first)).alias("firsts"),
        F.size(F.filter("own", upper)).alias("upper"),
        F.transform("own", lambda r: r["place"] / r["total"]).alias("ranks"),
        F.transform("own", lambda r: r["total"]).alias("totals"),
    )


def _narrow(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Evidence of hits in queries that fit a task: one window per score, all over the same partitions."""
    ranked = []
    whole = Window.partitionBy("query_id")
    for s in scores:
        order = whole.orderBy(F.col(s).desc_nulls_last())
        tied = F.coalesce((F.lag(s).over(order) == F.col(s)) | (F.lead(s).over(order) == F.col(s)), F.lit(False))
        # ties are told from single values only, which is all that is asked
        ranked.append(
            F.when(F.col(s).isNotNull(), F.struct(F.rank().over(order).cast("bigint").alias("place"), F.when(tied, 2).otherwise(1).cast("bigint").alias("ties"), F.count(s).over(whole).alias("total")))
        )
    placed = rows.select("query_id", "point_id", *[r.alias(f"r{i}") for i, r in enumerate(ranked)])
    return _evidence([F.col(f"r{i}") for i in range(len(scores))], placed)


def _wide(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Evidence of hits in queries of any size."""
    long = rows.select(
        "query_id",
        "point_id",
        F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(s).alias("value")) for i, s in enumerate(scores)])).alias("s"),
    ).select("query_id", "point_id", "s.which", "s.value")
    ranked = long.join(places(long, ["query_id", "which"], "value"), ["query_id", "which", "value"], "left")
    gathered = ranked.groupBy("query_id", "point_id").agg(F.collect_list(F.struct("place", "ties", "total")).alias("all"))
    return _evidence([F.get("all", F.lit(i)) for i in range(len(scores))], gathered)


def _parts(hits: DataFrame, scores: tuple[str, ...], wide: int) -> tuple[DataFrame, DataFrame | None]:
    """Evidence with significance of the hits of narrow queries, and of wide ones if there are any."""
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > wide)
    large = materialize(sizes.select("query_id"), "wide")
    any_wide = large.limit(1).count() > 0
    small = hits.join(large, "query_id", "left_anti") if any_wide else hits

    def scored(found: DataFrame) -> DataFrame:
        return found.withColumn("significance", significance(F.col("ranks"))).drop("ranks")

    narrow = scored(_narrow(latest_hits(small.repartition("query_id"), scores), scores))
    if not any_wide:
        return narrow, None
    return narrow, scored(_wide(latest_hits(hits.join(large, "query_id", "left_semi"), scores), scores))


def aggregate(hits: DataFrame, scores: tuple[str, ...] = SCORES, wide: int = WIDE_GROUP) -> DataFrame:
    """(query_id, point_id, present, firsts, upper, totals, significance): evidence of every hit.

    present counts its scores, firsts those in which it alone is the greatest of its query, upper those in which its place
    is at most half the number of values, rounded up; totals are the numbers of values of its scores.
    """
    narrow, large = _parts(hits, scores, wide)
    return narrow if large is None else narrow.unionByName(large)


def ranking(hits: DataFrame, scores: tuple[str, ...] = SCORES, wide: int = WIDE_GROUP) -> DataFrame:
    """(query_id, point_id, significance, place): the fused ranking of every query."""
    columns = ["query_id", "point_id", F.round("significance", 12).alias("significance")]
    narrow, large = _parts(hits, scores, wide)
    order = Window.partitionBy("query_id").orderBy("significance")
    out = narrow.select(*columns).withColumn("place", F.rank().over(order).cast("bigint"))
    if large is None:
        return out
    scored = materialize(large.select(*columns), "scored")
    at = places(scored, ["query_id"], "significance", descending=False)
    return out.unionByName(scored.join(at, ["query_id", "significance"]).select("query_id", "point_id", "significance", "place"))


def leaders(hits: DataFrame, scores: tuple[str, ...] = SCORES, wide: int = WIDE_GROUP) -> DataFrame:
    """(query_id, point_id): hits with at least four scores, alone first in at least three, in the upper half in all."""
    found = aggregate(hits, scores, wide)

    def at_worst(totals: Column) -> Column:
        half = F.array_max(F.transform(totals, lambda n: F.ceil(n / 2) / n))
        return F.concat(F.array_repeat(1 / F.array_min(totals), 3), F.array_repeat(half, F.size(totals) - 3))

    bound = F.get(F.transform(F.array(F.col("totals")), lambda totals: significance(at_worst(totals))), F.lit(0))
    candidates = found.where((F.col("present") >= 4) & (F.col("significance") <= bound + 1e-9))
    exact = (F.col("firsts") >= 3) & (F.col("upper") == F.col("present"))
    return candidates.where(exact).select("query_id", "point_id")
