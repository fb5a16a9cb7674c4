"""Places of values within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a group from which its ranking is cut into value ranges.
WIDE_GROUP = 50_000
RANGES = 256


def places(df: DataFrame, keys: list[str], value: str, descending: bool = True, wide: int = WIDE_GROUP) -> DataFrame:
    """(keys, value, place, ties, total): each distinct value's place in its group, one plus the rows before it.

    ties is the number of rows with the value, total the number of rows in the group; null values are left out. Rows are
    counted per distinct value first. A group with more than `wide` distinct values is cut at its quantiles into ranges that
    are ranked on their own and shifted by the rows of the ranges before, so that no group has to fit one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    sign = F.desc if descending else F.asc
    group = counted.groupBy(*keys).agg(F.sum("ties").alias("total"), F.count("*").alias("values"))
    cuts = (
        counted.join(group.where(F.col("values") > wide).select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.array_distinct(
                F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], F.lit(10_000))
            ).alias("cuts")
        )
    )
    ranged = counted.join(cuts, keys, "left").withColumn(
        "range",
        F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(value))), F.lit(0)) * (-1 if descending else 1),
    )
    sums = ranged.groupBy(*keys, "range").agg(F.sum("ties").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(
        *keys, "range", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy(*keys)).alias("total")
    )
    inner = F.sum("ties").over(
        Window.partitionBy(*keys, "range").orderBy(sign(value)).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.select(*keys, value, "ties", "range", F.coalesce(inner, F.lit(0)).alias("inner"))
        .join(offsets, [*keys, "range"])
        .select(*keys, value, (F.col("inner") + F.col("offset") + 1).alias("place"), "ties", "total")
    )
