"""Statistics over chunks and the whole store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TOKENS, TARGET_TOKENS, MAX_TOKENS = 120, 220, 320


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; 0 if whole is not positive."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(0.0)


def chunk_summary(chunks: DataFrame, lowest: int = MIN_TOKENS, highest: int = MAX_TOKENS) -> DataFrame:
    """One row of counts, lengths and percentiles of token_count; exact percentiles come from a count per value."""
    shares = (0.5, 0.75, 0.9, 0.95, 0.99)
    t = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_distinct("document_id").alias("documents"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        F.round(F.avg(t), 2).alias("avg_tokens"),
        *[F.round(F.percentile(t, p), 6).alias(f"p{int(p * 100)}_tokens") for p in shares],
        F.sum(t).alias("total_tokens"),
        F.sum("char_count").alias("total_chars"),
        F.count_if(t > highest).alias("over_max_chunks"),
        F.count_if(t < lowest).alias("under_min_chunks"),
        F.count_if("embedded").alias("embedded_chunks"),
    )


def bucket(tokens: Column, lowest: int = MIN_TOKENS, target: int = TARGET_TOKENS, highest: int = MAX_TOKENS) -> Column:
    """Name of the length bucket."""
    return (
        F.when(tokens < lowest, "under_min")
        .when(tokens <= target, "min_to_target")
        .when(tokens <= highest, "target_to_max")
        .when(tokens <= 2 * highest, "max_to_double")
        .otherwise("over_double")
    )


def chunk_buckets(chunks: DataFrame) -> DataFrame:
    """(bucket, chunks, shortest): a histogram."""
    return chunks.groupBy(bucket(F.col("token_count")).alias("bucket")).agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("shortest")
    )


def health(summary: DataFrame, highest: int = MAX_TOKENS) -> DataFrame:
    """The summary with over_pct, under_pct and an assessment: no_chunks, too_long, too_short or healthy."""
    over, under = percent(F.col("over_max_chunks"), F.col("chunks")), percent(F.col("under_min_chunks"), F.col("chunks"))
    verdict = (
        F.when(F.col("chunks") == 0, "no_chunks")
        .when((F.col("p95_tokens") > highest) | (over > 10) | (F.col("max_tokens") > 3 * highest), "too_long")
        .when(under > 45, "too_short")
        .otherwise("healthy")
    )
    return summary.withColumn("over_pct", over).withColumn("under_pct", under).withColumn("assessment", verdict)


def longest_chunks(chunks: DataFrame, notes: DataFrame, sample: int = 12) -> DataFrame:
    """The longest chunks, by tokens, path and index; the sample is at least 1 and at most 100."""
    top = max(1, min(sample, 100))
    return (
        chunks.join(notes.select(F.col("id").alias("document_id"), "rel_path"), "document_id")
        .select("id", "rel_path", "chunk_index", "token_count", "char_count")
        .orderBy(F.desc("token_count"), "rel_path", "chunk_index", "id")
        .limit(top)
    )
