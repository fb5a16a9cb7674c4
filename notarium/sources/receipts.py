"""Append-only receipts of writes, partitioned by day, without secrets."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.functions.text import redacted


def operation_id(operation: str, path: str, now: datetime) -> str:
    """Identifier of one write, from its time, kind and path."""
    return f"{now:%Y%m%dT%H%M%S}-{hashlib.sha256(f'{operation}|{path}|{now.isoformat()}'.encode()).hexdigest()[:12]}"


def append(rows: DataFrame, folder: str) -> None:
    """Append rows (at, ...) as JSON, with secrets taken out of every text column."""
    clean = rows.withColumns({c: redacted(F.col(c)) for c, kind in rows.dtypes if kind == "string"})
    clean.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(folder)
