"""Session helpers: the shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the small side up to which a join may broadcast it after counting it.
BROADCAST_ROWS = 500_000

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: spark.checkpoint.dir, or a local one where it is unset and the session is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="notarium-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/notarium-{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    It cuts the lineage, keeps the columns typed and compressed, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            pass


def semi_join_checked(big: DataFrame, keys: DataFrame, on: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of big whose key is in keys; keys are broadcast only if they are at most bound rows, else both sides shuffle.

    keys must be cheap to count (a materialized table).
    """
    few = keys.limit(bound + 1).count() <= bound
    return big.join(F.broadcast(keys) if few else keys, on, "left_semi")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition an input that has fewer splits than the session has task slots; larger inputs stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key) if key else df.repartition(slots)
