"""Processing only what is new or changed since the last successful run.

A manifest lists every processed file with its size and checksum, one partition per batch. A run goes in four steps, each of
which is written whole and becomes visible by a rename:

1. Claim. The listing is anti-joined against the manifest, of which the newest row of a file holds, and what is pending is
   written once, under the number of the next batch. Output and manifest come from this table alone, so a listing that grows
   meanwhile can neither slip into the manifest unprocessed nor be processed twice.
2. Work. The output is written under the batch's identifier, over what a broken run of the same batch left.
3. Manifest. The claim's files with size and checksum are staged.
4. Commit. The staged manifest is renamed. Only committed batches count.

A run that finds a claim without a commit repeats exactly that batch; what has changed since is pending in the next one. One
run at a time may write.

A version is known if its checksum equals the newest one and its size does too, where both sizes are known. Files without
collection or path are left out. A null time counts as the earliest, a null checksum differs from every known one and equals
another null. Repeated sightings count once: the greatest time, then the greatest listing id. Empty tables give empty
results; extra columns are ignored. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from notarium.runtime import materialize, scratch

MANIFEST = "collection_id bigint, rel_path string, checksum string, file_size bigint, batch_id string, batch_no bigint"


def checksum(value: Column) -> Column:
    """The hexadecimal digits of a written hash, whatever its case or prefix (sha256:, 0x, ...)."""
    return F.regexp_extract(F.lower(value), r"([0-9a-f]*)\s*$", 1)


def latest_sightings(listing: DataFrame) -> DataFrame:
    """(collection_id, rel_path, checksum, file_size): the latest version of every listed file."""
    row = F.struct("file_mtime", "listing_id", checksum(F.col("file_hash")).alias("checksum"), "file_size")
    return (
        listing.where(F.col("collection_id").isNotNull() & F.col("rel_path").isNotNull())
        .groupBy("collection_id", "rel_path")
        .agg(F.max(row).alias("row"))
        .select("collection_id", "rel_path", "row.checksum", "row.file_size")
    )


def touched_by_failed_run(notes: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids of notes whose updated_at lies in a run that did not succeed.

    Runs are laid out by day, so that the range condition becomes an equality that joins without a broadcast.
    """
    days = (
        runs.where(F.col("started_at").isNotNull() & F.col("last_heartbeat_at").isNotNull())
        .where(~F.col("status").eqNullSafe("succeeded") & (F.col("started_at") <= F.col("last_heartbeat_at")))
        .select(
            "started_at",
            "last_heartbeat_at",
            F.explode(F.sequence(F.to_date("started_at"), F.to_date("last_heartbeat_at"))).alias("day"),
        )
    )
    when = notes.select("id", "updated_at", F.to_date("updated_at").alias("day"))
    inside = (F.col("updated_at") >= F.col("started_at")) & (F.col("updated_at") <= F.col("last_heartbeat_at"))
    return when.alias("n").join(days.alias("r"), (F.col("n.day") == F.col("r.day")) & inside, "left_semi").select("id")


def unembedded_notes(chunks: DataFrame) -> DataFrame:
    """Ids of notes with a chunk whose point id is null or blank."""
    blank = F.coalesce(F.trim("qdrant_point_id"), F.lit("")) == ""
    return chunks.where(blank & F.col("document_id").isNotNull()).select(F.col("document_id").alias("id")).distinct()


def note_states(notes: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(collection_id, rel_path, stored, status, retry, unembedded) of every stored note."""
    slim = notes.where(F.col("collection_id").isNotNull() & F.col("rel_path").isNotNull()).select(
        "id", "collection_id", "rel_path", checksum(F.col("file_hash")).alias("stored"), "status", "updated_at"
    )
    retry = touched_by_failed_run(slim, runs).withColumn("retry", F.lit(True))
    missing = unembedded_notes(chunks).withColumn("unembedded", F.lit(True))
    return slim.join(retry, "id", "left").join(missing, "id", "left").select(
        "collection_id", "rel_path", "stored", "status", F.col("retry").isNotNull().alias("retry"), F.col("unembedded").isNotNull().alias("unembedded")
    )


def stored_manifest(states: DataFrame) -> DataFrame:
    """Manifest of what earlier runs really finished, from the stored notes: (collection_id, rel_path, checksum, file_size).

    The size of what was stored is not known.
    """
    done = ~F.col("retry") & ~F.col("unembedded")
    return states.where(done).select("collection_id", "rel_path", F.col("stored").alias("checksum"), F.lit(None).cast("bigint").alias("file_size"))


def pending_files(latest: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the listing whose current version is not in the manifest, which has one row per file."""
    left, right = latest.alias("l"), manifest.select("collection_id", "rel_path", "checksum", "file_size").alias("m")
    same = (
        (F.col("l.collection_id") == F.col("m.collection_id"))
        & (F.col("l.rel_path") == F.col("m.rel_path"))
        & F.col("l.checksum").eqNullSafe(F.col("m.checksum"))
        & F.coalesce(F.col("l.file_size") == F.col("m.file_size"), F.lit(True))
    )
    return left.join(right, same, "left_anti")


def with_actions(pending: DataFrame, states: DataFrame) -> DataFrame:
    """(collection_id, rel_path, action) of pending files, each with the first reason that holds; no notes that were deleted."""
    joined = pending.join(states, ["collection_id", "rel_path"], "left")
    action = (
        F.when(F.col("retry").isNull(), "new")
        .when(~F.col("checksum").eqNullSafe(F.col("stored")), "changed")
        .when(F.col("retry"), "retry")
        .otherwise("unembedded")
    )
    return joined.where(~F.col("status").eqNullSafe("deleted")).select(
        "collection_id", "rel_path", action.alias("action")
    ).distinct()


def next_actions(listing: DataFrame, notes: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(collection_id, rel_path, action): files that the next run must process.

    One run of an IncrementalJob in a folder of its own: what earlier runs really finished is committed as its first manifest,
    the listing is claimed against it, and the actions are the output of the batch, which is committed in its turn.
    """
    spark = listing.sparkSession
    states = materialize(note_states(notes, runs, chunks), "states")
    job = IncrementalJob(spark, scratch(spark, "incremental"), lambda pending: with_actions(pending, states))
    job.adopt(stored_manifest(states))
    if job.run(listing)[0] is None:
        return spark.createDataFrame([], "collection_id bigint, rel_path string, action string")
    return job.results().select("collection_id", "rel_path", "action")


class IncrementalJob:
    """Runs a transformation over new or changed files only, exactly once per version of a file.

    work(batch) maps the claimed rows (collection_id, rel_path, checksum, file_size) to the output. Claims, output and manifest
    are folders of Parquet with one directory per batch.
    """

    def __init__(self, spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame]):
        self.spark, self.work = spark, work
        self.output, self.manifest_dir, self.claims = f"{folder}/output", f"{folder}/manifest", f"{folder}/claims"

    def _path(self, path: str):
        """The file system of a path, and the path in it."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _publish(self, staged: str, final: str) -> None:
        """Rename a folder that was written whole; one that is there already stays."""
        files, target = self._path(final)
        if not files.exists(target) and not files.rename(self._path(staged)[1], target):
            raise OSError(f"{staged} could not be renamed")

    def _committed(self) -> DataFrame:
        """Manifest rows of all committed batches; those written before batches had numbers come first."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.manifest_dir}/batch_id=*/")
        except AnalysisException:
            rows = self.spark.createDataFrame([], MANIFEST)
        return rows.withColumn("batch_no", F.coalesce("batch_no", F.lit(0)))

    def manifest(self) -> DataFrame:
        """The committed manifest; the last batch of a file holds."""
        row = F.struct("batch_no", "batch_id", "checksum", "file_size")
        last = self._committed().groupBy("collection_id", "rel_path").agg(F.max(row).alias("row"))
        return last.select("collection_id", "rel_path", "row.checksum", "row.file_size", "row.batch_id", "row.batch_no")

    def results(self) -> DataFrame:
        """Output rows of committed batches; of an output with collection_id and rel_path only those of a file's last batch."""
        rows = self.spark.read.option("basePath", self.output).parquet(self.output)
        file = ["collection_id", "rel_path"]
        if set(file) <= set(rows.columns):
            return rows.join(self.manifest().select(*file, "batch_id"), [*file, "batch_id"], "left_semi")
        return rows.join(self._committed().select("batch_id").distinct(), "batch_id", "left_semi")

    def adopt(self, known: DataFrame) -> None:
        """Commit files (collection_id, rel_path, checksum, file_size) that were processed elsewhere, before the first batch."""
        self._commit(known, "b0", 0)

    def _claim(self, listing: DataFrame, number: int) -> DataFrame:
        """The table of what batch `number` processes; an earlier claim of it holds."""
        final = f"{self.claims}/batch_no={number}"
        files, target = self._path(final)
        if not files.exists(target):
            staged = f"{self.claims}/_staged-{number}"
            pending = pending_files(latest_sightings(listing), self.manifest())
            pending.select("collection_id", "rel_path", "checksum", F.col("file_size").cast("bigint").alias("file_size")).write.mode("overwrite").parquet(staged)
            self._publish(staged, final)
        return self.spark.read.schema("collection_id bigint, rel_path string, checksum string, file_size bigint").parquet(final)

    def run(self, listing: DataFrame) -> tuple[str | None, int]:
        """Process what is pending, or what a broken run has claimed; (batch id, files), or (None, 0) if nothing is."""
        number = self._committed().agg(F.coalesce(F.max("batch_no"), F.lit(0))).first()[0] + 1
        claim = self._claim(listing, number)
        n = claim.count()
        if not n:
            self._forget(number)
            return None, 0
        batch = f"b{number}-{n}"
        self.work(claim).write.mode("overwrite").parquet(f"{self.output}/batch_id={batch}")
        self._commit(claim, batch, number)
        return batch, n

    def _forget(self, number: int) -> None:
        """Remove an empty claim, so that the next run looks at the listing again."""
        files, target = self._path(f"{self.claims}/batch_no={number}")
        files.delete(target, True)

    def _commit(self, claim: DataFrame, batch: str, number: int) -> None:
        staged, final = f"{self.manifest_dir}/_staged-{batch}", f"{self.manifest_dir}/batch_id={batch}"
        rows = claim.select("collection_id", "rel_path", "checksum", F.col("file_size").cast("bigint").alias("file_size"))
        rows.withColumns({"batch_id": F.lit(batch), "batch_no": F.lit(number).cast("bigint")}).write.mode("overwrite").parquet(staged)
        self._publish(staged, final)
