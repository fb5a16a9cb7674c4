"""A store of Parquet snapshots: every write makes a new version, and a pointer file is swapped last.

Readers see the version that the pointer names, so a run that breaks off leaves the store as it was; the pointer is renamed over
the old one, so a reader always finds one. A writer of a table holds a lock file in the table's folder, made by the file
system of the store, so writers on different machines keep apart; a lock that is older than the stale limit is taken over.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Tables under one folder; names are table names, versions are numbers."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._held: set[str] = set()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self, name: str) -> int | None:
        """The committed version of a table, or None."""
        fs, pointer = self._fs(f"{self.folder}/{name}/CURRENT")
        if not fs.exists(pointer):
            return None
        return int(self.spark.read.text(str(pointer)).first()[0])

    def read(self, name: str) -> DataFrame:
        """The committed version; LookupError if there is none."""
        version = self.version(name)
        if version is None:
            raise LookupError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/v{version}")

    @contextmanager
    def lock(self, name: str, timeout: float = 300.0, stale: float = 21_600.0, poll: float = 0.25, clock: Callable[[], float] = time.time) -> Iterator[None]:
        """Hold the table's lock; TimeoutError if another writer keeps it. A writer that holds it may take it again."""
        if name in self._held:
            yield
            return
        files, path = self._fs(f"{self.folder}/{name}/LOCK")
        token, end = uuid.uuid4().hex, clock() + timeout
        while not self._try_lock(files, path, f"{token} {clock()}"):
            held = self._lock_text(files, path)
            if held and clock() - float(held.split()[1]) > stale:
                files.delete(path, False)
            elif clock() >= end:
                raise TimeoutError(f"another writer holds {name}")
            else:
                time.sleep(poll)
        self._held.add(name)
        try:
            yield
        finally:
            self._held.discard(name)
            if self._lock_text(files, path).startswith(token):
                files.delete(path, False)

    @staticmethod
    def _try_lock(files, path, text: str) -> bool:
        try:
            out = files.create(path, False)
        except Py4JJavaError as fault:
            if "AlreadyExists" in str(fault.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _lock_text(self, files, path) -> str:
        if not files.exists(path):
            return ""
        rows = self.spark.read.text(str(path)).collect()  # one short line
        return rows[0][0] if rows else ""

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, max_records: int = 0) -> int:
        """Write df as the next version and make it current, under the table's lock; returns the version."""
        with self.lock(name):
            version = (self.version(name) or 0) + 1
            writer = df.write.mode("overwrite")
            if max_records:
                writer = writer.option("maxRecordsPerFile", max_records)
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(f"{self.folder}/{name}/v{version}")
            fs, pointer = self._fs(f"{self.folder}/{name}/CURRENT")
            _, staged = self._fs(f"{self.folder}/{name}/NEXT-{uuid.uuid4().hex}")
            out = fs.create(staged, True)
            out.write(bytearray(str(version).encode()))
            out.close()
            self._rename_over(staged, pointer)
            if version > self.keep:
                fs.delete(self._fs(f"{self.folder}/{name}/v{version - self.keep}")[1], True)
            return version

    def _rename_over(self, staged, pointer) -> None:
        """Rename a file over another one in one step."""
        context = self.spark.sparkContext
        jvm = context._jvm
        overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = context._gateway.new_array(overwrite, 1)
        options[0] = overwrite.OVERWRITE
        uri = staged.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(staged).toUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, context._jsc.hadoopConfiguration()).rename(staged, pointer, options)

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Write change(current) as the next version; no other writer comes between reading and writing."""
        with self.lock(name):
            return self.write(name, change(self.read(name)))


@contextmanager
def write_lock(path: str, owner: str, timeout: float = 300.0, stale: float = 21_600.0, poll: float = 0.25, clock: Callable[[], float] = time.time) -> Iterator[str]:
    """Hold the lock file at path; TimeoutError if another owner keeps it."""
    token, file = uuid.uuid4().hex, Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    end = clock() + timeout
    while True:
        try:
            handle = os.open(file, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(handle, json.dumps({"token": token, "owner": owner, "at": clock()}).encode())
            os.close(handle)
            break
        except FileExistsError:
            held = read_lock(path)
            if held is None or clock() - float(held.get("at", 0)) > stale:
                file.unlink(missing_ok=True)
                continue
            if clock() >= end:
                raise TimeoutError(f"{held.get('owner', 'someone')} holds {path}") from None
            time.sleep(poll)
    try:
        yield token
    finally:
        held = read_lock(path)
        if held and held.get("token") == token:
            file.unlink(missing_ok=True)


def read_lock(path: str) -> dict | None:
    """What the lock file says, or None if it is gone or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
