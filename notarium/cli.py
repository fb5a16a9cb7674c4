"""Command line: python -m notarium.cli FOLDER OPERATION [key=value ...].

OPERATION is one of the registry, `operations` for their list, or a run over the snapshot store in FOLDER: `init`
(reset=true), `index` (collection_id=1 root=/notes pattern=*.md force=true limit=10), `embed` (limit=100).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from notarium.engine import Engine
from notarium.indexing import Indexer
from notarium.operations import OPERATIONS, list_operations, run
from notarium.sources.snapshots import SnapshotStore

#: Runs over a snapshot store, by name.
RUNS = {"init": Indexer.init, "index": Indexer.run, "embed": Indexer.embed}


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str] | None = None) -> int:
    """Run one operation and print its rows as JSON lines."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("operation", choices=[*OPERATIONS, *RUNS, "operations"])
    parser.add_argument("params", nargs="*", help="key=value")
    given = parser.parse_args(argv)
    if given.operation == "operations":
        print(json.dumps(list_operations(), indent=2))
        return 0
    params = {k: _value(v) for k, v in (p.split("=", 1) for p in given.params)}
    spark = SparkSession.builder.appName("notarium").getOrCreate()
    if given.operation in RUNS:
        print(json.dumps(RUNS[given.operation](Indexer(spark, SnapshotStore(spark, given.folder)), **params)))
        return 0
    engine = Engine(spark, given.folder)
    result = run(engine, given.operation, params)
    if not result["ok"]:
        print(json.dumps(result))
        return 1
    for row in result["data"].toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
