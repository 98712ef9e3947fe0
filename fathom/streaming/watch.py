"""Watch a folder of sources: every change, edits and deletions too, recomputes the findings.

The stream's source is a listing: its offset is the paths with their times and
sizes, a batch is what differs from the last offset.  Offsets are in the
query's checkpoint, so a restarted watch goes on from what it last saw.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fathom.functions.scratch import shared_dir
from fathom.plans.scan import Options, scan

WATCHED = r"\.(kt|kts|java|xml|gradle|pro)$"


def listing(path: str) -> dict[str, str]:
    """Time and size of every watched file below a folder, by its path."""
    where, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = where.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {f.path: f"{f.mtime_ns}:{f.size}" for f in found if f.type == fs.FileType.File and re.search(WATCHED, f.path)}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = json.loads(start["files"]), listing(self.path)
        rows = [(p, "deleted") for p in old if p not in new] + [(p, "added" if p not in old else "changed") for p in new if old.get(p) != new[p]]
        return iter(rows), {"files": json.dumps(new, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return iter([(p, "deleted") for p in old if p not in new] + [(p, "added" if p not in old else "changed") for p in new if old.get(p) != new[p]])

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    """A streaming source of (path, change) below the folder in option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "fathom_folder"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"])


def watch(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], name: str = "watch", every: str = "500 milliseconds", options: Options = Options()) -> StreamingQuery:
    """Start watching; after each change ``sink`` gets the findings of the whole folder and the batch number."""
    spark.dataSource.register(FolderChanges)
    changes = spark.readStream.format("fathom_folder").option("path", path).load()

    def act(batch: DataFrame, k: int) -> None:
        if not batch.isEmpty():
            sink(scan(batch.sparkSession, path, options), k)

    out = changes.writeStream.option("checkpointLocation", f"{shared_dir(spark)}/watch/{name}")
    return out.trigger(processingTime=every).foreachBatch(act).start()
