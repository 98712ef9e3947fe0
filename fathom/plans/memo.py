"""What many queries over one folder of tables share, written once a session.

The projection of the tables, its live set and the facts of its declarations
are the same for every rule and report, as a graph is built once and asked
often.  A copy is used again only if its files and the tables are still as they
were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.functions.scratch import stash

_kept: dict[tuple, tuple[str, DataFrame]] = {}


def _status(spark: SparkSession, path: str) -> str | None:
    """Names, sizes and times of the files in a folder; None if it is gone."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p)))


def memo(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stashed result of ``build`` under ``name`` for the tables of ``sf_dir``."""
    key, tables = (spark.sparkContext.applicationId, sf_dir, name), _status(spark, sf_dir)
    if key in _kept:
        before, df = _kept[key]
        if before == tables and _status(spark, df._fathom_path) is not None:
            return df
    df = stash(build())
    _kept[key] = tables, df
    return df
