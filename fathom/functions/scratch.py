"""Lineage cuts in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Where the session has none, one set
on the context is used; where that is missing too, a local session (tests, a
laptop) gets a private folder, and a cluster an error, as a folder of one
machine would lose data there.  What an application leaves behind is deleted
when its Python process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_private: dict[str, str] = {}
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _roots:
        return _roots[app]
    where = spark.conf.get(KEY, None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{KEY} must name a folder that all executors share")
        where = _private[app] = "file://" + tempfile.mkdtemp(prefix="fathom-")
        sc.setCheckpointDir(where)
    _roots[app] = f"{where.rstrip('/')}/fathom-{app}"
    atexit.register(_clean, spark, _roots[app])
    return _roots[app]


def _clean(spark: SparkSession, path: str) -> None:
    """Delete the application's folder if its context is still there."""
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    The copy survives the loss of any executor and has exact file sizes, so a
    later join is planned from what is there, not from an estimate.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a ``stash``; nothing may read it afterwards."""
    path = getattr(df, "_fathom_path", None)
    if path is not None:
        remove(df.sparkSession, path)
