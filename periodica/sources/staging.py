"""Intermediate results as tables in the folder that all machines of a cluster share.

A step that several later ones read is written once and read from there: it isn't computed again,
its lineage ends there, and lost executors can't take it along. ``discard`` removes what a session
has staged, to be called when the results that were built on it have been written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: holds a session's own folder, as ``spark.checkpoint.dir`` can't be set once a session runs
_OWN_FOLDER = "spark.periodica.folder"

#: folders staged so far, by application
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs on this machine alone, a folder
    of this machine. A cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='periodica-')}"
        spark.conf.set(_OWN_FOLDER, folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which ``discard`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back from there."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Remove what this application has staged; the number of folders that were there."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(place.getFileSystem(hadoop).delete(place, True))
    return removed
