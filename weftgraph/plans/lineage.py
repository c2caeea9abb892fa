"""Cutting lineage so that it survives the loss of executors.

Everything goes to the folder that the session names in ``spark.checkpoint.dir``,
which all executors share. Only where that is unset (tests on one machine) is a
folder of our own used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of our own only for sessions without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.conf.get("spark.weftgraph.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.weftgraph.checkpoint.dir", own)
    return own


#: Spark's own setting by which the shuffle files of a query go as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def _append(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN_UP)
        else:
            conf.set(CLEAN_UP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage as ``checkpoint()`` does, but keeps the columns compressed
    and prunable. The rows come back in no particular order. The shuffle files of
    the write go when it has ended, nothing reads them again.
    """
    return materialize_all(iter([df]))


def materialize_all(parts: Iterable[DataFrame]) -> DataFrame:
    """One table of the rows of all ``parts``, at least one and of one schema, which are written one after the other as they come."""
    path, last = None, None
    for last in parts:
        path = path or _path(last.sparkSession)
        _append(last, path)
    return last.sparkSession.read.schema(last.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete all tables in the shared folder that ``df`` reads, once nothing reads them any more. Other files stay."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path(shared_dir(spark)).getFileSystem(conf)
    ours = files.makeQualified(path(shared_dir(spark))).toString().rstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        found = files.makeQualified(path(folder)) if re.search(r"/table-[0-9a-f]{32}$", folder) else None
        if found is not None and found.getParent().toString() == ours:
            files.delete(found, True)
