"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``; only where the session has none (tests, a laptop) a local one is made.
Tables written here survive the loss of an executor, unlike cached blocks.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: folders made for applications whose session names none
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or, on one machine, a local one of our own where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and set_by_call.isDefined():
        base = set_by_call.get()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="bitextra-")
        _own[app] = base
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later consumers share one evaluation and a short lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bitextra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a small file may be one task, however much work a row is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partitions and the order of rows inside them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def clear() -> None:
    """Delete every table written by ``materialize`` in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; its folder goes with the application's scratch space
            return


atexit.register(clear)
