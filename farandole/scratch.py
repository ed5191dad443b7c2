"""Scratch tables in the folder that the cluster shares.

A table that is needed more than once, or ends a lineage, is written there and read back: a lost
executor then costs a re-read and no recomputation. Tables of this driver go when its interpreter
ends, or with clear_scratch().
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_local: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    With a local master, where no machine shares anything, a temporary folder serves if the setting is
    missing; it goes when the interpreter ends. On a cluster the setting has to be there.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="farandole-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    if not _written:
        atexit.register(clear_scratch)
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written once to the shared folder in buckets by the key, as many as shuffles have partitions,
    and read back: joins on the key, in rounds, don't shuffle it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    _tables.append(path.rsplit("/", 1)[-1].replace("-", "_"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(_tables[-1])
    return spark.table(_tables[-1])


def clear_scratch() -> None:
    """Removes all scratch tables of this driver; results that read them must be done."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while spark is not None and _written:
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
