"""Tables and folders that driver and executors share, and that outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a local master (tests, one machine) gets a temporary folder; on a cluster that is an error, as
    executors can't see it. The folder goes with drop_shared(), or when this Python process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textindex-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/textindex/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_shared)
    _made[path] = spark
    return path


def drop_shared() -> None:
    """Delete all shared folders made so far in this process; frames that read them can't be used afterwards.

    A driver that runs many queries calls it when it has taken their results.
    """
    while _made:
        path, spark = _made.popitem()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before  # noqa: BLE001
            continue


def shared_table(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return the frame that reads it.

    This cuts the lineage: a lost executor costs no recomputation of what stands before.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of fewer bytes for each core is dealt out anew before heavy work on its rows.
SMALL_A_CORE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores: its one or two row groups would keep the others idle.

    By Catalyst's estimate of the size; a large table has splits enough and is left as it is, without a shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size <= SMALL_A_CORE * cores else df
