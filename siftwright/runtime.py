"""Session helpers: table loading, lineage cuts and Arrow batch plumbing shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root`` (one file or a folder of parts)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table that was read in fewer pieces than there are cores, dealt out to all of them; larger ones stay as they are.

    What is moved is at most a split a core, so it is little; results do not depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the session runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation.

    What was written stays until ``release`` or the end of the process, as plans may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siftwright-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Delete every table ``cut`` wrote in this process; frames that read them can't be used any more. Returns how many there were."""
    n = 0
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            n += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
        except Exception:  # noqa: BLE001 - the session may be gone; its folder is then the caller's
            continue
    return n


def _at_end() -> None:
    """Release in the session that is still up; never start or wait for another."""
    up = SparkSession.getActiveSession()
    if up is not None and up.sparkContext._jsc is not None:
        release()


atexit.register(_at_end)


def plain_unions(spark: SparkSession) -> SparkSession:
    """Unions promise no partitioning: where Spark 4.1 takes over that of their branches, a join above is planned without an exchange and may meet
    both branches' partitions in a row ("Can't zip RDDs with unequal numbers of partitions")."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches Python workers get: rows of long texts must not add up beyond a worker's memory; and keep unions plain."""
    plain_unions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark
