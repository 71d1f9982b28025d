"""Session helpers: table access, lineage cuts and interim tables in a shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, else ``spark.checkpoint.dir``.

    Only a session without either that runs in one process (``local[...]``) gets a
    temporary folder; on a cluster a missing folder is an error, since a machine-local
    one would be lost with its executor.
    """
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is not None:
        return now
    if named := sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kmerloom-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: short lineage that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read again; its shuffle files are deleted at once.

    Takes a fraction of the disk of :func:`cut`. :func:`dropped_table` deletes it when it has served.
    """
    spark = df.sparkSession
    path, before = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4()}", spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped_table(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`stored` wrote."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        dropped(df.sparkSession, folder)


def fits(df: DataFrame, column: str, max_bytes: int) -> bool:
    """Whether the texts of ``column`` have at most ``max_bytes`` in all: the size check in front of a broadcast."""
    got = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0]
    return (got or 0) <= max_bytes


def spread(df: DataFrame) -> DataFrame:
    """A scan that gives fewer tasks than there are cores, spread over all cores: for steps that multiply its rows.

    A scan of many files or row groups stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
