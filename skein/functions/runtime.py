"""Session helpers: table loading, shared scratch tables, partition sizing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows (of a few machine words each) up to which a measured side may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests); then it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    Cuts the lineage and survives lost executors, since the files lie in the folder all of them share.
    The files are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder of this session in the shared one, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Give a Python-heavy stage at least one partition per core.

    Only inputs of fewer splits than cores (single small files) are shuffled; large inputs stay as scanned.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *(columns or []))
    return df


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of df only if it has been counted and is small; else leave the join to Catalyst and AQE."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df
