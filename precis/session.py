"""Spark session and table helpers shared by every module."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Explicit setting for sessions that read small, unsplittable files on many
#: cores: ``table`` then spreads the rows over so many partitions.  Off unless
#: set; a cluster sizes its scans by ``spark.sql.files.maxPartitionBytes``.
SCAN_PARTITIONS = "spark.precis.scanPartitions"


def get_spark(cpus: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "precis") -> SparkSession:
    """Local session for tests and the bench.

    On a cluster the session comes from the launcher; only the settings that
    matter for the plans here are pinned (AQE, skew join, UTC).
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SCAN_PARTITIONS, str(parts))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to storage that all executors share; without it there
    is no place that a second executor could read, so this raises.  Only a
    local session, whose one process is driver and executor, makes a folder
    of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")
        path = tempfile.mkdtemp(prefix="precis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """Read a driver table.

    ``spread`` (by default the session's ``spark.precis.scanPartitions``, 0 if
    unset) deals the rows round-robin to so many partitions, for a file of one
    row group whose single split would leave all cores but one idle.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = int(spark.conf.get(SCAN_PARTITIONS, "0")) if spread is None else spread
    return df.repartition(n) if n > 0 else df


def cut_lineage(df: DataFrame, tag: str = "state", replaces: DataFrame | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table under ``spark.checkpoint.dir``
    and read it back: the plan is cut, the data is computed once (unlike
    ``DataFrame.checkpoint``, which runs the plan a second time to write it),
    and the files live on the shared storage the cluster names, so losing
    an executor loses nothing.

    ``replaces`` is a table written here before (an earlier round) that
    nothing will read again; its files are deleted once the new ones exist.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/precis-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if replaces is not None and getattr(replaces, "_cut_path", None):
        old = spark._jvm.org.apache.hadoop.fs.Path(replaces._cut_path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return out
