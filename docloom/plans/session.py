"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local
    master without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[0]


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage through a parquet table in the shared folder.

    The table survives the loss of any executor and is read with column
    pruning; unlike ``checkpoint()`` it is columnar and compressed.
    """
    path = f"{shared_dir(df.sparkSession)}/docloom/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished tables removed now: Spark drops those that
    nothing refers to any more, but only looks when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()
