"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cytomosaic")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    atexit.register(_clear_at_exit, spark)
    return spark


def _clear_at_exit(spark: SparkSession) -> None:
    """Clears stage folders if the session still runs."""
    if spark.sparkContext._jsc is not None:
        clear_stages(spark)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where that is not set, a folder in the warehouse."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root; nothing is created. ``clear_stages`` deletes it."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Delete what was written under names from ``shared_folder``; tables that still read from there are lost.

    To be called when a job's results are written elsewhere. Returns how many folders were there.
    """
    deleted = 0
    while _made:
        target = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        deleted += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return deleted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
