"""Session settings, table access and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both a laptop and a cluster; sizes come from AQE, not from here.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; anything in conf (dots as double underscores) comes on top."""
    b = SparkSession.builder.appName("laserloom")
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Taken from spark.checkpoint.dir; only where that is unset
    (tests, local mode) a temporary folder of this machine is set and used."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="laserloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/laserloom-{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        atexit.register(_remove, spark, path)
    return path


_kept: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it back.

    The files survive the loss of an executor. Used only where a result feeds several later
    plans whose recomputation would cost more than one write and read."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
