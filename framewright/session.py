"""Sessions and settings shared by all operators."""

from __future__ import annotations

import atexit
import importlib
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_code(package: str) -> None:
    """Functions of the package travel to executors by value, so nothing has to be installed there."""
    cloudpickle.register_pickle_by_value(importlib.import_module(package))


def local_session(cpus: int = 8, app: str = "framewright", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() goes to spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        there = tempfile.mkdtemp(prefix="framewright-")
        atexit.register(shutil.rmtree, there, True)  # tests and benches leave nothing behind
    sc.setCheckpointDir(there)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints. It holds results that are read lazily, so it stays until the folder's owner clears it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_folder() that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df):
    """Cuts the lineage: rows are written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df, rows: int, per_task: int, least: int = 8):
    """df in as many partitions as its rows ask for, where that is less than a shuffle's: small tables don't pay for the cluster's width."""
    want = max(least, -(-rows // per_task))
    return df.coalesce(want) if want < shuffle_partitions(df.sparkSession) else df
