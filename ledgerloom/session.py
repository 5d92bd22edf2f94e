"""Session settings and the shared folder for results that cut a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    """A local session for tests and bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only a local master gets a folder of its own where none is set, removed when Python ends; elsewhere a folder of one machine would
    be lost to the others, so a missing setting raises.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have:
        if current.isEmpty():
            spark.sparkContext.setCheckpointDir(have)
        return have
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that lost executors do not make its lineage run again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many tasks as the cluster has cores.

    Files smaller than a split come as a few large tasks; a row-by-row Python stage then leaves cores idle. Large inputs already have
    more splits than cores, so nothing is shuffled there. Splits are only counted where that runs nothing: a plan that shuffles stays
    as it is.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def widely(df: DataFrame, *keys: str) -> DataFrame:
    """df shuffled into the session's number of shuffle partitions, which adaptive execution leaves as they are: for Python stages behind a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
