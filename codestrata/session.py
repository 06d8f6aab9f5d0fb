"""Session helpers: building a local session, reading tables, cutting lineage durably."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "codestrata") -> SparkSession:
    """A local session with AQE, Arrow and UTC; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CODESTRATA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local session without that setting (tests, one machine) gets a folder of its own; on a cluster a
    machine-local folder is invisible to the executors, so a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="codestrata-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of checkpointed frames that nothing reads any more, such as the last round of a loop."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spread rows over all cores when the scan has too few splits for CPU-heavy Python work.

    A large input keeps the splits of its scan, so that whole texts are never shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)
