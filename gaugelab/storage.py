"""Session and storage settings shared by the jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "gaugelab", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    session = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every Column costs more than small jobs do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir, or a folder under the warehouse where it is unset."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def run_folder(spark: SparkSession, label: str) -> str:
    """A folder of one run inside the shared folder; two runs or sessions never share a name."""
    return os.path.join(checkpoint_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as a Parquet table into a folder of its own in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but compressed and with columns that
    later steps can read singly.
    """
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    jvm = spark._jvm
    for table in tables:
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
