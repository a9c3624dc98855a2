"""The folder that driver and executors share, and tables kept there in mid-plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared ``spark.checkpoint.dir``; where that is unset, a temporary one for a local session only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoints-"))
        # a folder of this session alone: it goes when the driver ends
        own = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
