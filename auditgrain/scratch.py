"""Cut lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only in local mode, where all tasks see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the cluster names in spark.checkpoint.dir and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
