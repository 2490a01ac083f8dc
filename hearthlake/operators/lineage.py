"""Tables that an operator writes while it runs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is not set a temporary folder on a local master, else one in the warehouse."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        local = context.master == "local" or context.master.startswith("local[")
        path = tempfile.mkdtemp(prefix="hearthlake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written there and read back, so a lost executor never has it computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
