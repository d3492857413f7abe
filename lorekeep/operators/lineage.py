"""Cutting lineage where a plan would be computed again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder the cluster names; a temporary one only in local mode, where driver and executors share its disk."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


#: Rows that a side may have at most to be broadcast; counted before, never guessed.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows allow it, else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def settle(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder: lineage ends, lost executors cost nothing."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
