"""Reliable checkpoints for operators that use a table more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's folder; a temporary one only where none is set and the master is local."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is as long as the other: both are dealt by the keys and merged.

    Rows made by explode are estimated by the size of the files they come from, so Spark
    would broadcast millions of them through the driver."""
    return df.hint("merge")
