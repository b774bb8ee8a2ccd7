"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(frame: DataFrame) -> DataFrame:
    """`frame` computed once into `spark.checkpoint.dir`, so that all its readers see the same rows in the same partitions.

    Only a local session without that setting gets a folder of its own.
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        context.setCheckpointDir(folder)
    return frame.checkpoint()
