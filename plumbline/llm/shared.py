"""Shared folder, written intermediate tables, and row identifiers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space of the token rules, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`); a fresh local one only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared folder; all tables of `written` lie in it, for the owner to delete at the end."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> bool:
    """Deletes the tables of this application; call it when no frame that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
