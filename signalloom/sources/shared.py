"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine, where none is set, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="shared-")).rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def settled(frame: DataFrame) -> DataFrame:
    """frame written to the shared checkpoint folder: its partitions are the same for all who read it."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, what: str = "written") -> tuple[DataFrame, str]:
    """(frame written to the shared folder as Parquet and read again, its path). For loops: a checkpoint carries the estimated size of
    its plan along, and the estimate of a join is a product, so that it squares in every round."""
    path = new_folder(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path
