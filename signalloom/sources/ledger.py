"""Runs in batches that survive being killed: results batch by batch, a ledger of those that are done, and a clean-up.

The input is dealt to batches by a hash of its key and written once, so that a resumed run sees the rows that the first one saw.
Each batch is one job: its results are written to a folder of their own (again and whole, if a killed run left a part there), and
then an entry in the ledger says that they are. A run goes on with the batches that have no entry. When all are done, input and
ledger are removed and a marker is left; what runs then find is the results. Two runs of one folder at a time aren't guarded against.

Edge cases: a null key is a key; repeated rows stay repeated; an empty input has a single, empty batch; a run over a finished
folder computes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import clean_up, write_file

#: Rows between two entries of the ledger: fifty batches of eight.
ROWS = 400


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def done(spark: SparkSession, folder: str) -> set[int]:
    """Batches that have an entry."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(s.getPath().getName()) for s in files.listStatus(target)} if files.exists(target) else set()


def run(frame: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], folder: str, rows: int = ROWS, batches: int | None = None) -> DataFrame:
    """The results of compute over all batches of the frame, of which those that are done already aren't computed again.
    batches: their number, else one for every ``rows`` rows; a resumed run keeps the number of the first."""
    spark = frame.sparkSession
    if not _exists(spark, f"{folder}/_DONE"):
        dealt = f"{folder}/input"
        if not _exists(spark, f"{dealt}/_SUCCESS"):
            number = batches or max(1, -(-frame.count() // rows))
            frame.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(number)).cast("int")).repartition("_batch").write.mode("overwrite").partitionBy("_batch").parquet(dealt)
        stored = spark.read.schema(f"{', '.join(f'`{n}` {k}' for n, k in frame.dtypes)}, _batch int").parquet(dealt)
        known = sorted(r[0] for r in stored.select("_batch").distinct().collect()) or [0]
        finished = done(spark, folder)
        for k in known:
            if k not in finished:
                compute(stored.where(F.col("_batch") == k).drop("_batch")).write.mode("overwrite").parquet(f"{folder}/results/batch={k}")
                write_file(spark, f"{folder}/ledger/{k}", "done")
        write_file(spark, f"{folder}/_DONE", f"{len(known)}")
    for left in ("input", "ledger"):
        clean_up(spark, f"{folder}/{left}")
    return spark.read.parquet(f"{folder}/results").drop("batch")
