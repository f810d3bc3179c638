"""Incremental ingestion: files are processed as they come, once, and a restart goes on where it stopped; files that fail are tried
again and then parked.

Engine additions, marked so: event-time windows, sessions and de-duplication with watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema, transform: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_batch: int = 50, file_format: str = "parquet") -> int:
    """Processes the files of source that aren't done yet in batches of so many, appends to target, and returns the number
    of batches. Done files are known by the checkpoint; a batch that failed is run again and replaces its own part."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(source)

    written = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(set(written))


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, parse: Callable[[bytes], list], result: str = "array<double>", attempts: int = 3, files_per_batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(done, parked): (path, result) of the files of source that parse could read, and (path, attempts, error) of those that failed
    so many times. New files come as a stream, each once. A file that fails doesn't stop the others: it is tried again after the new
    ones, in each run once and from where the last run stopped, and parked at ``attempts``. Every attempt is a folder of its own
    that is written whole, so what a killed run left is replaced; a parked file stays parked until its rows are removed."""
    from ..operators.encoders import applied

    def tried(files: DataFrame, folder: str) -> None:
        got = applied(files.select("path", "content"), lambda values: [parse(v) for v in values], "content", result)
        got.select("path", "result", "error").write.mode("overwrite").parquet(folder)

    schema = f"path string, result {result}, error string"
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: tried(batch, f"{target}/attempt=1/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

    def state(attempt: int) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, batch int").parquet(f"{target}/attempt={attempt}")
        except AnalysisException:  # there was none
            return spark.createDataFrame([], f"{schema}, batch int")

    for attempt in range(2, attempts + 1):
        # those that failed before and were not tried for this time
        left = state(attempt - 1).where("error is not null").select("path").join(state(attempt).select("path"), "path", "left_anti")
        names = [r.path for r in left.toLocalIterator()]
        number = (state(attempt).agg(F.max("batch")).first()[0] or 0) + 1
        for k in range(0, len(names), files_per_batch):
            tried(spark.read.format("binaryFile").load(names[k : k + files_per_batch]), f"{target}/attempt={attempt}/batch={number + k // files_per_batch}")
    every = [state(k).withColumn("attempts", F.lit(k)) for k in range(1, attempts + 1)]
    whole = every[0]
    for one in every[1:]:
        whole = whole.unionByName(one)
    return whole.where("error is null").select("path", "result"), every[-1].where("error is not null").select("path", "attempts", "error")


# ---- engine additions -----------------------------------------------------------------------------------------------


def tumbling(events: DataFrame, by: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, by, n, total) of each window; with a watermark on a stream."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, by: str, width: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, by: str, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """(start, end, by, n, total) of runs of events less than a gap apart."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """On a stream: the first of the rows that share keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, by: str, late: str) -> DataFrame:
    """On a stream: (by, n, total) after each batch, kept in state until the key is quiet for the watermark."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, frames, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
            last = f["ts"].max() if last is None else max(last, f["ts"].max())
        state.update((n, total))
        if last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    return events.withWatermark("ts", late).groupBy(by).applyInPandasWithState(update, f"{by} long, n long, total double", "n long, total double", "append", GroupStateTimeout.EventTimeTimeout)
