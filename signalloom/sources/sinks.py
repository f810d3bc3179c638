"""Writing features, scores, results, metadata and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet, a folder for each split."""
    features.write.mode("overwrite").option("compression", compression).partitionBy("split").parquet(path)


def write_scores(scores: DataFrame, folder: str, key: str = "participant_id", file: str = "cognition_scores.csv", splits: tuple[str, ...] = ("train", "test")) -> None:
    """For each split its scores as CSV and its ids as text."""
    for split in splits:
        own = scores.where(F.col("split") == split).drop("split")
        own.write.mode("overwrite").option("header", True).csv(f"{folder}/{split}/{file}")
        own.select(F.col(key).cast("string")).write.mode("overwrite").text(f"{folder}/{split}/subjects.txt")


def write_factor(factor, spark: SparkSession, raw: DataFrame, folder: str) -> None:
    """What was fitted, one row for each variable, and the raw table that it was fitted on."""
    factor.table(spark).withColumn("explained", F.lit(factor.explained)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/factor")
    raw.write.mode("overwrite").option("header", True).csv(f"{folder}/raw.csv")


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through Spark's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def clean_up(spark: SparkSession, path: str) -> bool:
    """Removes what a finished run left behind (its checkpoints), through Spark's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.select("parcel", F.col("med").cast("float"), F.col("iqr").cast("float")).write.mode("overwrite").parquet(path)


def metadata_json(frame: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """A nested dict as one JSON text."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report(results: DataFrame, label: str, *columns: str) -> DataFrame:
    """A text line for each row: the label and its numbers with four places."""
    line = F.format_string("%s: " + ", ".join(f"{c}=%.4f" for c in columns), F.lit(label), *[F.col(c).cast("double") for c in columns])
    return results.select(line.alias("value"))


def storage(files: DataFrame) -> DataFrame:
    """(n_files, megabytes) of a listing."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length") / 1e6, F.lit(0.0)).alias("megabytes"))
