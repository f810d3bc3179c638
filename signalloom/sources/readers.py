"""Reading participants, scores, features, signals, confounds and listings.

Inputs are read by Spark alone, so any path that its file systems know will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays

#: Words that mark a column as cognitive, and motion columns of a confounds table.
COGNITIVE_WORDS = ("ist_", "neo_", "stai", "bas", "bis", "iq", "memory", "fluid")
MOTION = ("trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z")
#: Fields that a run's metadata must have; one of the groups of subject counts; fields that it should have.
REQUIRED = ("timestamp", "model", "data_dir")
COUNTS = (("n_subjects",), ("n_train", "n_test"))
RECOMMENDED = ("seed", "deterministic", "model_size", "device")


def _present(read, what: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(what) from error
        raise


def load_participants(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated participants file; 'n/a' is null. Without a schema the types are inferred."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "n/a")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return _present(lambda: reader.csv(path), f"participants file not found: {path}")


def load_scores(spark: SparkSession, folder: str, schema: str | None = None, splits: tuple[str, ...] = ("train", "test"), file: str = "cognition_scores.csv") -> DataFrame:
    """The scores of all splits with a column ``split``; the missing split is named if there is one."""
    out = None
    for split in splits:
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        one = _present(lambda reader=reader, split=split: reader.csv(f"{folder}/{split}/{file}"), f"no {split} scores in {folder}").withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table (split, subject, arrays), partitioned by split."""
    return _present(lambda: spark.read.parquet(path), f"features not found: {path}")


def load_features_and_scores(spark: SparkSession, features: str, scores: str) -> tuple[DataFrame, DataFrame]:
    return load_features(spark, features), load_scores(spark, scores)


def load_signals(spark: SparkSession, path: str, rows: int, n: int | None = None, strict: bool = True, pad: str = "right") -> DataFrame:
    """(subject, m): matrices with ``rows`` rows, transposed where only the width fits, of n columns if n is given.
    strict: a matrix that fits neither way is an error, else it is left as it is."""
    return oriented_signals(_present(lambda: spark.read.parquet(path), f"signals not found: {path}"), rows, n, strict, pad)


def oriented_signals(frame: DataFrame, rows: int, n: int | None = None, strict: bool = True, pad: str = "right") -> DataFrame:
    """The same for signals (subject, m) that are read already, of npy files say."""
    m = arrays.oriented(F.col("m"), rows)
    if strict:
        m = F.when(F.size(m) == rows, m).otherwise(F.raise_error(F.concat(F.lit(f"expected {rows} rows, subject "), F.col("subject").cast("string"))).cast("array<array<double>>"))
    if n is not None:
        m = F.transform(m, lambda row: arrays.pad_or_crop(row, n, "center", pad))
    return frame.withColumn("m", m)


def files(spark: SparkSession, folder: str, pattern: str = "*", suffix: str = "") -> DataFrame:
    """(entity, path, length) of the files under a folder, at any depth, whose name fits; entity is the name without suffix."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.where(name.endswith(suffix)).select(F.expr(f"left(regexp_extract(path, '([^/]+)$', 1), length(regexp_extract(path, '([^/]+)$', 1)) - {len(suffix)})").alias("entity"), "path", "length")


def head_of(listed: DataFrame, most: int | None) -> DataFrame:
    """The first entities in order, or all."""
    ordered = listed.orderBy("entity")
    return ordered if most is None else ordered.limit(most)


def processed(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Distinct entities that have an output."""
    return files(spark, folder, f"*{suffix}", suffix).select("entity").distinct()


def subjects_with(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Distinct sub-* folders that hold a fitting file."""
    return files(spark, folder, pattern).select(F.regexp_extract("path", r"/(sub-[^/]+)/", 1).alias("subject")).where("subject <> ''").distinct()


def all_subjects(scores: DataFrame, key: str = "participant_id") -> DataFrame:
    """Ids of all splits, as often as they stand there."""
    return scores.select(key)


def runs(spark: SparkSession, root: str, names: tuple[str, ...] = ("metadata.json", "results.csv")) -> DataFrame:
    """(folder, has_<name>...): folders that hold one of the files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    split = listed.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).where(F.col("name").isin(*names))
    return split.groupBy("folder").agg(*[F.max(F.col("name") == n).alias("has_" + n.split(".")[0]) for n in names])


def latest_run(found: DataFrame) -> DataFrame:
    """The folder with results whose name sorts last."""
    return found.where("has_results").orderBy(F.desc("folder")).limit(1)


def confounds(spark: SparkSession, path: str, columns: tuple[str, ...] = MOTION) -> DataFrame | None:
    """The motion columns that a tab-separated table has, nulls and NaN as 0; None if it has none of them."""
    frame = load_participants(spark, path)
    have = [c for c in columns if c in frame.columns]
    return frame.select(*[F.col(c).cast("double").alias(c) for c in have]).na.fill(0.0) if have else None


def cognitive_columns(frame: DataFrame, words: tuple[str, ...] = COGNITIVE_WORDS) -> list[str]:
    return [c for c in frame.columns if any(w in c.lower() for w in words)]


def load_factor(spark: SparkSession, folder: str):
    """The factor that ``sinks.write_factor`` saved."""
    from ..operators.factor import Factor

    rows = _present(lambda: spark.read.parquet(f"{folder}/factor"), f"no factor in {folder}").collect()
    return Factor([r["col"] for r in rows], [r["median"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows], [r["loading"] for r in rows], rows[0]["explained"])


def is_timestamp(text) -> F.Column:
    """True for a day and a time as YYYYMMDD_HHMMSS."""
    return F.coalesce(text.rlike(r"^\d{8}_\d{6}$") & F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss")).isNotNull(), F.lit(False))


def ordered_signals(scores: DataFrame, signals: DataFrame, key: str = "participant_id") -> DataFrame:
    """The score rows that have a signal, with their correlations, in the order of the score file's rows (``pos``)."""
    from ..operators import connectivity

    found = connectivity.fc_features(signals.select("subject", "m"))
    return scores.withColumn("pos", F.monotonically_increasing_id()).join(found.withColumnRenamed("subject", key), key).orderBy("pos")


def metadata_issues(spark: SparkSession, root: str, required: tuple[str, ...] = REQUIRED, counts: tuple[tuple[str, ...], ...] = COUNTS, recommended: tuple[str, ...] = RECOMMENDED) -> DataFrame:
    """(folder, issues, advice): what the metadata of each run folder under root lacks; no issues if it is as it should be."""
    found = runs(spark, root)
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(root)
    parsed = texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1).alias("folder"), F.json_object_keys("value").alias("keys"))
    names = lambda fields: F.array(*[F.lit(f) for f in fields])
    lacking = F.array_except(names(required), "keys")
    counted = F.lit(False)
    for group in counts:
        counted = counted | (F.size(F.array_except(names(group), "keys")) == 0)
    none = F.array().cast("array<string>")
    issues = F.concat(F.when(F.size(lacking) > 0, F.array(F.concat(F.lit("Missing required fields: "), F.array_join(lacking, ", ")))).otherwise(none), F.when(counted, none).otherwise(F.array(F.lit("Missing subject count"))))
    issues = F.when(~F.col("has_metadata"), F.array(F.lit("metadata.json not found"))).when(F.col("keys").isNull(), F.array(F.lit("Invalid JSON"))).otherwise(issues)
    return found.join(parsed, "folder", "left").select("folder", issues.alias("issues"), F.coalesce(F.array_except(names(recommended), "keys"), none).alias("advice"))
