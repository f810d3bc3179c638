"""Whole flows: targets from participants, features from signals, comparisons of feature sets, reconstruction reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import connectivity, factor, kernel, krr, metrics, relational, spd
from ..sources import sinks


def prepare_targets(participants: DataFrame, key: str, variables: list[str], scanned: DataFrame | None = None, n_train: int | None = None, n_test: int | None = None, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, factor.Factor]:
    """Cohort with scans and complete variables, split, scored by a factor fitted on the training rows alone, and
    optionally thinned to evenly spaced scores of each split. Returns (scores, factor)."""
    cohort = relational.complete(participants if scanned is None else relational.having(participants, scanned, key), variables).select(key, *variables)
    split = relational.random_split(cohort, [key], test, seed)
    fitted = factor.fit(split.where("split = 'train'"), variables)
    scores = factor.transform(split, fitted)
    for name, k in (("train", n_train), ("test", n_test)):
        if k is not None:
            thin = relational.evenly_spaced(scores.where(F.col("split") == name), ["cognition_factor", key], k)
            scores = scores.where(F.col("split") != name).unionByName(thin.select(scores.columns))
    return scores, fitted


def feature_sets(signals: DataFrame, targets: DataFrame, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """(method, subject, split, features, y): correlations of the input signals (subject, m), and any other feature
    tables (subject, features), each matched with targets (subject, split, y)."""
    sets = {"fc_input": connectivity.fc_features(signals), **(extra or {})}
    out = None
    for name, table in sets.items():
        one = table.select("subject", "features").join(targets, "subject").select(F.lit(name).alias("method"), "subject", "split", "features", "y")
        out = one if out is None else out.unionByName(one)
    return out


def compare(features: DataFrame, baseline: str = "fc_input") -> DataFrame:
    """One row for each method: test metrics, difference to the baseline, assessment."""
    return metrics.assessed(metrics.against_baseline(krr.compare(features), baseline))


def extended(features: DataFrame, patches: DataFrame, targets: DataFrame, layout: tuple[int, int] | None = None, cap: float = 20e9, components: int = 500) -> DataFrame:
    """The comparison with flattened patches (by components or by blocks, as memory allows) and patch similarities."""
    flat = patches.select("subject", F.flatten("m").alias("features"))
    similar = connectivity.similarity_features(patches, layout)
    sets = features
    for name, table in (("similarity", similar), ("patch_mean", connectivity.pooled(patches))):
        sets = sets.unionByName(table.join(targets, "subject").select(F.lit(name).alias("method"), "subject", "split", "features", "y"))
    sizes = targets.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "test")).first()
    width = flat.select(F.size("features")).first()[0]
    both = flat.join(targets, "subject")
    if kernel.strategy(sizes[0], sizes[1], components, width, cap)[0] == "pca":
        reduced = factor.flat_components(both, components).select("subject", F.col("components").alias("features")).join(targets, "subject")
        return compare(sets.unionByName(reduced.select(F.lit("flat_patches").alias("method"), "subject", "split", "features", "y")))
    # the block kernel's ridge from the rows themselves: summed products, or blocks for wide rows; never a row for each pair
    direct = krr.compare(both.select(F.lit("flat_patches").alias("method"), "subject", "split", "features", "y"), turn=kernel.shared_scale)
    return metrics.assessed(metrics.against_baseline(krr.compare(sets).unionByName(direct), "fc_input"))


def reconstruction_report(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each subject, their summary)."""
    rows = spd.evaluate_reconstruction(pairs)
    return rows, metrics.summary(rows, list(spd.METRICS))


def analyse(results: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a metric report: summary, ranking by variation, correlations with marks, z-scores and histograms."""
    rows = relational.without_summary_rows(results)
    tables = {"summary": metrics.summary(rows, names), "ranking": metrics.cv_ranking(rows, names), "correlations": metrics.starred(metrics.correlation_matrix(rows, names)), "zscores": metrics.zscores(rows, names, ["subject"]), "box": metrics.box(rows, names)}
    return tables | {f"histogram_{n}": metrics.histogram(rows, n) for n in names}


def save_comparison(results: DataFrame, folder: str, metadata: dict) -> None:
    """A comparison's results as CSV, in long form (method, metric, value) too, its metadata as JSON, and a text report."""
    names = [c for c, kind in results.dtypes if kind in ("double", "bigint", "int") and c != "method"]
    wide = results.select("method", *[F.col(c).cast("double").alias(c) for c in names]).persist()
    try:
        sinks.write_results(results, f"{folder}/results.csv")
        sinks.write_results(metrics.unpivoted(wide, names, ["method"]), f"{folder}/metrics.csv")
        sinks.write_metadata(results.sparkSession, metadata, f"{folder}/metadata.json")
        lines = wide.select(F.concat_ws(": ", F.col("method"), F.concat_ws(", ", *[F.format_string(f"{c}=%.4f", c) for c in names])).alias("value"))
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/README.txt")
    finally:
        wide.unpersist()


def save_reconstruction(pairs: DataFrame, folder: str, metadata: dict) -> None:
    """The metrics of each subject and their summary as two tables, and the metadata with the number of subjects."""
    rows, table = reconstruction_report(pairs)
    sinks.write_results(rows, f"{folder}/results.csv")
    sinks.write_results(table, f"{folder}/summary.csv")
    sinks.write_metadata(pairs.sparkSession, {"n_subjects": rows.count(), **metadata}, f"{folder}/metadata.json")
