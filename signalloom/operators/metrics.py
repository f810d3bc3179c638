"""Prediction metrics, and summaries, rankings and comparisons of metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import settled


def prediction_metrics(predictions: DataFrame, by: list[str] | None = None, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """r2, pearson_r, mae, mse and mape, in one pre-aggregated pass."""
    t, q = F.col(y), F.col(p)
    return predictions.groupBy(*(by or [])).agg(F.count("*").alias("n"), stats.r2(t, q).alias("r2"), stats.pearson(y, p).alias("pearson_r"), stats.mae(t, q).alias("mae"), stats.mse(t, q).alias("mse"), stats.mape(t, q).alias("mape"))


def spearman(frame: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Correlation of average ranks in each group. Groups are ranked in one task each; for one group over a whole
    corpus use ``spearman_global``."""
    ranked = frame.select(*by, stats.average_rank(y, by).alias("_ry"), stats.average_rank(p, by).alias("_rp"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), stats.pearson("_ry", "_rp").alias("spearman_r"))


def spearman_global(frame: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks of all rows, or of those of each group. Ranks come from counts of distinct values: ranges of
    values are sorted in parallel and each range's start is added, so no task sees all rows. Rows and ranges are written before they
    are read twice: a sum that is computed again can differ in its last digit and would meet no rank, and ranges that are dealt
    again can differ from those that were counted."""
    by = by or []
    frame = settled(frame.select(*by, F.col(y).alias(y), F.col(p).alias(p)))

    def rank_table(name: str, out: str) -> DataFrame:
        counts = frame.groupBy(*by, F.col(name).alias(name)).agg(F.count("*").alias("_c"))
        split = settled(counts.repartitionByRange(*by, name).withColumn("_part", F.spark_partition_id()))
        sizes = split.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))
        starts = sizes.select(*by, "_part", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy(name))
        return split.join(F.broadcast(starts), [*by, "_part"]).select(*by, name, (F.col("_start") + upto - (F.col("_c") - 1) / 2).alias(out))

    ranked = frame.select(*by, y, p).join(rank_table(y, "_ry"), [*by, y]).join(rank_table(p, "_rp"), [*by, p])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), stats.pearson("_ry", "_rp").alias("spearman_r"))


def unpivoted(frame: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, value)."""
    return frame.unpivot(keys or [], names, "metric", "value")


def summary(frame: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, std (population), min, max, median."""
    v = F.col("value")
    return unpivoted(frame, names).groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def cv_ranking(frame: DataFrame, names: list[str]) -> DataFrame:
    """metric, cv, place: coefficients of variation in ascending order; ties by name."""
    table = unpivoted(frame, names).groupBy("metric").agg(stats.cv("value").alias("cv"))
    return table.withColumn("place", F.row_number().over(Window.orderBy("cv", "metric")))


def correlation_matrix(frame: DataFrame, names: list[str]) -> DataFrame:
    """metric_a, metric_b, r, n: each unordered pair, from one aggregate over the wide rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = frame.agg(F.count("*").alias("n"), *[stats.pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("e")).select("e.metric_a", "e.metric_b", "e.r", "n")


def starred(matrix: DataFrame, r: str = "r", n: str = "n", none: str = "") -> DataFrame:
    """Adds p_value and marks to a small table of correlations."""
    return matrix.withColumn("p_value", stats.p_value(F.col(r), F.col(n))).withColumn("marks", stats.stars(F.col("p_value"), none))


def zscores(frame: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, z): value less mean over population deviation, by a joined one-row aggregate, not a whole-table window."""
    moments = frame.agg(*[f for n in names for f in (F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"))])
    scaled = frame.crossJoin(F.broadcast(moments)).select(*keys, *[stats.safe_divide(F.col(n) - F.col(f"_m_{n}"), F.col(f"_s_{n}")).alias(n) for n in names])
    return unpivoted(scaled, names, keys).withColumnRenamed("value", "z")


def histogram(frame: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """bin (from 0), n: equal widths from least to greatest value, which belongs to the last bin; all in bin 0 if they are equal."""
    ends = frame.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    placed = frame.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0).alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def box(frame: DataFrame, names: list[str]) -> DataFrame:
    """metric, q1, median, q3, low, high: quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    rows = unpivoted(frame, names)
    q = rows.groupBy("metric").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(F.broadcast(q), "metric").where(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy("metric", "q1", "median", "q3").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def cohort_sizes(features: DataFrame) -> DataFrame:
    """(split, n, width): entities of each split and the number of their features."""
    return features.groupBy("split").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"))


def against_baseline(results: DataFrame, baseline: str, method: str = "method", r: str = "pearson_r") -> DataFrame:
    """Adds delta, the difference to the baseline's value (null without it), and its signed text."""
    # a window over the few rows of results, which are then computed once
    base = F.max(F.when(F.col(method) == baseline, F.col(r))).over(Window.partitionBy())
    out = results.withColumn("delta", F.col(r) - base)
    return out.withColumn("delta_text", F.format_string("%+.4f", "delta"))


def assessed(results: DataFrame, r: str = "pearson_r") -> DataFrame:
    return results.withColumn("assessment", stats.assessment(F.col(r)))


def progress(frame: DataFrame, ok: str, seconds: float | None = None, total: int | None = None) -> DataFrame:
    """success, failed, rate (share), and with elapsed seconds the remaining ones."""
    out = frame.agg(F.count_if(F.col(ok)).alias("success"), F.count_if(~F.col(ok)).alias("failed")).withColumn("rate", stats.safe_divide(F.col("success"), F.col("success") + F.col("failed")))
    if seconds is not None and total is not None:
        done = F.col("success") + F.col("failed")
        out = out.withColumn("seconds_left", stats.safe_divide(F.lit(seconds), done, None) * (F.lit(total) - done))
    return out


# ---- data of plots --------------------------------------------------------------------------------------------------


def bins_2d(frame: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, n, x_low, y_low) of a scatter plot: counts on a grid of equal cells between the extremes, those that have
    any. One pass for the extremes, one pre-aggregated count; the result has bins * bins rows at most, whatever the points. Rows
    with a null or NaN are left out; a constant column has a single bin."""
    clean = frame.where(~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ends = clean.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))
    place = lambda v, a, b: F.when(F.col(b) > F.col(a), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * bins))).otherwise(0).cast("int")
    low = lambda k, a, b: F.min(F.col(a) + F.col(k) * (F.col(b) - F.col(a)) / bins)
    placed = clean.join(F.broadcast(ends)).withColumn("x_bin", place("_x", "x0", "x1")).withColumn("y_bin", place("_y", "y0", "y1"))
    return placed.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), low("x_bin", "x0", "x1").alias("x_low"), low("y_bin", "y0", "y1").alias("y_low"))


def min_max(frame: DataFrame, by: list[str], t: str, v: str, buckets: int = 10) -> DataFrame:
    """(by, bucket, t_low, low, t_high, high): a long line reduced to the least and the largest value of each of so many equal stretches
    of its time, with their times (the earliest of ties), so that a plot keeps its peaks. Two pre-aggregated passes; series of any
    length, no sort. Null and NaN values are left out."""
    clean = frame.where(F.col(v).isNotNull() & ~F.isnan(v) & F.col(t).isNotNull()).select(*by, F.col(t).cast("double").alias("_t"), F.col(v).cast("double").alias("_v"))
    ends = clean.groupBy(*by).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    bucket = F.when(F.col("_b") > F.col("_a"), F.least(F.lit(buckets - 1), F.floor((F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a")) * buckets))).otherwise(0).cast("int")
    low, high = F.min(F.struct("_v", "_t")), F.min(F.struct((-F.col("_v")).alias("_n"), "_t"))
    found = clean.join(ends, by).withColumn("bucket", bucket).groupBy(*by, "bucket").agg(low.alias("l"), high.alias("h"))
    return found.select(*by, "bucket", F.col("l._t").alias("t_low"), F.col("l._v").alias("low"), F.col("h._t").alias("t_high"), (-F.col("h._n")).alias("high"))
