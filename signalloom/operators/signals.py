"""Per-entity time series: (subject, parcel, x array<double>) rows, one for each parcel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def dense_series(events: DataFrame, length: int, parcels: DataFrame) -> DataFrame:
    """(subject, parcel, t, v) sums to (subject, parcel, x): gaps are 0; every subject gets every parcel. The sparse cells of a
    series meet in one row and are spread there; parcels that a subject lacks are added as rows of zeros."""
    cells = events.groupBy("subject", "parcel", "t").agg(F.sum("v").alias("v"))
    own = cells.groupBy("subject", "parcel").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("at"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0.0)))
    every = parcels.agg(F.collect_set("parcel").alias("every"))
    have = cells.groupBy("subject").agg(F.collect_set("parcel").alias("have"))
    lacking = have.crossJoin(F.broadcast(every)).select("subject", F.explode(F.array_except("every", "have")).alias("parcel"))
    return own.select("subject", "parcel", spread.alias("x")).unionByName(lacking.withColumn("x", F.array_repeat(F.lit(0.0), length)))


def long(series: DataFrame, x: str = "x") -> DataFrame:
    """(subject, parcel, t, v) of series."""
    return series.select("subject", "parcel", F.posexplode(x).alias("t", "v"))


def population_statistics(series: DataFrame) -> DataFrame:
    """(parcel, med, iqr): means over subjects of each subject's median and interquartile range."""
    own = series.select("parcel", arrays.quantile(F.col("x"), 0.5).alias("m"), (arrays.quantile(F.col("x"), 0.75) - arrays.quantile(F.col("x"), 0.25)).alias("d"))
    return own.groupBy("parcel").agg(F.avg("m").alias("med"), F.avg("d").alias("iqr"))


#: Size of a quantile sketch, and the rank error that its quantiles stay within (0.4 per cent with odds of 0.99 at this size; twice and
#: more of it here, so that many quantiles can be asked for).
SKETCH, RANK_ERROR = 800, 0.01


def quantile_sketches(frame: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(by, sketch): mergeable sketches (KLL) of the values' quantiles, of a few KB whatever the rows; combined before the shuffle.
    Kept for each batch, they stand for it: later statistics read sketches and no rows."""
    return frame.where(F.col(v).isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(v).cast("double"), SKETCH).alias("sketch"))


def merged_statistics(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, q25, med, q75, iqr) of all batches together, from their sketches. Ranks are off by RANK_ERROR at most."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SKETCH).alias("_all"))
    at = lambda q: F.kll_sketch_get_quantile_double("_all", F.lit(q))
    return merged.select(*by, F.kll_sketch_get_n_double("_all").alias("n"), at(0.25).alias("q25"), at(0.5).alias("med"), at(0.75).alias("q75")).withColumn("iqr", F.col("q75") - F.col("q25"))


def robust_scaled(series: DataFrame, stats: DataFrame | None = None, required: bool = False) -> DataFrame:
    """Median and interquartile scaling: by the population's statistics where a parcel has both, else by the series'
    own. required: statistics must be given. stats has one row for each parcel."""
    if stats is None:
        if required:
            raise ValueError("population statistics are required")
        return series.withColumn("x", arrays.robust_scaled(F.col("x")))
    joined = series.join(stats, "parcel", "left")
    return joined.withColumn("x", arrays.robust_scaled(F.col("x"), F.col("med"), F.col("iqr"))).drop("med", "iqr")


def zscored(series: DataFrame) -> DataFrame:
    return series.withColumn("x", arrays.zscore(F.col("x")))


def windowed(series: DataFrame, n: int, method: str = "center", pad: str = "right") -> DataFrame:
    return series.withColumn("x", arrays.pad_or_crop(F.col("x"), n, method, pad))


def matrices(series: DataFrame) -> DataFrame:
    """(subject, m): a subject's series in the order of their parcels."""
    return series.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("parcel", "x"))), lambda s: s["x"]).alias("m"))


def parcellate(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, voxel, t, v) and (voxel, label) to (subject, parcel, t, v): means over the voxels of a label; label 0 is
    background."""
    return voxels.join(labels.where("label <> 0"), "voxel").groupBy("subject", F.col("label").alias("parcel"), "t").agg(F.avg("v").alias("v"))


def parcellate_two(voxels: DataFrame, first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Two atlases side by side; the second's labels are shifted."""
    return parcellate(voxels, first).unionByName(parcellate(voxels, second.withColumn("label", F.when(F.col("label") == 0, 0).otherwise(F.col("label") + offset))))


def confounds_removed(frame: DataFrame, m: str = "m", confounds: str = "confounds") -> DataFrame:
    """Residuals of every row of matrix m on the confounds (time x k) and a constant; rows without confounds stay."""
    schema = frame.schema
    names = frame.columns

    def residual(rows, regressors):
        y = np.asarray(rows, np.float64).T
        if not regressors or not len(regressors[0]):
            return rows
        x = np.column_stack([np.ones(len(y)), np.nan_to_num(np.asarray(regressors, np.float64))])
        return (y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).T.tolist()

    def run(batches):
        for batch in batches:
            got = [residual(a, c) if a is not None else None for a, c in zip(batch.column(m).to_pylist(), batch.column(confounds).to_pylist(), strict=True)]
            at = names.index(m)
            yield batch.set_column(at, batch.schema.field(at), pa.array(got, batch.schema.field(at).type))

    return frame.mapInArrow(run, schema)


def preprocessed(series: DataFrame, n: int, stats: DataFrame | None = None, detrend: bool = False, fallback: bool = True, pad: str = "right", method: str = "center") -> DataFrame:
    """Detrend if asked, scale (robust by population statistics; without them by own ones only with fallback), window."""
    if detrend:
        series = series.withColumn("x", arrays.detrended(F.col("x")))
    if stats is not None or fallback:
        series = robust_scaled(series, stats)
    return windowed(series, n, method, pad)


def bandpassed(series: DataFrame, low: float = 0.01, high: float = 0.1, tr: float | None = None) -> DataFrame:
    """Series detrended and restricted to frequencies from low to high (Hz) by their spectrum. tr: seconds between values, or
    a column ``tr``; a missing or implausible one is 2 seconds."""
    frame = series if tr is None else series.withColumn("tr", F.lit(float(tr)))
    frame = frame.withColumn("tr", arrays.repetition_time(F.col("tr").cast("double"))).withColumn("x", arrays.detrended(F.col("x")))
    names = frame.columns

    def run(batches):
        for batch in batches:
            out = []
            for x, step in zip(batch.column(names.index("x")).to_pylist(), batch.column(names.index("tr")).to_pylist(), strict=True):
                if not x:
                    out.append(x)
                    continue
                spectrum = np.fft.rfft(x)
                tone = np.fft.rfftfreq(len(x), step)
                out.append(np.fft.irfft(np.where((tone >= low) & (tone <= high), spectrum, 0), len(x)).tolist())
            at = names.index("x")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return frame.mapInArrow(run, frame.schema).drop(*([] if tr is None else ["tr"]))


def denoised(series: DataFrame) -> DataFrame:
    """Detrended, then z-scored by the sample deviation."""
    return series.withColumn("x", arrays.sample_zscore(arrays.detrended(F.col("x"))))


def subjects_prepared(voxels: DataFrame, labels: DataFrame, length: int, n: int, confounds: DataFrame | None = None, stats: DataFrame | None = None, pad: str = "right") -> DataFrame:
    """(subject, m) ready for an encoder, from (subject, voxel, t, v) and (voxel, label): parcel means, residuals on the
    subject's confounds (subject, confounds) if given, scaling by the population's statistics or the series' own, and a
    window of n values."""
    cells = parcellate(voxels, labels)
    parcels = labels.where("label <> 0").select(F.col("label").alias("parcel")).distinct()
    series = dense_series(cells, length, parcels)
    if confounds is not None:
        whole = series.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("parcel", "x"))).alias("s"))
        whole = whole.join(confounds.select("subject", "confounds"), "subject", "left").select("subject", F.col("s.parcel").alias("parcels"), F.col("s.x").alias("m"), "confounds")
        cleaned = confounds_removed(whole)
        series = cleaned.select("subject", F.explode(F.arrays_zip(F.col("parcels").alias("parcel"), F.col("m").alias("x"))).alias("e")).select("subject", "e.parcel", "e.x")
    return matrices(preprocessed(series, n, stats, pad=pad))


# ---- voxel tables ---------------------------------------------------------------------------------------------------


def resampled(voxels: DataFrame, affine: list[list[float]], shape: tuple[int, int, int], by: list[str] | None = None) -> DataFrame:
    """(by, i, j, k, v) on a new grid of this shape, by trilinear interpolation. voxels: (by, i, j, k, v), absent ones being 0;
    affine: three rows of four that map a place of the new grid to one of the old.

    Each new place spreads to its eight neighbours on the old grid with their weights, which meet the voxels in one equi-join on
    the coordinates, and are summed, combined before the shuffle. Places without any voxel near are left out (their value is 0), so
    work grows with the voxels and not with the box around them. The grid's places are made in parallel from a range."""
    by, spark = by or [], voxels.sparkSession
    ni, nj, nk = shape
    at = spark.range(ni * nj * nk).select(F.floor(F.col("id") / (nj * nk)).cast("int").alias("i"), (F.floor(F.col("id") / nk) % nj).cast("int").alias("j"), (F.col("id") % nk).cast("int").alias("k"))
    old = at.select("i", "j", "k", *[(F.lit(float(a)) * F.col("i") + F.lit(float(b)) * F.col("j") + F.lit(float(c)) * F.col("k") + F.lit(float(d))).alias(n) for n, (a, b, c, d) in zip("xyz", affine, strict=True)])
    corner = F.explode(F.array(*[F.struct(*[F.lit(e).alias(n) for n, e in zip("abc", (p, q, r), strict=True)]) for p in (0, 1) for q in (0, 1) for r in (0, 1)])).alias("e")
    spread = old.select("*", corner)
    near = {n: F.floor(n) + F.col(f"e.{e}") for n, e in zip("xyz", "abc", strict=True)}
    weight = F.lit(1.0)
    for n, e in zip("xyz", "abc", strict=True):
        part = F.col(n) - F.floor(n)
        weight = weight * F.when(F.col(f"e.{e}") == 1, part).otherwise(1 - part)
    eight = spread.select("i", "j", "k", *[near[n].cast("int").alias(f"_{n}") for n in "xyz"], weight.alias("_w")).where("_w > 0")
    own = voxels.where("v is not null").select(*by, F.col("i").cast("int").alias("_x"), F.col("j").cast("int").alias("_y"), F.col("k").cast("int").alias("_z"), F.col("v").cast("double").alias("v"))
    return own.join(eight, ["_x", "_y", "_z"]).groupBy(*by, "i", "j", "k").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
