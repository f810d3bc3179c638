"""Expressions on array<double> (a series) and array<array<double>> (a matrix, row by row); all stay in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def doubles(x) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def let(value, body) -> Column:
    """body(value), with the value computed once a row; a plain column inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(f):
    """f with its first argument computed once a row: an argument that is an expression of its own, or becomes one where a filter
    is pushed below the projection that made it, is else computed again for each mention, and in a lambda for each element."""

    @functools.wraps(f)
    def run(x, *rest, **named) -> Column:
        return let(x, lambda value: f(value, *rest, **named))

    return run


def total(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


@_once
def mean(x) -> Column:
    return F.try_divide(total(x), F.size(x))


@_once
def deviation(x) -> Column:
    """Population standard deviation, in two passes."""
    squares = lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return let(mean(x), lambda m: F.sqrt(F.try_divide(squares(m), F.size(x))))


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


@_once
def quantile(x, q: float) -> Column:
    """Quantile with linear interpolation."""
    at = (F.size(x) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return let(F.array_sort(x), lambda s: F.get(s, low) + (F.get(s, F.least(low + 1, F.size(x) - 1)) - F.get(s, low)) * (at - low))


@_once
def zscore(x) -> Column:
    """(x - mean) / (population deviation + 1e-8)."""
    return let(F.struct(mean(x).alias("m"), deviation(x).alias("d")), lambda s: F.transform(x, lambda v: (v - s["m"]) / (s["d"] + TINY)))


@_once
def sample_zscore(x) -> Column:
    """(x - mean) / sample deviation; 0 where the values are all the same or there is one alone."""
    scale = lambda s: F.sqrt(s["q"] / (F.size(x) - 1))
    own = F.struct(mean(x).alias("m"), (deviation(x) * deviation(x) * F.size(x)).alias("q"))
    return let(own, lambda s: F.transform(x, lambda v: F.when((F.size(x) > 1) & (s["q"] > 0), (v - s["m"]) / scale(s)).otherwise(0.0)))


def reconciled(m, like) -> Column:
    """m cropped to the shape of another matrix."""
    return F.transform(F.slice(m, 1, F.size(like)), lambda row: F.slice(row, 1, F.size(F.get(like, F.lit(0)))))


def first_channel(m) -> Column:
    """The first of several channels of a matrix."""
    return F.get(m, F.lit(0))


@_once
def robust_scaled(x, median=None, iqr=None) -> Column:
    """(x - median) / (interquartile range + 1e-8), by the given statistics if both are there, else by the series' own."""
    own = F.struct(quantile(x, 0.5).alias("m"), (quantile(x, 0.75) - quantile(x, 0.25)).alias("d"))
    if median is not None and iqr is not None:
        own = F.when(median.isNotNull() & iqr.isNotNull(), F.struct(median.cast("double").alias("m"), iqr.cast("double").alias("d"))).otherwise(own)
    return let(own, lambda s: F.transform(x, lambda v: (v - s["m"]) / (s["d"] + TINY)))


def pad_or_crop(x, n: int, method: str = "center", pad: str = "right", seed: int = 0) -> Column:
    """A series of exactly n values. Longer ones are cropped (center, start, end or random), shorter ones repeat their
    edge values (pad right, or both sides with the smaller half on the left). Null and empty series stay as they are."""
    if pad not in ("right", "both"):
        raise ValueError(f"unknown pad: {pad}")
    size = F.size(x)
    begin = {"center": F.floor((size - n) / 2), "start": F.lit(0), "end": size - n, "random": F.floor(F.rand(seed) * (size - n + 1))}
    if method not in begin:
        raise ValueError(f"unknown method: {method}")
    cropped = F.slice(x, begin[method].cast("int") + 1, n)
    missing = F.lit(n) - size
    left = F.floor(missing / 2).cast("int") if pad == "both" else F.lit(0)
    padded = F.concat(F.array_repeat(F.get(x, F.lit(0)), left), x, F.array_repeat(F.get(x, size - 1), missing - left))
    return F.when(x.isNull() | (size == 0), x).when(size >= n, cropped).otherwise(padded)


@_once
def transpose(m) -> Column:
    width = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))).otherwise(F.array().cast("array<array<double>>"))


def oriented(m, rows: int) -> Column:
    """The matrix with so many rows, transposed if only its width fits."""
    return F.when((F.size(m) != rows) & (F.size(F.get(m, F.lit(0))) == rows), transpose(m)).otherwise(m)


@_once
def reshape(x, width: int) -> Column:
    """A series as rows of so many values; the length must be a multiple."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1), lambda k: F.slice(x, k * width + 1, width))


def ravel(m) -> Column:
    return F.flatten(m)


def mean_pool(m) -> Column:
    """Mean of the rows, column by column."""
    return F.transform(transpose(m), lambda column: mean(column))


@_once
def moving_average(x, reach: int = 1) -> Column:
    """Mean over the values up to ``reach`` places away, fewer at the edges."""
    return F.transform(x, lambda v, i: mean(F.slice(x, F.greatest(i - reach, F.lit(0)) + 1, F.least(i + reach, F.size(x) - 1) - F.greatest(i - reach, F.lit(0)) + 1)))


@_once
def detrended(x) -> Column:
    """x less its least-squares line over 0..n-1."""
    n = F.size(x)
    middle = (n - 1) / F.lit(2.0)
    spread = n * (n.cast("double") * n - 1) / 12
    slope = F.coalesce(F.try_divide(F.aggregate(F.transform(x, lambda v, i: v * (i - middle)), F.lit(0.0), lambda a, v: a + v), spread), F.lit(0.0))
    return let(F.struct(mean(x).alias("m"), slope.alias("s")), lambda f: F.transform(x, lambda v, i: v - f["m"] - f["s"] * (i - middle)))


def validate(m, rows: int, min_length: int = 1) -> Column:
    """struct(is_valid, message): shape, then missing values, then infinities, in that order."""
    flat = F.flatten(m)
    missing = F.size(F.filter(flat, lambda v: v.isNull() | F.isnan(v)))
    infinite = F.exists(flat, lambda v: F.abs(v) == float("inf"))
    wide = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    ragged = F.exists(m, lambda r: r.isNull() | (F.size(r) != wide))
    message = (
        F.when(m.isNull() | (F.size(m) == 0), "Data is missing")
        .when(F.coalesce(ragged, F.lit(True)), "Expected 2D array")
        .when((F.size(m) != rows) & (wide != rows), F.concat(F.lit(f"Expected {rows} parcels, got shape ("), F.size(m).cast("string"), F.lit(", "), wide.cast("string"), F.lit(")")))
        .when(wide < min_length, "Series too short")
        .when(missing > 0, F.concat(F.lit("Data contains "), missing.cast("string"), F.lit(" NaN values")))
        .when(F.coalesce(infinite, F.lit(False)), "Data contains infinite values")
        .otherwise("Valid")
    )
    return F.struct((message == "Valid").alias("is_valid"), message.alias("message"))


def sincos_encoding(position, dimensions: int) -> Column:
    """Sine then cosine of position times 10000^(-2i/D), i < D/2."""
    half = F.sequence(F.lit(0), F.lit(dimensions // 2 - 1))
    angle = lambda i: position / F.pow(F.lit(10000.0), 2 * i / F.lit(float(dimensions)))
    return F.concat(F.transform(half, lambda i: F.sin(angle(i))), F.transform(half, lambda i: F.cos(angle(i))))


def sincos_encoding_2d(row, column, dimensions: int) -> Column:
    """A grid place: the column's encoding in the first half of the dimensions, the row's in the second."""
    return F.concat(sincos_encoding(column, dimensions // 2), sincos_encoding(row, dimensions // 2))


def sincos_grid(height: int, width: int, dimensions: int, class_token: bool = False) -> Column:
    """Encodings of all places of a grid, row by row; a zero row for a class token before them if asked."""
    places = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: sincos_encoding_2d(F.floor(k / width).cast("double"), (k % width).cast("double"), dimensions))
    return F.concat(F.array(F.array_repeat(F.lit(0.0), dimensions)), places) if class_token else places


def gather(x, places) -> Column:
    """The values of x at zero-based places, null beyond its ends."""
    return F.transform(places, lambda i: F.get(x, i))


def repeat_blocks(x, times: int) -> Column:
    """The whole array so many times in a row."""
    return F.flatten(F.array_repeat(x, times))


def display_rescaled(x, like) -> Column:
    """x brought to the mean and deviation of another series."""
    return let(F.struct(mean(like).alias("m"), deviation(like).alias("d")), lambda s: F.transform(zscore(x), lambda v: v * s["d"] + s["m"]))


def constant_padded(x, n: int, value: float) -> Column:
    """x in the middle of n values, the smaller half of the constant before it; longer ones stay as they are."""
    missing = F.greatest(F.lit(n) - F.size(x), F.lit(0))
    left = F.floor(missing / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(value), left), x, F.array_repeat(F.lit(value), missing - left))


def one_patch(x) -> Column:
    """A pooled vector as a matrix of one patch."""
    return F.array(x)


def cropped(x, n: int) -> Column:
    """The middle n values; shorter series stay as they are."""
    return F.when(F.size(x) >= n, F.slice(x, F.floor((F.size(x) - n) / 2).cast("int") + 1, n)).otherwise(x)


def replicated(m, channels: int = 3) -> Column:
    return F.array_repeat(m, channels)


def repetition_time(tr, default: float = 2.0) -> Column:
    """The repetition time, or the default where it is missing, 0 or over 10 seconds."""
    return F.when(tr.isNull() | (tr <= 0) | (tr > 10), default).otherwise(tr)


def same_shape(a, b) -> Column:
    """True where two matrices have the same shape; an error where they don't."""
    wide = lambda m: F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    equal = (F.size(a) == F.size(b)) & (wide(a) == wide(b))
    return F.when(equal, True).otherwise(F.raise_error(F.lit("shapes differ")).cast("boolean"))
