import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalloom.functions import arrays


def one(spark, column, **values):
    names = list(values)
    kinds = {1: "array<double>", 2: "array<array<double>>", 0: "double"}
    depth = lambda v: 0 if not isinstance(v, list) else 2 if v and isinstance(v[0], list) else 1
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[depth(values[n])]}" for n in names))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(("method", "first"), [("center", 5), ("start", 0), ("end", 10)])
def test_crop(spark, method, first):
    x = [float(v) for v in range(20)]
    assert one(spark, arrays.pad_or_crop(F.col("x"), 10, method), x=x) == x[first : first + 10]


def test_random_crop_is_a_slice(spark):
    x = [float(v) for v in range(20)]
    got = one(spark, arrays.pad_or_crop(F.col("x"), 7, "random", seed=3), x=x)
    assert got == x[int(got[0]) : int(got[0]) + 7]


def test_two_pads(spark):
    assert one(spark, arrays.pad_or_crop(F.col("x"), 6, pad="right"), x=[1.0, 2.0, 3.0]) == [1, 2, 3, 3, 3, 3]
    assert one(spark, arrays.pad_or_crop(F.col("x"), 6, pad="both"), x=[1.0, 2.0, 3.0]) == [1, 1, 2, 3, 3, 3]
    with pytest.raises(ValueError, match="unknown"):
        arrays.pad_or_crop(F.col("x"), 6, "middle")


def test_marked_signal_keeps_its_marks(spark):
    x = [1.0 if 50 <= t < 250 else 0.0 for t in range(300)]
    assert sum(one(spark, arrays.pad_or_crop(F.col("x"), 200), x=x)) == 200


@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=40))
@settings(max_examples=15, deadline=None)
def test_scalings_match_numpy(spark, x):
    a = np.array(x)
    q1, m, q3 = np.quantile(a, [0.25, 0.5, 0.75])
    assert np.allclose(one(spark, arrays.zscore(F.col("x")), x=x), (a - a.mean()) / (a.std() + 1e-8), rtol=1e-6, atol=1e-3)
    assert np.allclose(one(spark, arrays.robust_scaled(F.col("x")), x=x), (a - m) / (q3 - q1 + 1e-8), rtol=1e-6, atol=1e-3)


def test_constant_series(spark):
    assert one(spark, arrays.zscore(F.col("x")), x=[5.0, 5.0]) == [0.0, 0.0]
    assert one(spark, arrays.detrended(F.col("x")), x=[5.0]) == [0.0]


def test_detrend_removes_a_line(spark):
    got = one(spark, arrays.detrended(F.col("x")), x=[3.0 + 2 * t for t in range(10)])
    assert np.allclose(got, 0, atol=1e-9)


def test_matrix_shapes(spark):
    m = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    assert one(spark, arrays.transpose(F.col("m")), m=m) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, arrays.oriented(F.col("m"), 3), m=m) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, arrays.reshape(F.col("x"), 2), x=[1.0, 2.0, 3.0, 4.0]) == [[1, 2], [3, 4]]
    assert one(spark, arrays.mean_pool(F.col("m")), m=m) == [2.5, 3.5, 4.5]
    assert one(spark, arrays.repeat_blocks(F.col("x"), 2), x=[1.0, 2.0]) == [1, 2, 1, 2]
    assert one(spark, arrays.moving_average(F.col("x"), 1), x=[1.0, 2.0, 6.0]) == [1.5, 3, 4]


@pytest.mark.parametrize(
    ("m", "message"),
    [([[1.0, 2.0], [3.0, 4.0]], "Valid"), ([[1.0, 2.0, 3.0]] * 3, "Expected 2 parcels, got shape (3, 3)"), ([[1.0, float("nan")], [1.0, float("nan")]], "Data contains 2 NaN values"), ([[1.0, float("inf")], [1.0, 2.0]], "Data contains infinite values"), ([[1.0], [1.0, 2.0]], "Expected 2D array")],
)
def test_validate(spark, m, message):
    got = one(spark, arrays.validate(F.col("m"), 2), m=m)
    assert got.message == message and got.is_valid == (message == "Valid")


def test_sincos(spark):
    got = one(spark, arrays.sincos_encoding(F.col("p"), 4), p=3.0)
    assert np.allclose(got, [np.sin(3), np.sin(3 / 100), np.cos(3), np.cos(3 / 100)])


def test_an_array_is_computed_once(spark):
    """Each function mentions its argument once, as a mention in a lambda is computed for each element."""
    x = F.col("series")
    made = [f(x) for f in (arrays.mean, arrays.deviation, arrays.zscore, arrays.sample_zscore, arrays.robust_scaled, arrays.transpose, arrays.moving_average, arrays.detrended)] + [arrays.quantile(x, 0.5), arrays.reshape(x, 2)]
    assert [str(c).count("series") for c in made] == [1] * len(made)
