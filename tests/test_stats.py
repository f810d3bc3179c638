import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalloom.functions import stats


def test_beta_closed_forms():
    # I_x(a, 1) = x^a, I_x(1, b) = 1 - (1-x)^b, I_x(1/2, 1/2) = 2/pi asin(sqrt x)
    for x in (0.01, 0.3, 0.5, 0.9, 0.999):
        assert stats.incomplete_beta(3, 1, x) == pytest.approx(x**3, rel=1e-12)
        assert stats.incomplete_beta(1, 4, x) == pytest.approx(1 - (1 - x) ** 4, rel=1e-12)
        assert stats.incomplete_beta(0.5, 0.5, x) == pytest.approx(2 / math.pi * math.asin(math.sqrt(x)), rel=1e-10)
    assert stats.incomplete_beta(2, 3, 0) == 0 and stats.incomplete_beta(2, 3, 1) == 1


@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.001, 0.999))
@settings(max_examples=100, deadline=None)
def test_beta_symmetry(a, b, x):
    assert stats.incomplete_beta(a, b, x) + stats.incomplete_beta(b, a, 1 - x) == pytest.approx(1, abs=1e-9)


def test_p_values():
    # two degrees of freedom: p = 1 - |r|
    assert stats.correlation_p(0.6, 4) == pytest.approx(0.4, rel=1e-12)
    assert math.isnan(stats.correlation_p(0.5, 2))
    assert stats.correlation_p(1.0, 10) == 0.0


def test_ranks_share_ties():
    assert stats.ranks(np.array([2.0, 3.0, 3.0, 9.0])).tolist() == [1, 2.5, 2.5, 4]


def test_constant_columns_do_not_throw(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = frame.agg(stats.pearson("a", "b").alias("r"), stats.r2(F.col("a"), F.col("b")).alias("r2"), stats.r2(F.col("a"), F.col("a")).alias("same")).first()
    assert (got.r, got.r2, got.same) == (0.0, 0.0, 1.0)


def test_metrics_of_copies_and_noise(spark):
    from signalloom.operators import metrics

    random = np.random.RandomState(42)
    y = random.randn(50)
    p = y + 0.5 * random.randn(50)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y_true double, y_pred double")
    got = metrics.prediction_metrics(frame).first()
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.pearson_r == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert got.mape == pytest.approx((abs(y - p) / abs(y)).mean())
    copy = metrics.prediction_metrics(frame.withColumn("y_pred", F.col("y_true"))).first()
    assert copy.r2 == 1 and copy.mae == 0


def test_spearman_of_groups_and_of_all_rows(spark):
    from signalloom.operators import metrics

    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, y_true double, y_pred double")
    got = {r.g: r.spearman_r for r in metrics.spearman(frame, ["g"]).collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1, 2, 3], [1.5, 1.5, 3])[0, 1]) and got["b"] == 0.0
    y, p = (stats.ranks(np.array([r[k] for r in rows])) for k in (1, 2))
    assert metrics.spearman_global(frame).first().spearman_r == pytest.approx(np.corrcoef(y, p)[0, 1])


def test_summary_of_three_rows(spark):
    from signalloom.operators import metrics

    names = ["mse", "mae", "fc_correlation", "riemannian_distance"]
    frame = spark.createDataFrame([(1.0, 0.8, 0.5, 10.0), (2.0, 1.2, 0.6, 12.0), (1.5, 1.0, 0.55, 11.0)], ", ".join(f"{n} double" for n in names))
    got = {r.metric: r for r in metrics.summary(frame, names).collect()}["mse"]
    assert (got.mean, got.median, got.min, got.max) == (1.5, 1.5, 1.0, 2.0)
    assert got.std == pytest.approx(np.std([1, 2, 1.5]))


def test_stars_and_buckets(spark):
    frame = spark.createDataFrame([(0.0005, 0.45), (0.005, 0.35), (0.04, 0.25), (0.5, 0.1)], "p double, r double")
    got = [tuple(r) for r in frame.select(stats.stars(F.col("p"), "n.s."), stats.assessment(F.col("r"))).collect()]
    assert got == [("***", "excellent"), ("**", "good"), ("*", "moderate"), ("n.s.", "weak")]


def test_baseline_and_histogram_and_box(spark):
    from signalloom.operators import metrics

    frame = spark.createDataFrame([("fc_input", 0.25), ("cls", 0.1)], "method string, pearson_r double")
    got = {r.method: r for r in metrics.against_baseline(frame, "fc_input").collect()}
    assert got["cls"].delta == pytest.approx(-0.15) and got["cls"].delta_text == "-0.1500" and got["fc_input"].delta_text == "+0.0000"
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in metrics.histogram(same, "v").collect()] == [(0, 2)]
    values = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    row = metrics.box(values, ["v"]).first()
    assert (row.q1, row["median"], row.q3, row.low, row.high) == (2.0, 3.0, 4.0, 1.0, 4.0)


def test_spearman_keeps_rows_whose_values_change_when_computed_again(spark):
    """As sums of doubles do in their last digits, by the order in which a cluster's parts arrive."""
    import random

    from signalloom.operators import metrics

    again = F.udf(lambda v: v + random.random(), "double").asNondeterministic()
    frame = spark.range(200).select((F.col("id") % 2).alias("g"), again(F.col("id").cast("double")).alias("y_true"), again(F.col("id").cast("double")).alias("y_pred"))
    assert metrics.spearman_global(frame).first().n == 200
    assert {(r.g, r.n) for r in metrics.spearman_global(frame, by=["g"]).collect()} == {(0, 100), (1, 100)}
