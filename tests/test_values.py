"""Queries that SQL can't express, against plain numpy over the same tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.plans import views
from signalloom.plans.queries import QUERIES

D = "/root/testdata/sf0.001"
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


@pytest.fixture(scope="module")
def data(spark):
    rows = sorted(views.features(spark, D).collect(), key=lambda r: r.subject)
    x = np.array([r.features for r in rows])
    patches = x.reshape(len(x), 8, 8)
    unit = patches / (np.linalg.norm(patches, axis=2, keepdims=True) + 1e-8)
    similar = np.array([(u @ u.T)[np.tril_indices(8, -1)] for u in unit])
    test = np.array([r.split == "test" for r in rows])
    return {"ids": [r.subject for r in rows], "y": np.array([r.y for r in rows]), "test": test, "sets": {"fc_input": x, "patch_mean": patches.mean(axis=1), "similarity": similar}}


def standard(x):
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-8)


def pearson_kernel(a, b):
    return np.corrcoef(standard(a), standard(b))[: len(a), len(a) :]


def folds(n, k, seed=42):
    return np.array_split(np.random.RandomState(seed).permutation(n), k)


def solve(k, y, new, alpha):
    return new @ np.linalg.inv(k + alpha * np.eye(len(y))) @ y


def chosen(k, y, inner):
    best = (-2.0, None)
    for alpha in ALPHAS:
        out = np.zeros(len(y))
        for o in folds(len(y), inner):
            i = np.setdiff1d(np.arange(len(y)), o)
            out[o] = solve(k[np.ix_(i, i)], y[i], k[np.ix_(o, i)], alpha)
        r = np.corrcoef(out, y)[0, 1]
        if r > best[0]:
            best = (r, alpha)
    return best[1]


def fitted(x, y, z, inner=5):
    k = pearson_kernel(x, x)
    alpha = chosen(k, y, inner)
    return solve(k, y, pearson_kernel(z, x), alpha), alpha


def scores(y, p):
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    return {"r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "pearson_r": np.corrcoef(y, p)[0, 1], "spearman_r": np.corrcoef(rank(y), rank(p))[0, 1], "mae": np.abs(y - p).mean()}


def near(row, want, tolerance=1e-6):
    for name, value in want.items():
        assert abs(row[name] - value) < tolerance, (name, row[name], value)


def test_krr_predict(spark, data):
    x, y, t = data["sets"]["fc_input"], data["y"], data["test"]
    p, alpha = fitted(x[~t], y[~t], x[t])
    got = sorted(QUERIES["krr_predict"](spark, D).collect(), key=lambda r: r.subject)
    assert [r.subject for r in got] == [i for i, own in zip(data["ids"], t) if own] and {r.alpha for r in got} == {alpha}
    assert np.abs(np.array([r.y_pred for r in got]) - p).max() < 2e-6


def p_value(r, n, steps=200_000):
    """By the trapezoidal rule over the density of uncorrelated pairs."""
    f = lambda a: np.trapezoid((1 - (g := np.linspace(a, 1, steps)) ** 2) ** ((n - 4) / 2), g)
    return f(abs(r)) / f(0)


def test_krr_compare_methods(spark, data):
    got = {r.method: r for r in QUERIES["krr_compare_methods"](spark, D).collect()}
    y, t, base = data["y"], data["test"], None
    for name, x in data["sets"].items():
        p, alpha = fitted(x[~t], y[~t], x[t])
        want = scores(y[t], p)
        near(got[name], want)
        assert got[name].alpha == alpha and (got[name].n_train, got[name].n_test) == ((~t).sum(), t.sum())
        assert abs(got[name].pearson_p - p_value(want["pearson_r"], t.sum())) < 1e-6 and abs(got[name].spearman_p - p_value(want["spearman_r"], t.sum())) < 1e-6
        base = want["pearson_r"] if base is None else base
        assert abs(got[name].delta - (want["pearson_r"] - base)) < 1e-6


def test_methods_are_fitted_once(spark):
    """One pass over the features for all folds and penalties, one that scores them where they are; no group of a method's rows."""
    from signalloom.operators import krr

    calls, real = [], krr.grams
    krr.grams = lambda *a: calls.append(1) or real(*a)
    try:
        plan = krr._fitted(views.features(spark, D).withColumn("method", F.lit("m")), krr.ALPHAS, 5, 42)._jdf.queryExecution().executedPlan().toString()
    finally:
        krr.grams = real
    assert len(calls) == 1 and plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


def test_krr_precomputed(spark, data):
    (got,) = QUERIES["krr_precomputed"](spark, D).collect()
    x, y, t = data["sets"]["fc_input"], data["y"], data["test"]
    near(got, scores(y[t], fitted(x[~t], y[~t], x[t])[0]))


def test_a_kernel_in_tiles_is_not_stored(spark, monkeypatch):
    """The same as by kernel rows, whose blocks are."""
    from signalloom.operators import blockridge, kernel, krr

    monkeypatch.setattr(blockridge, "LANDMARKS", 64)
    base = views.features(spark, D)
    few = base.where("subject < 60").withColumn("features", F.when(F.col("subject") != 7, F.col("features")))
    targets = few.withColumnRenamed("subject", "id")
    rows = krr.compare_precomputed(kernel.kernel(few, key="subject").withColumn("method", F.lit("embedding")), targets).first()
    tiles = krr.compare_precomputed({"embedding": kernel.tiles(few, key="subject", size=16)}, targets).first()
    assert rows.alpha == tiles.alpha and all(rows[c] == pytest.approx(tiles[c], rel=1e-6) for c in ("inner_r", "train_r2", "r2", "pearson_r", "mae"))
    real, kept = blockridge._spread, []
    monkeypatch.setattr(blockridge, "_spread", lambda blocks: kept.append(1) or real(blocks))
    QUERIES["krr_precomputed"](spark, D).collect()
    assert not kept


@pytest.fixture
def wide(spark, monkeypatch):
    """Features of more columns than rows (products of the embedding's values), whose kernels have no small rank."""
    from signalloom.operators import blockridge, krr

    monkeypatch.setattr(krr, "RANK", 32)
    monkeypatch.setattr(blockridge, "BLOCK", 48)
    monkeypatch.setattr(blockridge, "LANDMARKS", 60)
    rows = views.features(spark, D).where("subject < 90")
    own = rows.withColumn("features", F.flatten(F.transform(F.slice("features", 1, 16), lambda a: F.transform("features", lambda b: a * b)))).withColumn("method", F.lit("wide"))
    held = sorted(own.collect(), key=lambda r: r.subject)
    return own, np.array([r.features for r in held]), np.array([r.y for r in held]), np.array([r.split == "test" for r in held])


def inner_r(k, y, alpha, inner=5):
    out = np.zeros(len(y))
    for o in folds(len(y), inner):
        i = np.setdiff1d(np.arange(len(y)), o)
        out[o] = solve(k[np.ix_(i, i)], y[i], k[np.ix_(o, i)], alpha)
    return np.corrcoef(out, y)[0, 1]


def test_wide_features_by_kernel_blocks(spark, wide):
    from signalloom.operators import krr

    frame, x, y, t = wide
    got = krr.compare(frame, alphas=(1.0, 10.0)).first()
    alpha = max((1.0, 10.0), key=lambda a: inner_r(pearson_kernel(x[~t], x[~t]), y[~t], a))
    near(got, scores(y[t], solve(pearson_kernel(x[~t], x[~t]), y[~t], pearson_kernel(x[t], x[~t]), alpha)))
    near(got, {"train_r2": scores(y[~t], solve(pearson_kernel(x[~t], x[~t]), y[~t], pearson_kernel(x[~t], x[~t]), alpha))["r2"]})
    assert got.alpha == alpha


def test_nested_folds_by_kernel_blocks(spark, wide):
    from signalloom.operators import krr

    frame, x, y, _ = wide
    got = {r.fold: r for r in krr.cross_validate(frame, outer=3, inner=2, alphas=(1.0, 10.0)).collect()}
    place = folds(len(y), 3)
    for k, o in enumerate(place):
        o = np.sort(o)
        i = np.setdiff1d(np.arange(len(y)), o)
        kernel = pearson_kernel(x[i], x[i])
        best = (-2.0, None)
        for alpha in (1.0, 10.0):
            out = np.zeros(len(i))
            for h in folds(len(i), 2):
                own = np.setdiff1d(np.arange(len(i)), h)
                out[h] = solve(kernel[np.ix_(own, own)], y[i][own], kernel[np.ix_(h, own)], alpha)
            r = np.corrcoef(out, y[i])[0, 1]
            best = max(best, (r, alpha), key=lambda z: z[0])
        want = scores(y[o], solve(kernel, y[i], pearson_kernel(x[o], x[i]), best[1]))
        near(got[k], {n: want[n] for n in ("r2", "pearson_r", "mae")})
        assert got[k].alpha == best[1] and got[k].n == len(o)


def test_both_ways_agree_and_constant_rows_are_zero(spark, monkeypatch):
    from signalloom.operators import blockridge, krr

    frame = views.features(spark, D).where("subject < 120").withColumn("method", F.lit("m"))
    frame = frame.withColumn("features", F.when(F.col("subject") % 40 == 7, F.transform("features", lambda v: F.lit(2.0))).otherwise(F.col("features")))
    one = krr.compare(frame).first()
    monkeypatch.setattr(krr, "RANK", 8)
    monkeypatch.setattr(blockridge, "BLOCK", 50)
    two = krr.compare(frame).first()
    far = {c: (one[c], two[c]) for c in one.asDict() if one[c] != two[c] and not (isinstance(one[c], float) and abs(one[c] - two[c]) < 1e-6 * max(1, abs(one[c])))}
    assert not far


def test_krr_cv(spark, data):
    got = {r.fold: r for r in QUERIES["krr_cv"](spark, D).collect()}
    x, y = data["sets"]["fc_input"], data["y"]
    pooled = np.zeros(len(y))
    for k, o in enumerate(folds(len(y), 5)):
        o = np.sort(o)
        i = np.setdiff1d(np.arange(len(y)), o)
        pooled[o], alpha = fitted(x[i], y[i], x[o], 3)
        want = scores(y[o], pooled[o])
        near(got[k], {n: want[n] for n in ("r2", "pearson_r", "mae")})
        assert got[k].alpha == alpha and got[k].n == len(o)
    want = scores(y, pooled)
    near(got[-1], {n: want[n] for n in ("r2", "pearson_r", "mae")})


def components(x, k):
    mean = x.mean(axis=0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:k], (s[:k] ** 2).sum() / (s**2).sum()


def test_flat_pca(spark, data):
    x, t = data["sets"]["fc_input"], data["test"]
    mean, parts, share = components(x[~t], 10)
    parts = parts * np.sign(parts[np.arange(10), np.abs(parts).argmax(axis=1)])[:, None]
    want = (x - mean) @ parts.T
    got = np.zeros_like(want)
    place = {s: k for k, s in enumerate(data["ids"])}
    for r in QUERIES["flat_pca"](spark, D).collect():
        got[place[r.subject], r.component] = r.v
        assert abs(r.explained - share) < 2e-6
    assert np.abs(got - want).max() < 2e-6


def test_wide_components_agree_with_tall_ones(spark, monkeypatch):
    from signalloom.operators import blockridge, factor

    table = lambda: {r.subject: (r.split, r.components, r.explained) for r in factor.flat_components(views.features(spark, D), 4).collect()}
    tall = table()
    monkeypatch.setattr(factor, "TALL", 8)
    monkeypatch.setattr(blockridge, "BLOCK", 70)
    wide = table()
    assert set(wide) == set(tall)
    for i, (split, parts, share) in tall.items():
        assert wide[i][0] == split and abs(wide[i][2] - share) < 1e-8 and np.abs(np.array(wide[i][1]) - np.array(parts)).max() < 1e-7


def test_range_finder_converges_below_full_rank(spark, wide, monkeypatch):
    """More learning rows than columns of the range: subspace iterations until the components stand."""
    from signalloom.operators import factor, rangefinder

    frame, x, _, t = wide
    monkeypatch.setattr(factor, "TALL", 8)
    monkeypatch.setattr(rangefinder, "LEAST", 24)
    mean, parts, share = components(x[~t], 3)
    parts = parts * np.sign(parts[np.arange(3), np.abs(parts).argmax(axis=1)])[:, None]
    got = sorted(factor.flat_components(frame, 3).collect(), key=lambda r: r.subject)
    assert np.abs(np.array([r.components for r in got]) - (x - mean) @ parts.T).max() < 1e-4
    assert abs(got[0].explained - share) < 1e-7


def test_extended_compare(spark, data):
    got = {r.method: r for r in QUERIES["extended_compare"](spark, D).collect()}
    x, y, t = data["sets"]["fc_input"], data["y"], data["test"]
    mean, parts, _ = components(x[~t], 20)
    parts = parts * np.sign(parts[np.arange(20), np.abs(parts).argmax(axis=1)])[:, None]
    for name, z in [*data["sets"].items(), ("flat_patches", (x - mean) @ parts.T)]:
        near(got[name], scores(y[t], fitted(z[~t], y[~t], z[t])[0]), 1e-5)


def linear(x, y, alpha):
    mean = x.mean(axis=0)
    c = x - mean
    w = np.linalg.lstsq(np.vstack((c, np.sqrt(alpha) * np.eye(x.shape[1]))), np.concatenate((y - y.mean(), np.zeros(x.shape[1]))), rcond=None)[0]
    return lambda z: (z - mean) @ w + y.mean()


@pytest.mark.parametrize(("query", "alpha", "k"), [("ridge_pca", 1.0, 20), ("linear_predictor", 0.0, None)])
def test_predictors(spark, data, query, alpha, k):
    got = {r.method: r for r in QUERIES[query](spark, D).collect()}
    y, t = data["y"], data["test"]
    for name, x in data["sets"].items():
        dev = x[~t].std(axis=0)
        z = (x - x[~t].mean(axis=0)) / np.where(dev > 0, dev, 1)
        if k and k < z.shape[1]:
            mean, parts, _ = components(z[~t], k)
            z = (z - mean) @ parts.T
        f = linear(z[~t], y[~t], alpha)
        near(got[name], scores(y[t], f(z[t])), 1e-5)
        near(got[name], {"train_r2": scores(y[~t], f(z[~t]))["r2"]}, 1e-5)


def test_perceptron_is_reproducible_and_learns(spark, data):
    one, two = (QUERIES["mlp_predictor"](spark, D).first() for _ in range(2))
    assert one == two and one.train_r2 > 0.05


def test_prepare_targets(spark):
    got = {r.participant_id: r for r in QUERIES["prepare_targets"](spark, D).collect()}
    people = {r.participant_id: [r[c] for c in views.VARIABLES] for r in views.participants(spark, D).collect()}
    cohort = sorted(i for i, v in people.items() if all(x is not None for x in v))
    n = len(cohort)
    place = np.random.RandomState(42).permutation(n)[: int(np.ceil(0.2 * n))]
    test = np.isin(np.arange(n), place)
    x = np.array([people[i] for i in cohort], float)
    z = (x - x[~test].mean(axis=0)) / x[~test].std(axis=0)
    w = np.linalg.svd(z[~test] - z[~test].mean(axis=0), full_matrices=False)[2][0]
    score = z @ (w if w[-1] > 0 else -w)
    want = {}
    for name, part, k in (("train", ~test, 50), ("test", test, 20)):
        own = sorted((score[j], cohort[j]) for j in np.flatnonzero(part))
        for p in {int(i * (len(own) - 1) / (min(k, len(own)) - 1)) for i in range(min(k, len(own)))}:
            want[own[p][1]] = (name, own[p][0])
    assert set(got) == set(want)
    for i, (name, value) in want.items():
        assert got[i].split == name and abs(got[i].cognition_factor - value) < 2e-6


@pytest.mark.parametrize("most", [1024, 4])
def test_ridge_of_the_block_kernel_without_a_row_for_each_pair(spark, monkeypatch, most):
    from signalloom.operators import blockridge, kernel, krr
    from signalloom.plans import flows, views

    monkeypatch.setattr(krr, "RANK", most)
    monkeypatch.setattr(blockridge, "BLOCK", 50)
    base = views.features(spark, D).where("subject < 60")
    rows = base.withColumn("method", F.lit("m"))
    given = krr.compare_precomputed(kernel.kernel(base, key="subject", exact=False).withColumn("method", F.lit("m")), base.withColumnRenamed("subject", "id")).first()
    got = krr.compare(rows, turn=kernel.shared_scale).first()
    assert all(getattr(got, c) == pytest.approx(getattr(given, c), rel=1e-6) for c in ("alpha", "inner_r", "r2", "pearson_r", "mae"))
    if most > 4:
        made = []
        monkeypatch.setattr(kernel, "kernel", lambda *a, **k: made.append(1))
        sets = rows.select("method", "subject", "split", "features", "y")
        out = flows.extended(sets.withColumn("method", F.lit("fc_input")), views.patches(spark, D), base.select("subject", "split", "y"), cap=1000.0, components=5)
        assert {r.method: r.pearson_r for r in out.collect()}["flat_patches"] == pytest.approx(given.pearson_r, rel=1e-6) and not made
