import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import connectivity, factor, kernel, krr, relational, signals, spd
from signalloom.plans import flows

NAMES = ["IST_fluid", "IST_memory", "IST_crystallised", "IST_intelligence_total"]


@pytest.fixture(scope="module")
def people(spark):
    random = np.random.RandomState(42)
    rows = [(f"sub-{i:04d}", *map(float, r)) for i, r in enumerate(random.normal(100, 10, (100, 4)))]
    return spark.createDataFrame(rows, "participant_id string, " + ", ".join(f"{n} double" for n in NAMES))


def test_factor_has_mean_zero_and_explains(people):
    fitted = factor.fit(people, NAMES)
    scores = [r[0] for r in factor.transform(people, fitted).select("cognition_factor").collect()]
    assert len(scores) == 100 and abs(np.mean(scores)) < 0.5 and fitted.explained > 0.2
    x = np.array([r[1:] for r in people.collect()])
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    expected = z @ vectors[:, -1]
    expected *= np.sign(np.corrcoef(expected, x[:, -1])[0, 1])
    assert np.allclose(sorted(scores), sorted(expected), rtol=1e-8, atol=1e-8)


def test_factor_of_held_out_and_missing(spark, people):
    fitted = factor.fit(people.where("participant_id < 'sub-0080'"), NAMES)
    held = factor.transform(people.where("participant_id >= 'sub-0080'"), fitted).select("cognition_factor").collect()
    assert len(held) == 20 and all(np.isfinite(r[0]) for r in held)
    gaps = spark.createDataFrame([("a", float("nan"), 1.0, 2.0, 3.0), ("b", 2.0, None, 3.0, 5.0), ("c", 3.0, 3.0, 4.0, 4.0)], people.schema)
    got = factor.transform(gaps, factor.fit(gaps, NAMES)).select("cognition_factor").collect()
    assert len(got) == 3 and all(np.isfinite(r[0]) for r in got)


def test_correlation_matrix():
    x = np.random.RandomState(42).randn(50, 100)
    got = connectivity.correlation(x)
    assert np.allclose(got, np.corrcoef(x), atol=1e-12) and np.allclose(np.diag(got), 1)
    x[3] = 7.0
    assert (connectivity.correlation(x)[3] == 0).all()


def test_features_wide_and_narrow_agree(spark):
    random = np.random.RandomState(0)
    rows = [(s, random.randn(6, 20).tolist()) for s in range(4)] + [(9, [[1.0] * 20, list(map(float, range(20)))])]
    frame = spark.createDataFrame(rows, "subject long, m array<array<double>>")
    wide, narrow = ({r.subject: r.features for r in connectivity.fc_features(frame, w).collect()} for w in (True, False))
    assert all(np.allclose(wide[s], narrow[s]) for s in wide) and wide[9] == [0.0]


def test_reconstruction_of_itself(spark):
    x = np.random.RandomState(42).randn(100, 50)
    got = spd.reconstruction(x, x.copy())
    assert got["mse"] == got["mae"] == 0 and got["fc_correlation"] == pytest.approx(1, abs=1e-10) and got["riemannian_distance"] < 1e-5
    with pytest.raises(ValueError, match="shapes"):
        spd.reconstruction(x, x[:, :20])
    frame = spark.createDataFrame([("s", x[:4].tolist(), x[:4].tolist())], "subject string, original array<array<double>>, rebuilt array<array<double>>")
    assert spd.evaluate_reconstruction(frame).first().mse == 0


@pytest.mark.parametrize("n", [50, 30])
def test_spd_distance(n):
    random = np.random.RandomState(42)
    a, b = (m @ m.T + 0.1 * np.eye(n) for m in random.randn(2, n, n))
    assert spd.log_cholesky_distance(a, a) < 1e-10
    assert spd.log_cholesky_distance(a, b) == pytest.approx(spd.log_cholesky_distance(b, a), rel=1e-10)
    assert np.linalg.eigvalsh(spd.regularised(np.diag([1.0, -3.0]))).min() >= 1e-5 * (1 - 1e-9)


def test_kernels_direct_and_by_blocks(spark):
    random = np.random.RandomState(1)
    x = random.randn(23, 7)
    x[5] = 2.0
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    for exact, block in ((True, 5), (False, 5), (True, 100)):
        got = kernel.kernel(frame, exact=exact, block=block).collect()
        assert len(got) == 23 * 24 // 2
        z = kernel.standardised(x)
        full = connectivity.correlation(x) if exact else z @ z.T / 7
        assert all(r.a <= r.b and abs(full[r.a, r.b] - r.k) < 1e-7 for r in got)
    other = frame.where("id < 4")
    assert kernel.kernel(frame, other, block=6).count() == 92


def test_strategy():
    assert kernel.memory_bytes(700, 179, 10_000, 100) == 4 * 100 * 879 + 12 * 699 * 100
    assert kernel.strategy(700, 179, 500, 1000, 20e9) == ("pca", 0)
    name, block = kernel.strategy(700, 179, 500, 3_456_000, 20e9)
    assert name == "blocks" and 2 <= block <= 20


def test_krr_choice_and_prediction(spark):
    random = np.random.RandomState(3)
    x, z = random.randn(60, 8), random.randn(20, 8)
    y = x @ random.randn(8)
    k = kernel.exact_kernel(x)
    alpha, r = krr.choose(k, y)
    best = max(krr.ALPHAS, key=lambda a: _inner(k, y, a))
    assert alpha == best and r == pytest.approx(_inner(k, y, alpha))
    assert krr.choose(k, np.ones(60))[0] == 1.0  # no defined correlation: the middle penalty
    t = z @ np.ones(8)
    rows = [("m", i, "train", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("m", 100 + i, "test", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(z, t))]
    frame = spark.createDataFrame(rows, "method string, subject long, split string, features array<double>, y double")
    got = krr.compare(frame).first()
    p = krr.predict(k, y, kernel.exact_kernel(z, x), alpha)
    assert got.alpha == alpha and got.pearson_r == pytest.approx(np.corrcoef(p, t)[0, 1]) and got.mae == pytest.approx(abs(p - t).mean())
    pre = kernel.kernel(frame.select(F.col("subject").alias("id"), "features")).withColumn("method", F.lit("m"))
    direct = krr.compare_precomputed(pre, frame.select(F.col("subject").alias("id"), "split", "y")).first()
    assert direct.pearson_r == pytest.approx(got.pearson_r) and direct.alpha == got.alpha
    folds = krr.cross_validate(frame).collect()
    assert sorted(r.fold for r in folds) == [-1, 0, 1, 2, 3, 4] and sum(r.n for r in folds if r.fold >= 0) == 80


def _inner(k, y, alpha):
    fold, out = relational.fold_of(len(y)), np.empty(len(y))
    for f in range(5):
        i, o = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        out[o] = k[np.ix_(o, i)] @ np.linalg.solve(k[np.ix_(i, i)] + alpha * np.eye(len(i)), y[i])
    return np.corrcoef(out, y)[0, 1]


def test_folds():
    got = relational.fold_of(10, 5, 42)
    order = np.random.RandomState(42).permutation(10)
    assert all(set(np.flatnonzero(got == f)) == set(order[2 * f : 2 * f + 2]) for f in range(5))
    assert np.bincount(relational.fold_of(11, 4)).tolist() == [3, 3, 3, 2]
    with pytest.raises(ValueError, match="folds"):
        relational.fold_of(3, 5)


def test_random_split_is_the_permutation(spark):
    frame = spark.createDataFrame([(i,) for i in range(50)], "id long")
    got = {r.id for r in relational.random_split(frame, ["id"], 0.2, 42).where("split = 'test'").collect()}
    assert got == set(np.random.RandomState(42).permutation(50)[:10].tolist())


def test_seeded_splits_and_folds_have_no_largest_table(spark, monkeypatch):
    """Beyond a cohort's rows, and in several pieces sent one after the other."""
    for name, value in (("COHORT", 10), ("PIECE", 8), ("SENT", 2)):
        monkeypatch.setattr(relational, name, value, raising=False)
    frame = spark.createDataFrame([(i,) for i in range(50)], "id long")
    order = np.random.RandomState(42).permutation(50)
    got = {r.id for r in relational.random_split(frame, ["id"], 0.2, 42).where("split = 'test'").collect()}
    assert got == set(order[:10].tolist())
    folds = {r.id: r.fold for r in relational.with_folds(frame, ["id"], 7, 42).collect()}
    assert folds == {int(i): k for k, part in enumerate(np.array_split(order, 7)) for i in part}
    assert relational.random_split(frame.limit(0), ["id"]).count() == 0


def test_numbered_and_even_sample_and_ties(spark):
    frame = spark.createDataFrame([(float(i % 3), i) for i in range(40)], "s double, id long").repartition(7)
    got = relational.numbered(frame, ["s", "id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(40)) and [(r.s, r.id) for r in got] == sorted((r.s, r.id) for r in got)
    picked = relational.evenly_spaced(frame, ["s", "id"], 5).collect()
    assert sorted(r.pos for r in picked) == [0, 9, 19, 29, 39]
    assert relational.evenly_spaced(frame, ["s", "id"], 1).count() == 1 and relational.evenly_spaced(frame, ["s", "id"], 99).count() == 40
    assert relational.evenly_spaced(frame.limit(0), ["s", "id"], 5).count() == 0


def test_first_match_wins(spark):
    scores = spark.createDataFrame([("1", 5.0, 0), ("1", 6.0, 1), ("2", 7.0, 2), (None, 8.0, 3)], "id string, score double, pos int")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "subject long")
    got = relational.match_first(ids, scores, "subject", "id", ["pos"], as_text=True).orderBy("subject").collect()
    assert [(r.subject, r.score) for r in got] == [(1, 5.0), (2, 7.0)]


def test_summary_rows_go_and_nulls_stay(spark):
    frame = spark.createDataFrame([("s1",), ("mean",), ("",), (None,), ("STATISTICS",)], "subject string")
    assert {r.subject for r in relational.without_summary_rows(frame).collect()} == {"s1", None}


def test_components_of_wide_matrices(spark):
    random = np.random.RandomState(5)
    x = random.randn(12, 300)
    mean, parts, share = factor.gram_components(x, 5)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(abs(parts), abs(v[:5])) and share == pytest.approx((s[:5] ** 2).sum() / (s**2).sum())
    w, b = factor.ridge(x, x[:, 0], 1.0)
    c = x - x.mean(0)
    assert np.allclose(w, np.linalg.solve(c.T @ c + np.eye(300), c.T @ (x[:, 0] - x[:, 0].mean())))


def test_perceptron_learns_a_line():
    x = np.random.RandomState(0).randn(200, 3)
    y = x @ [1.0, -2.0, 0.5]
    assert krr.metrics(y, factor.perceptron(x, y, epochs=150)(x))["r2"] > 0.9


def test_steps_of_the_perceptron_make_no_new_activations():
    """Its steps follow each other, as many as there are rows: what they compute goes to arrays that are there."""
    import tracemalloc

    net, random = factor.Network(8), np.random.RandomState(0)
    x, y = random.randn(200, 8), random.randn(200)
    start, bias = [w.copy() for w in net.weights], [b.copy() for b in net.biases]

    def step():
        net.gradient(x, y)
        net.step(200)

    step()
    # the first step of Adam is by the sign of the gradient, where that isn't tiny
    hidden = [x]
    for k, w in enumerate(start):
        hidden.append(np.maximum(hidden[-1] @ w + bias[k], 0) if k < 2 else hidden[-1] @ w + bias[k])
    slope = hidden[2].T @ (hidden[3] - y[:, None]) / 200 + 1e-4 * start[2] / 200
    assert np.allclose(net.weights[2], start[2] - 1e-3 * slope / (np.abs(slope) + 1e-8), atol=1e-9)
    tracemalloc.start()
    step()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * 128 * 8


def test_population_statistics_are_means_of_subjects(spark):
    series = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0, 4.0]), ("b", 0, [10.0, 10.0, 10.0, 20.0])], "subject string, parcel int, x array<double>")
    got = signals.population_statistics(series).first()
    assert got.med == pytest.approx((2.5 + 10) / 2) and got.iqr == pytest.approx((1.5 + 2.5) / 2)
    scaled = {r.subject: r.x for r in signals.robust_scaled(series, signals.population_statistics(series)).collect()}
    assert scaled["a"][0] == pytest.approx((1 - 6.25) / (2 + 1e-8))
    with pytest.raises(ValueError, match="required"):
        signals.robust_scaled(series, None, required=True)


def test_robust_scaling_by_population_and_own(spark):
    x = np.random.RandomState(42).normal(50, 10, (4, 200))
    series = spark.createDataFrame([("s", p, r.tolist()) for p, r in enumerate(x)], "subject string, parcel int, x array<double>")
    stats = spark.createDataFrame([(p, 50.0, 13.5) for p in range(4)], "parcel int, med double, iqr double")
    assert abs(np.mean([r.x for r in signals.robust_scaled(series, stats).collect()])) < 1
    assert all(abs(np.median(r.x)) < 0.1 for r in signals.robust_scaled(series).collect())
    assert [len(r.x) for r in signals.preprocessed(series, 160, stats, detrend=True, pad="both").collect()] == [160] * 4


def test_confounds_and_parcels(spark):
    t = np.arange(20.0)
    frame = spark.createDataFrame([("s", [(3 * t + 1).tolist()], [[v] for v in t.tolist()]), ("n", [[1.0, 2.0]], None)], "subject string, m array<array<double>>, confounds array<array<double>>")
    got = {r.subject: r.m for r in signals.confounds_removed(frame).collect()}
    assert np.allclose(got["s"], 0, atol=1e-9) and got["n"] == [[1.0, 2.0]]
    voxels = spark.createDataFrame([("s", 0, 0, 1.0), ("s", 1, 0, 3.0), ("s", 2, 0, 9.0)], "subject string, voxel int, t int, v double")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "voxel int, label int")
    assert [tuple(r) for r in signals.parcellate(voxels, labels).collect()] == [("s", 1, 0, 2.0)]
    assert {r.parcel for r in signals.parcellate_two(voxels, labels, labels, 400).collect()} == {1, 401}


def test_flows(spark, people):
    scores, fitted = flows.prepare_targets(people, "participant_id", NAMES, n_train=10, n_test=5)
    assert {r["split"]: r["count"] for r in scores.groupBy("split").count().collect()} == {"train": 10, "test": 5}
    results = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 5.0), ("mean", 2.0, 2.0)], "subject string, mse double, mae double")
    tables = flows.analyse(results, ["mse", "mae"])
    assert {r.metric for r in tables["summary"].collect()} == {"mse", "mae"} and tables["zscores"].count() == 6 and tables["correlations"].first().marks == ""


def test_bandpass_keeps_its_band(spark):
    t = np.arange(200) * 2.0
    x = np.sin(2 * np.pi * 0.05 * t) + np.sin(2 * np.pi * 0.2 * t)
    series = spark.createDataFrame([("s", 0, x.tolist(), 99.0)], "subject string, parcel int, x array<double>, tr double")
    got = np.array(signals.bandpassed(series).first().x)
    assert np.abs(got - np.sin(2 * np.pi * 0.05 * t)).max() < 0.1
    z = np.array(signals.denoised(series).first().x)
    assert abs(z.mean()) < 1e-9 and abs(z.std(ddof=1) - 1) < 1e-6


def test_encoder_helpers(spark):
    from signalloom.operators import encoders

    frame = spark.createDataFrame([("a", [[1.0, 2.0, 3.0, 4.0]]), ("b", [[5.0]])], "subject string, m array<array<double>>")
    got = {r.subject: r.m for r in encoders.prepared(frame, 2, height=3, channels=2).collect()}
    assert got["a"] == [[[-1, -1], [2, 3], [-1, -1]]] * 2 and got["b"][0][1] == [5, 5]
    with pytest.raises(Exception, match="expected 9 rows"):
        encoders.prepared(frame, 2, rows=9).collect()
    tokens = frame.select(encoders.split_patches(F.get("m", F.lit(0)), 2).alias("t")).first().t
    assert tokens == [[1, 2], [3, 4]]

    def compute(batch):
        if any(len(m[0]) == 1 for m in batch):
            raise ValueError("too short")
        return [m[0] for m in batch]

    got = {r.subject: (r.result, r.error) for r in encoders.applied(frame, compute).collect()}
    assert got == {"a": ([1.0, 2.0, 3.0, 4.0], None), "b": (None, "ValueError: too short")}
    assert [r.subject for r in encoders.ordered(frame).collect()] == ["a", "b"]


def test_shape_helpers(spark):
    from signalloom.functions import arrays

    frame = spark.createDataFrame([([[1.0]], [[2.0]], 0.0), ([[1.0]], [[2.0]], 1.5)], "a array<array<double>>, b array<array<double>>, tr double")
    assert [r[0] for r in frame.select(arrays.repetition_time(F.col("tr"))).collect()] == [2.0, 1.5]
    assert all(r[0] for r in frame.select(arrays.same_shape(F.col("a"), F.col("b"))).collect())
    with pytest.raises(Exception, match="shapes differ"):
        frame.select(arrays.same_shape(F.col("a"), F.array(F.array(F.lit(1.0), F.lit(2.0))))).collect()
    assert frame.select(arrays.constant_padded(F.get("a", F.lit(0)), 4, -1.0)).first()[0] == [-1, 1, -1, -1]


def test_blocks_of_a_kernel_are_not_shuffled_for_each_pair(spark):
    from signalloom.operators import kernel

    frame = spark.range(40).select("id", F.array(*[F.rand(k) for k in range(5)]).alias("features"))
    made = kernel.kernel(frame, block=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and made.count() == 820


def test_a_factor_and_a_product_of_tiles_leave_blocks_where_they_are(spark, monkeypatch):
    """The driver gets the landmarks' rows, not the blocks that hold them, and nothing is broadcast."""
    from signalloom.operators import blockridge, kernel

    monkeypatch.setattr(blockridge, "LANDMARKS", 8)
    random = np.random.default_rng(3)
    x = random.normal(size=(90, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    held = kernel.tiles(frame, size=16)
    real, sent = type(frame).collect, []

    def collect(self):
        rows = real(self)
        sent.extend(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(type(frame), "collect", collect)
    found = [blockridge.factor(held, 0, 90)]
    held.width = 9  # as of wide rows, whose products are taken of blocks
    found.append(blockridge.factor(held, 0, 90))
    assert 0 < sum(sent) <= 8 * 6 * 8 + 8 * 8 * 8
    monkeypatch.undo()
    k = kernel.exact_kernel(x)
    whole = [np.vstack([np.frombuffer(r.c).reshape(16, -1) for r in f.orderBy("p").collect()])[:90] for f in found]
    assert np.allclose(whole[0] @ whole[0].T, k, atol=1e-8) and np.allclose(whole[1] @ whole[1].T, k, atol=1e-8)
    vectors = random.normal(size=(96, 3))
    given = spark.createDataFrame([(p, vectors[p * 16 : p * 16 + 16].tobytes()) for p in range(6)], "p long, v binary")
    made = blockridge.product(held, given)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    got = np.vstack([np.frombuffer(r.data).reshape(16, -1) for r in made.orderBy("p").collect()])[:90]
    assert np.allclose(got, k @ vectors[:90])
