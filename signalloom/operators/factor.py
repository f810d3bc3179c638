"""Factor scores without leakage, and linear predictors on components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .krr import RANK, flat, grams, matrices, metrics, r_of, tested


@dataclass
class Factor:
    """What was fitted: for each variable its median, mean, population deviation and loading."""

    columns: list[str]
    median: list[float]
    mean: list[float]
    deviation: list[float]
    loading: list[float]
    explained: float

    def score(self) -> F.Column:
        parts = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) - mu) / (s if s > 0 else 1.0) * w for c, m, mu, s, w in zip(self.columns, self.median, self.mean, self.deviation, self.loading, strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    def table(self, spark) -> DataFrame:
        """(col, median, mean, std, loading), one row for each variable."""
        return spark.createDataFrame(list(zip(self.columns, self.median, self.mean, self.deviation, self.loading, strict=True)), "col string, median double, mean double, std double, loading double")


def fit(frame: DataFrame, columns: list[str]) -> Factor:
    """First principal component of median-imputed, standardised variables; its sign makes the last variable's
    correlation with it non-negative. Two aggregates (medians, then moments); only k x k numbers reach the driver."""
    clean = frame.select([F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    median = clean.agg(*[F.median(c).alias(c) for c in columns]).first()
    median = [float(m) if m is not None else 0.0 for m in median]
    full = clean.na.fill(dict(zip(columns, median, strict=True)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = full.agg(*[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    mean = [float(v) for v in got[: len(columns)]]
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, got[len(columns) :], strict=True):
        cov[i, j] = cov[j, i] = v
    deviation = np.sqrt(np.diag(cov))
    safe = np.where(deviation > 0, deviation, 1)
    values, vectors = np.linalg.eigh(cov / np.outer(safe, safe))
    loading = vectors[:, -1]
    # the correlation of a variable with the component has the sign of its loading
    if loading[-1] < 0:
        loading = -loading
    return Factor(columns, median, mean, deviation.tolist(), loading.tolist(), float(values[-1] / values.sum()))


def transform(frame: DataFrame, factor: Factor, name: str = "cognition_factor") -> DataFrame:
    """Scores by fitted statistics only: one projection."""
    return frame.withColumn(name, factor.score())


# ---- components and linear predictors -------------------------------------------------------------------------------


def gram_components(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, k x d components, explained share) from the n x n Gram matrix; no d x d matrix is made."""
    mean = x.mean(axis=0)
    c = x - mean
    values, vectors = np.linalg.eigh(c @ c.T)
    order = np.argsort(values)[::-1][: min(k, len(x) - 1)]
    use = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    return mean, (vectors[:, use] / np.sqrt(values[use])).T @ c, float(values[use].sum() / np.maximum(values, 0).sum())


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; alpha 0 is least squares of minimum norm."""
    mx, my = x.mean(axis=0), y.mean()
    c, t = x - mx, y - my
    if alpha == 0:
        w = np.linalg.lstsq(c, t, rcond=None)[0]
    elif x.shape[1] <= len(x):
        w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ t)
    else:
        w = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(len(x)), t)
    return w, float(my - mx @ w)


class Network:
    """A rectified network for one number, fitted by Adam on squared errors. Its steps follow each other, so a step is kept short: parameters,
    gradients and moments are one vector each, and what a step computes goes to arrays that were made before."""

    def __init__(self, width: int, hidden=(128, 64), rate: float = 1e-3, penalty: float = 1e-4, seed: int = 42):
        self.random = np.random.RandomState(seed)
        self.rate, self.penalty, self.t = rate, penalty, 0
        sizes = [width, *hidden, 1]
        bound = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]  # noqa: B905
        first = [self.random.uniform(-s, s, (a, b)) for s, a, b in zip(bound, sizes, sizes[1:])]  # noqa: B905
        first += [self.random.uniform(-s, s, b) for s, b in zip(bound, sizes[1:])]  # noqa: B905
        self.values = np.concatenate([p.ravel() for p in first])
        self.slope, self.first, self.second, self.spare, self.other = (np.zeros_like(self.values) for _ in range(5))
        ends = np.cumsum([p.size for p in first])
        views = lambda v: [v[e - p.size : e].reshape(p.shape) for p, e in zip(first, ends.tolist(), strict=True)]
        n = len(sizes) - 1
        self.weights, self.biases = views(self.values)[:n], views(self.values)[n:]
        self.weight_slopes, self.bias_slopes = views(self.slope)[:n], views(self.slope)[n:]
        self.penalised = int(ends[n - 1])
        self.held: dict[int, tuple[list, list, list]] = {}

    def predict(self, z: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = z @ w + b
            z = np.maximum(z, 0) if k < len(self.weights) - 1 else z
        return z[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> None:
        """The mean gradient of a batch, to ``slope``."""
        n, last = len(x), len(self.weights) - 1
        if n not in self.held:
            make = lambda t: [np.empty((n, len(b)), t) for b in self.biases]
            self.held[n] = make(float), make(float), make(bool)
        acts, deltas, live = self.held[n]
        for k, (w, b, a) in enumerate(zip(self.weights, self.biases, acts, strict=True)):
            np.matmul(acts[k - 1] if k else x, w, out=a)
            a += b
            if k < last:
                np.maximum(a, 0, out=a)
        np.subtract(acts[-1], y[:, None], out=deltas[-1])
        deltas[-1] /= n
        for k in range(last, -1, -1):
            np.matmul((acts[k - 1] if k else x).T, deltas[k], out=self.weight_slopes[k])
            deltas[k].sum(axis=0, out=self.bias_slopes[k])
            if k:
                (np.multiply if k == last else np.matmul)(deltas[k], self.weights[k].T, out=deltas[k - 1])  # the last has one column
                np.greater(acts[k - 1], 0, out=live[k - 1])
                deltas[k - 1] *= live[k - 1]

    def step(self, n: int) -> None:
        """One step by the gradient of a whole batch of n."""
        self.t += 1
        g, m, v, a, b, own = self.slope, self.first, self.second, self.spare, self.other, slice(self.penalised)
        np.multiply(self.values[own], self.penalty, out=a[own])
        a[own] /= n
        g[own] += a[own]
        np.subtract(g, m, out=a)
        a *= 0.1
        m += a
        np.multiply(g, g, out=a)
        a -= v
        a *= 0.001
        v += a
        np.divide(m, 1 - 0.9**self.t, out=a)
        a *= self.rate
        np.divide(v, 1 - 0.999**self.t, out=b)
        np.sqrt(b, out=b)
        b += 1e-8
        a /= b
        self.values -= a

    def batches(self, n: int, epochs: int, batch: int):
        for _ in range(epochs):
            order = self.random.permutation(n)
            for s in range(0, n, batch):
                yield order[s : s + batch]


EPOCHS, BATCH = 200, 200


def perceptron(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, **how):
    """The prediction function of a network fitted in one place."""
    net = Network(x.shape[1], **how)
    for at in net.batches(len(x), epochs, batch):
        net.gradient(x[at], y[at])
        net.step(len(at))
    return net.predict


PREDICTOR = "method string, model string, n_components int, train_r2 double, train_r double, r2 double, pearson_r double, pearson_p double, spearman_r double, spearman_p double, mae double, mape double"


def train_predictor(features: DataFrame, model: str = "ridge", components: int | None = None, alpha: float = 1.0) -> DataFrame:
    """(method, subject, split, features, y): standardise, reduce if asked and possible, fit, and report; model is
    ridge, linear or mlp. One row for each method.

    ridge and linear up to RANK columns: moments, components and normal equations all come from one Gram matrix of the learning
    rows, summed in parallel and as a tree, and rows are scored where they are. Wider features and mlp take a method in one
    task, of WHOLE values at most: reduce features by ``flat_components`` before."""
    if model not in ("ridge", "linear", "mlp"):
        raise ValueError(f"unknown model: {model}")
    slim = features.where("features is not null and y is not null").select("method", F.col("subject").cast("long").alias("subject"), "split", F.transform("features", lambda v: v.cast("double")).alias("features"), F.col("y").cast("double").alias("y"))
    widths = {r.method: r for r in slim.groupBy("method").agg(F.max(F.size("features")).alias("width"), F.count("*").alias("n"), F.avg(F.when(F.col("split") == "train", F.col("y"))).alias("mean")).collect()}
    narrow = [m for m, r in widths.items() if r.width <= RANK and model != "mlp" and r.mean is not None]
    others = [m for m in widths if m not in narrow]
    if most := [m for m in others if widths[m].width * widths[m].n > WHOLE]:
        raise ValueError(f"{most[0]}: {widths[most[0]].n} rows of {widths[most[0]].width} values don't fit one task")
    out = _by_sums(slim.where(F.col("method").isin(narrow)), model, components, alpha, {m: widths[m].mean for m in narrow}) if narrow else None
    if others or out is None:
        rest = slim.where(F.col("method").isin(others)).groupBy("method").applyInArrow(_in_a_task(model, components, alpha), PREDICTOR)
        out = rest if out is None else out.unionByName(rest)
    return out


def _in_a_task(model: str, components: int | None, alpha: float):
    def run(key, rows):
        order = np.argsort(rows.column("subject").to_numpy())
        x, y = flat(rows.column("features"))[order], rows.column("y").to_numpy()[order]
        test = (np.array(rows.column("split").to_pylist()) == "test")[order]
        mean, dev = x[~test].mean(axis=0), x[~test].std(axis=0)
        x = (x - mean) / np.where(dev > 0, dev, 1)
        used = x.shape[1]
        k = min(components, int((~test).sum()) - 1, used) if components else used
        if components and k < used:
            middle, parts, _ = gram_components(x[~test], k)
            x, used = (x - middle) @ parts.T, len(parts)
        if model == "mlp":
            predict = perceptron(x[~test], y[~test])
        else:
            w, b = ridge(x[~test], y[~test], alpha if model == "ridge" else 0)
            predict = lambda z: z @ w + b
        p, q = predict(x[~test]), predict(x[test])
        got = {"method": key[0].as_py(), "model": model, "n_components": used, "train_r2": metrics(y[~test], p)["r2"], "train_r": r_of(y[~test], p), **metrics(y[test], q)}
        return pa.Table.from_pylist([got]).cast(pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (c.split() for c in PREDICTOR.split(", "))]))

    return run


def linear_weights(gram: np.ndarray, k: int | None, alpha: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(weights of the features, their means less the shift, mean of the targets less theirs, components used), from a Gram matrix of
    [x - shift, y - shift, 1]: of standardised features, reduced to k components, by ridge or, for alpha 0, least squares of
    minimum norm."""
    d, n = len(gram) - 2, gram[-1, -1]
    mean, middle = gram[:d, -1] / n, gram[d, -1] / n
    cov = gram[:d, :d] - n * np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0) / n)
    scale = np.where(dev > 1e-12 * np.sqrt(np.diag(gram)[:d] / n + 1e-300), dev, 1)
    inner, target = cov / np.outer(scale, scale), (gram[:d, d] - n * mean * middle) / scale
    values, vectors = np.linalg.eigh(inner)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int(n) - 1, d) if k else d
    use = values[:k] > 1e-12 * max(values[0], 1e-300) if k < d else np.full(d, True)
    values, vectors = values[:k][use], vectors[:, :k][:, use]
    whole = values + alpha if alpha else np.where(values > 1e-11 * max(values[0], 1e-300), values, np.inf)
    return vectors @ ((vectors.T @ target) / whole) / scale, mean, float(middle), len(values)


def _by_sums(slim: DataFrame, model: str, components: int | None, alpha: float, means: dict[str, float]) -> DataFrame:
    learn = slim.where("split = 'train'").withColumn("cells", F.array(F.lit(0)))
    # a vector near the mean, so that differences of sums keep their digits: of a few rows of each method
    shifts = {m: flat(learn.where(F.col("method") == m).select("features").limit(64).toArrow().column(0)).mean(axis=0) for m in means}
    sums = grams(learn, means, shifts)
    weights = 0.0 if model == "linear" else alpha

    def fit(key, rows):
        name = key[0].as_py()
        w, mean, middle, used = linear_weights(matrices(rows)[0], components, weights)
        return pa.Table.from_pylist([{"method": name, "w": w.tolist(), "offset": float(means[name] + middle - w @ (shifts[name] + mean)), "used": used}], pa.schema([("method", pa.string()), ("w", pa.list_(pa.float64())), ("offset", pa.float64()), ("used", pa.int32())]))

    known = {r.method: (np.array(r.w), r.offset, r.used) for r in sums.groupBy("method").applyInArrow(fit, "method string, w array<double>, offset double, used int").collect()}

    def score(batches):
        for batch in batches:
            names, x = np.array(batch.column(0).to_pylist(), object), batch.column(3)
            p, used = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                w, offset, used[at] = known[name]
                p[at] = flat(x.take(pa.array(at))) @ w + offset
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p), pa.array(used)], ["method", "split", "y_true", "y_pred", "used"])

    predicted = settled(slim.select("method", "split", "y", "features").mapInArrow(score, "method string, split string, y_true double, y_pred double, used int"))
    return tested(predicted, [F.max("used").alias("n_components")]).withColumn("model", F.lit(model)).select(*[c.split()[0] for c in PREDICTOR.split(", ")])


#: Values that a method may hold in one task, and columns up to which the covariance is summed.
WHOLE, TALL = 200_000_000, 1024


def flat_components(features: DataFrame, k: int) -> DataFrame:
    """(subject, split, components, explained): principal components fitted on the training rows, applied to all. The sign of a
    component is free: its largest loading is made positive. Up to TALL columns the covariance is summed in parallel and
    rows are projected where they are; of wider rows the products are taken block by block (``rangefinder``)."""
    from . import rangefinder

    slim = features.where("features is not null").select(F.col("subject").cast("long").alias("subject"), "split", F.transform("features", lambda v: v.cast("double")).alias("features"))
    rows, train, width = slim.agg(F.count("*"), F.count_if(F.col("split") == "train"), F.max(F.size("features"))).first()
    if not rows or not train:
        return slim.select("subject", "split", F.array().cast("array<double>").alias("components"), F.lit(None).cast("double").alias("explained")).limit(0)
    return _tall_components(slim, min(k, train - 1, width)) if width <= TALL else rangefinder.components(slim, min(k, train - 1))


def _tall_components(slim: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = slim.withColumn("v", array_to_vector("features"))
    learn = vectors.where("split = 'train'")
    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(learn)
    parts = fitted.pc.toArray()
    sign = np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(k)])
    mean = learn.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray() @ parts
    shift = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, sign, strict=True)])
    centred = F.zip_with(vector_to_array("p"), shift, lambda p, c: (p - c["m"]) * c["s"])
    return fitted.transform(vectors).select("subject", "split", centred.alias("components"), F.lit(float(fitted.explainedVariance.toArray().sum())).alias("explained"))
