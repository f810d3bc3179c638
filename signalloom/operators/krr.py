"""Kernel ridge regression with an inner choice of the penalty.

No intercept, targets not centred: w solves (K + alpha I) w = y. The inner folds choose the penalty with the largest
pooled out-of-fold correlation; ties and undefined values keep the earlier one, and without any defined value the middle
penalty is used. No task ever holds a method's rows or its kernel; there are two ways, by the width of the features:

* Up to ``RANK`` columns: K = Z Z' for unit rows Z, so that K_new (K + alpha I)^-1 y = Z_new (Z'Z + alpha I)^-1 Z'y exactly. One pass
  sums the augmented Gram matrices [Z y 1]'[Z y 1] of the folds, in parallel and then as a tree. What a fold leaves is the
  difference of sums, and its out-of-fold predictions enter the pooled correlation only through sums that are in its Gram
  matrix, so all penalties and all folds (outer and inner ones) come from that one pass over the features.
* Wider features and given kernels: conjugate gradients on stored kernel blocks (``blockridge``), all penalties and folds at once.

Folds are the seeded legacy permutation for up to ``COHORT`` rows (a table of small numbers), a keyed one beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import EPSILON, correlation_p, ranks
from ..sources.shared import settled
from . import metrics as tables
from .kernel import Tiles, unit
from .relational import COHORT, fold_at, fold_of, nested_folds, numbered, permuted

#: Penalties, in the order in which they are tried.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Columns of features up to which their Gram matrices are summed.
RANK = 1024


# ---- small matrices -------------------------------------------------------------------------------------------------


def predict(k: np.ndarray, y: np.ndarray, k_new: np.ndarray, alpha: float) -> np.ndarray:
    return k_new @ np.linalg.solve(k + alpha * np.eye(len(k)), y)


def r_of(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation; NaN if either side is constant."""
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return float("nan")
    return float(np.corrcoef(a, b)[0, 1])


def choose(k: np.ndarray, y: np.ndarray, alphas=ALPHAS, folds: int = 5, seed: int = 42) -> tuple[float, float]:
    """(penalty, its pooled out-of-fold correlation) for a kernel in memory."""
    fold = fold_of(len(y), min(folds, len(y)), seed)
    found = []
    for alpha in alphas:
        out = np.empty(len(y))
        for f in np.unique(fold):
            i, o = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            out[o] = predict(k[np.ix_(i, i)], y[i], k[np.ix_(o, i)], alpha)
        found.append(r_of(out, y))
    return best_of(found, alphas)


def best_of(correlations: list[float], alphas=ALPHAS) -> tuple[float, float]:
    """(penalty, correlation) of the first largest defined correlation, or else the middle penalty."""
    best, best_r = alphas[len(alphas) // 2], -np.inf
    for alpha, r in zip(alphas, correlations, strict=True):
        if r > best_r:
            best, best_r = alpha, r
    return best, float(best_r)


def metrics(y: np.ndarray, p: np.ndarray) -> dict[str, float]:
    """r2, pearson and spearman with their p-values, mae and mape (a fraction)."""
    tot, res = float(((y - y.mean()) ** 2).sum()), float(((y - p) ** 2).sum())
    return {"r2": 1 - res / tot if tot > 0 else float(res == 0), "pearson_r": (r := r_of(y, p)), "pearson_p": correlation_p(r, len(y)), "spearman_r": (rho := r_of(ranks(y), ranks(p))), "spearman_p": correlation_p(rho, len(y)), "mae": float(np.abs(y - p).mean()), "mape": float((np.abs(y - p) / np.maximum(np.abs(y), EPSILON)).mean())}


# ---- rows and folds -------------------------------------------------------------------------------------------------


def _slim(features: DataFrame) -> DataFrame:
    split = F.col("split") if "split" in features.columns else F.lit("train")
    return features.where("features is not null and y is not null").select("method", F.col("subject").cast("long").alias("subject"), split.alias("split"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.col("y").cast("double").alias("y"))


def placed(rows: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """(rows with ``pos``, their place in the order of subjects within method and split; facts of each method). The order is
    sorted by ranges; only a number for each method and split reaches the driver."""
    order = ["method", "split", "subject"]
    sizes = rows.groupBy("method", "split").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.avg("y").alias("mean")).collect() if "features" in rows.columns else rows.groupBy("method", "split").agg(F.count("*").alias("n"), F.lit(0).alias("width"), F.avg("y").alias("mean")).collect()
    sizes.sort(key=lambda r: (r.method.encode(), r.split.encode()))
    known: dict[str, dict] = {}
    starts, at = [], 0
    for r in sizes:
        known.setdefault(r.method, {"width": 0})[r.split] = r.n
        known[r.method]["width"] = max(known[r.method]["width"], r.width or 0)
        known[r.method][f"mean_{r.split}"] = r.mean
        starts.append((r.method, r.split, at))
        at += r.n
    if not starts:
        return rows.withColumn("pos", F.lit(0).cast("long")), {}
    begin = rows.sparkSession.createDataFrame(starts, "method string, split string, _begin long")
    ordered = numbered(rows, order).join(F.broadcast(begin), ["method", "split"])
    return ordered.withColumn("pos", F.col("pos") - F.col("_begin")).drop("_begin"), known


def with_cells(rows: DataFrame, known: dict[str, dict], folds: int, seed: int, inner: int | None = None) -> DataFrame:
    """Adds ``fold`` (-1 for test rows) and ``cells``: the sums that a row enters. Without inner folds that is its fold; with them
    it is outer * inner + its inner fold, for each outer fold that it isn't in."""
    spark, out = rows.sparkSession, None
    for n in sorted({k["train"] for k in known.values() if k.get("train")}):
        methods = [m for m, k in known.items() if k.get("train") == n]
        own = rows.where(F.col("method").isin(methods))
        learn, count = own.where("split = 'train'"), min(folds, n)
        if n > COHORT:
            fold = fold_at(permuted(F.col("pos"), n, seed), n, count)
            learn = learn.withColumn("fold", fold)
            each = [F.lit(f * inner) + fold_at(permuted(F.col("pos"), n, seed + 1 + f), n, inner) for f in range(count)] if inner else []
            cells = F.filter(F.array(*each), lambda c: F.floor(c / inner) != F.col("fold")) if inner else F.array("fold")
            learn = learn.withColumn("cells", cells)
        else:
            if inner:
                fold, within = nested_folds(n, count, inner, seed)
                cells = pa.array([[f * inner + int(g) for f, g in enumerate(places) if g >= 0] for places in within], pa.list_(pa.int32()))
            else:
                fold = fold_of(n, count, seed)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(fold, pa.int32()))
            table = spark.createDataFrame(pa.table({"pos": pa.array(np.arange(n)), "fold": pa.array(fold, pa.int32()), "cells": cells}), "pos long, fold int, cells array<int>")
            learn = learn.join(F.broadcast(table), "pos")  # of COHORT rows at most
        both = learn.unionByName(own.where("split <> 'train'").withColumn("fold", F.lit(-1)).withColumn("cells", F.array().cast("array<int>")))
        out = both if out is None else out.unionByName(both)
    return rows.withColumn("fold", F.lit(-1)).withColumn("cells", F.array().cast("array<int>")).limit(0) if out is None else out


def flat(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one width, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tree_sum(parts: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(keys, data): sums of packed vectors, in two steps of about the root of the number of parts."""
    step = ", ".join(f"{k} {dict(parts.dtypes)[k]}" for k in keys)

    def add(key, rows):
        total = np.sum([np.frombuffer(x) for x in rows.column("data").to_pylist()], axis=0)
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=False)}, "data": [total.tobytes()]})

    first = parts.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5)))))
    return first.groupBy(*keys, "_part").applyInArrow(lambda key, rows: add(key, rows), f"{step}, data binary").groupBy(*keys).applyInArrow(lambda key, rows: add(key, rows), f"{step}, data binary")


# ---- sums of the folds ----------------------------------------------------------------------------------------------


def grams(rows: DataFrame, means: dict[str, float], shifts: dict[str, np.ndarray] | None = None, turn=unit) -> DataFrame:
    """(method, cell, strip, data): the Gram matrices of [Z, y - mean, 1] of the rows of each cell, in strips of rows. Z are turned
    (unit) rows, or with shifts the features less a vector of their method."""

    def run(batches):
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            names, cells = np.array(batch.column(0).to_pylist(), object), batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            cell = cells.flatten().to_numpy()
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                own = flat(batch.column(1).take(pa.array(at)))
                z = turn(own) if shifts is None else own - shifts[name]
                wide = np.column_stack((z, batch.column(2).to_numpy()[at] - means[name], np.ones(len(at))))
                place = np.full(batch.num_rows, -1)
                place[at] = np.arange(len(at))
                for c in np.unique(cell[place[owner] >= 0]).tolist():
                    own = wide[place[owner[(cell == c) & (place[owner] >= 0)]]]
                    held[name, c] = held.get((name, c), 0) + own.T @ own
        for (name, c), whole in held.items():
            high = max(1, (1 << 17) // len(whole))
            strips = [whole[k : k + high].tobytes() for k in range(0, len(whole), high)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(strips)), pa.array([c] * len(strips), pa.int32()), pa.array(range(len(strips)), pa.int32()), pa.array(strips, pa.binary())], ["method", "cell", "strip", "data"])

    parts = rows.select("method", "features", "y", "cells").mapInArrow(run, "method string, cell int, strip int, data binary")
    return tree_sum(parts, ["method", "cell", "strip"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def matrices(rows: pa.Table) -> dict[int, np.ndarray]:
    """cell -> matrix, from the strips of a method."""
    held: dict[int, list] = {}
    for r in sorted(rows.select(["cell", "strip", "data"]).to_pylist(), key=lambda r: (r["cell"], r["strip"])):
        held.setdefault(r["cell"], []).append(np.frombuffer(r["data"]))
    out = {c: np.concatenate(parts) for c, parts in held.items()}
    return {c: x.reshape(int(np.sqrt(len(x))), -1) for c, x in out.items()}


def solved(gram: np.ndarray, mean: float, alpha: float) -> np.ndarray:
    """Weights of the features for one Gram matrix; targets are stored less the mean."""
    d = len(gram) - 2
    return np.linalg.solve(gram[:d, :d] + alpha * np.eye(d), gram[:d, d] + mean * gram[:d, d + 1])


def pooled(sums: np.ndarray) -> float:
    """Correlation from (n, p, y, pp, yy, py) sums; NaN where either side is constant."""
    n, p, y, pp, yy, py = sums
    vp, vy = pp - p * p / n, yy - y * y / n
    if vp <= 1e-14 * max(pp, 1e-300) or vy <= 1e-14 * max(yy, 1e-300):
        return float("nan")
    return float((py - p * y / n) / np.sqrt(vp * vy))


def chosen(cells: list[np.ndarray], mean: float, alphas=ALPHAS) -> tuple[float, float]:
    """The penalty and its pooled out-of-fold correlation, from the Gram matrices of the folds."""
    total, d = sum(cells), len(cells[0]) - 2
    found = []
    for alpha in alphas:
        sums = np.zeros(6)
        for own in cells:
            w = solved(total - own, mean, alpha)
            sums += (own[d + 1, d + 1], w @ own[:d, d + 1], own[d, d + 1], w @ own[:d, :d] @ w, own[d, d], w @ own[:d, d])
        found.append(pooled(sums))
    return best_of(found, alphas)


WEIGHTS = "method string, fold int, alpha double, inner_r double, w array<double>"


def weights(sums: DataFrame, means: dict[str, float], alphas=ALPHAS, inner: int | None = None) -> list:
    """Rows (method, fold, alpha, inner_r, w), fold -1 without outer folds. A task holds the Gram matrices of a method, which don't
    grow with its rows; RANK numbers a method and fold reach the driver."""

    def run(key, rows):
        name, cells = key[0].as_py(), matrices(rows)
        sets = {-1: list(cells.values())} if inner is None else {}
        for c, g in cells.items() if inner else ():
            sets.setdefault(c // inner, []).append(g)
        out = []
        for f, own in sets.items():
            alpha, r = chosen(own, means[name], alphas)
            out.append((name, f, alpha, r, solved(sum(own), means[name], alpha).tolist()))
        return pa.Table.from_pylist([dict(zip(("method", "fold", "alpha", "inner_r", "w"), x, strict=True)) for x in out], pa.schema([("method", pa.string()), ("fold", pa.int32()), ("alpha", pa.float64()), ("inner_r", pa.float64()), ("w", pa.list_(pa.float64()))]))

    return sums.groupBy("method").applyInArrow(run, WEIGHTS).collect()


PREDICTED = "method string, subject long, split string, fold int, y_true double, y_pred double, alpha double, inner_r double"


def _scored(rows: DataFrame, found: list, by_fold: bool = False, turn=unit) -> DataFrame:
    """PREDICTED rows by fitted weights, where the rows are."""
    known = {(r.method, r.fold): (np.array(r.w), r.alpha, r.inner_r) for r in found}

    def run(batches):
        for batch in batches:
            names, folds = batch.column(0).to_pylist(), batch.column(3).to_pylist() if by_fold else [-1] * batch.num_rows
            keys, out = list(zip(names, folds, strict=True)), np.zeros((batch.num_rows, 3))
            for key in dict.fromkeys(keys):
                at = np.array([k for k, x in enumerate(keys) if x == key])
                w, alpha, r = known[key]
                out[at, 0], out[at, 1], out[at, 2] = turn(flat(batch.column(5).take(pa.array(at)))) @ w, alpha, r
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(out[:, k]) for k in range(3))], [c.split()[0] for c in PREDICTED.split(", ")])

    return rows.select("method", "subject", "split", "fold", "y", "features").mapInArrow(run, PREDICTED)


def _fitted(features: DataFrame, alphas, folds: int, seed: int, inner: int | None = None, turn=unit) -> DataFrame:
    """PREDICTED rows of all rows: by the weights of their outer fold with inner folds, else by those of all learning rows."""
    from . import blockridge

    rows, known = placed(_slim(features))
    known = {m: k for m, k in known.items() if k.get("train")}
    narrow = [m for m, k in known.items() if k["width"] <= RANK]
    out = None
    if narrow:
        own = with_cells(rows.where(F.col("method").isin(narrow)), {m: known[m] for m in narrow}, folds, seed, inner)
        means = {m: known[m]["mean_train"] for m in narrow}
        out = _scored(own, weights(grams(own.where("split = 'train'"), means, None, turn), means, alphas, inner), inner is not None, turn)
    for m in [m for m in known if m not in narrow]:
        own = with_cells(rows.where(F.col("method") == m), {m: known[m]}, folds, seed, inner)
        one = blockridge.fitted(blockridge.of_features(own, turn), own, alphas, min(folds, known[m]["train"]), inner)
        out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], PREDICTED) if out is None else out


# ---- results --------------------------------------------------------------------------------------------------------

RESULT = "method string, n_train long, n_test long, alpha double, inner_r double, train_r2 double, r2 double, pearson_r double, pearson_p double, spearman_r double, spearman_p double, mae double, mape double"


def tested(predicted: DataFrame, facts: list) -> DataFrame:
    """Metrics of the test rows and r2 and correlation of the training rows for each method, from settled rows (method, split,
    y_true, y_pred); facts: further aggregates of the training rows."""
    nan = F.lit(float("nan"))
    both = (F.max("y_true") > F.min("y_true")) & (F.max("y_pred") > F.min("y_pred"))
    r2, r = stats.r2(F.col("y_true"), F.col("y_pred")), F.when(both, stats.pearson("y_true", "y_pred")).otherwise(nan)
    test = predicted.where("split = 'test'")
    train = predicted.where("split = 'train'").groupBy("method").agg(F.count("*").alias("n_train"), r2.alias("train_r2"), r.alias("train_r"), *facts)
    own = test.groupBy("method").agg(F.count("*").alias("n_test"), r2.alias("r2"), r.alias("pearson_r"), both.alias("_defined"), stats.mae(F.col("y_true"), F.col("y_pred")).alias("mae"), stats.mape(F.col("y_true"), F.col("y_pred")).alias("mape"))
    rho = tables.spearman_global(test, by=["method"]).drop("n")
    joined = train.join(own, "method").join(rho, "method").withColumn("spearman_r", F.when(F.col("_defined"), F.col("spearman_r")).otherwise(nan))
    return joined.withColumn("pearson_p", stats.p_value(F.col("pearson_r"), F.col("n_test"))).withColumn("spearman_p", stats.p_value(F.col("spearman_r"), F.col("n_test")))


def _reported(predicted: DataFrame) -> DataFrame:
    """One row of RESULT for each method, from PREDICTED rows."""
    return tested(settled(predicted), [F.max("alpha").alias("alpha"), F.max("inner_r").alias("inner_r")]).select(*[c.split()[0] for c in RESULT.split(", ")])


def compare(features: DataFrame, alphas=ALPHAS, folds: int = 5, seed: int = 42, turn=unit) -> DataFrame:
    """(method, subject, split, features, y) to one row of test metrics for each method. The kernel is that of products of turned
    rows: ``kernel.unit`` for the exact one, ``kernel.shared_scale`` for the block kernel."""
    return _reported(_fitted(features, alphas, folds, seed, turn=turn))


def predictions(features: DataFrame, alphas=ALPHAS, folds: int = 5, seed: int = 42) -> DataFrame:
    """(method, subject, y_true, y_pred, alpha) of the test rows."""
    return _fitted(features, alphas, folds, seed).where("split = 'test'").select("method", "subject", "y_true", "y_pred", "alpha")


def compare_precomputed(kernel: DataFrame | dict[str, Tiles], targets: DataFrame, alphas=ALPHAS, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row of test metrics for each method, from kernel rows (method, a, b, k), each pair once or both ways, or the tiles of each
    method, which aren't stored and have to hold all ids; and targets (id, split, y)."""
    from . import blockridge

    out, given = None, isinstance(kernel, dict)
    for method in kernel if given else [r.method for r in kernel.select("method").distinct().collect()]:
        rows = targets.where("y is not null").select(F.lit(method).alias("method"), F.col("id").cast("long").alias("subject"), "split", F.col("y").cast("double").alias("y"))
        rows, known = placed(rows)
        own = settled(with_cells(rows, known, folds, seed))
        if given and own.join(kernel[method].places, F.col("subject") == F.col("id"), "left_anti").first() is not None:
            raise ValueError(f"{method}: targets that the kernel doesn't hold")
        blocks = kernel[method] if given else blockridge.of_rows(kernel.where(F.col("method") == method), own)
        one = blockridge.fitted(blocks, own, alphas, min(folds, known[method]["train"]))
        out = one if out is None else out.unionByName(one)
    return _reported(out)


def cross_validate(features: DataFrame, outer: int = 5, inner: int = 3, alphas=ALPHAS, seed: int = 42) -> DataFrame:
    """(method, fold, n, alpha, r2, pearson_r, mae): outer folds with an inner choice; fold -1 pools all of them. All outer and
    inner folds come from the same pass; a row enters one sum for each outer fold that it isn't in."""
    out = settled(_fitted(features.drop("split"), alphas, outer, seed, inner).select("method", "fold", "y_true", "y_pred", "alpha"))
    pooled_rows = out.unionByName(out.withColumn("fold", F.lit(-1)).withColumn("alpha", F.lit(None).cast("double")))
    return pooled_rows.groupBy("method", "fold").agg(F.count("*").alias("n"), F.max("alpha").alias("alpha"), stats.r2(F.col("y_true"), F.col("y_pred")).alias("r2"), stats.pearson("y_true", "y_pred").alias("pearson_r"), stats.mae(F.col("y_true"), F.col("y_pred")).alias("mae"))
