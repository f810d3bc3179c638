"""Principal components of wide rows: a seeded random range finder on blocks of the rows' products.

K = X X' of the centred rows lies in stored blocks (``blockridge``). A random block of vectors on the training rows is multiplied with
K, made orthonormal by a QR decomposition that is reduced as a tree (a task keeps the triangle of its rows, triangles of several
tasks are stacked and decomposed again), and multiplied again, until the wanted eigenvalues stand. Q'KQ is small; its
eigenvectors W give the scores of all rows, test rows too, as K Q W over the roots of the eigenvalues. No task holds the rows, no
matrix of columns by columns is made, and only squares of the range's width (and the mean row) reach the driver.

Where the range is as wide as the training rows are many, one round is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled, written
from ..sources.sinks import clean_up
from . import blockridge
from .blockridge import _collected, _pack, _tasks
from .krr import flat, placed, tree_sum

#: The range has so many vectors at least, and four for each component.
LEAST, ROUNDS, TOLERANCE, SEED = 128, 60, 1e-10, 42
#: Loadings that a task sums at a time.
LOADINGS = 8_000_000


def _mean(rows: DataFrame) -> np.ndarray:
    def run(batches):
        total, n = 0, 0
        for batch in batches:
            total, n = total + flat(batch.column(0)).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_pack(np.append(total, n))], pa.binary())], ["what", "data"])

    whole = _collected(rows.where("split = 'train'").select("features").mapInArrow(run, "what int, data binary"), "what")[0]
    return whole[:-1] / whole[-1]


def _triangle(vectors: DataFrame, width: int) -> np.ndarray:
    """The triangle of the QR decomposition of all blocks (p, v), reduced as a tree."""

    def run(batches):
        held = np.zeros((0, width))
        for batch in batches:
            for v in batch.column(0):
                held = np.linalg.qr(np.vstack((held, np.frombuffer(v.as_py()).reshape(-1, width))), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([_pack(held)], pa.binary())], ["data"])

    def again(key, rows):
        return pa.table({"data": [_pack(np.linalg.qr(np.vstack([np.frombuffer(x.as_py()).reshape(-1, width) for x in rows.column("data")]), mode="r"))]})

    parts = vectors.select("v").mapInArrow(run, "data binary").withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(max(1, int(_tasks(vectors) ** 0.5)))))
    got = parts.groupBy("_part").applyInArrow(again, "data binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(r.data).reshape(-1, width) for r in got]), mode="r")


def components(slim: DataFrame, k: int) -> DataFrame:
    """(subject, split, components, explained) of rows (subject, split, features)."""
    spark, size = slim.sparkSession, blockridge.BLOCK
    rows, known = placed(slim.withColumn("method", F.lit("m")).withColumn("y", F.lit(0.0)))
    rows = settled(rows)
    n_train = known["m"]["train"]
    n_test = sum(v for s, v in known["m"].items() if s not in ("width", "train") and not s.startswith("mean_"))
    mean = _mean(rows)
    packed = blockridge.packed_rows(rows, lambda x: x - mean)
    blocks = blockridge.of_packed(packed)
    width = min(n_train, max(LEAST, 4 * k))

    def learns(p: int) -> np.ndarray:
        at = p * size + np.arange(size)
        return ((at >= n_test) & (at < n_test + n_train)).astype(float)[:, None]

    def each(change, wide: int):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    p = batch.column(0)[k].as_py()
                    held = [np.frombuffer(c[k].as_py()).reshape(size, -1) for c in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([_pack(change(p, *held))], pa.binary())], ["p", "v"])

        return run

    def trace(batches):
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_pack(np.diag(np.frombuffer(data.as_py()).reshape(size, size)) @ learns(p.as_py()))], pa.binary())], ["what", "data"])

    whole = _collected(blocks.where("p = q").select("p", "data").mapInArrow(trace, "what int, data binary"), "what")[0][0]
    start = packed.select("p").mapInArrow(each(lambda p: learns(p) * np.random.RandomState([SEED, p]).standard_normal((size, width)), width), "p long, v binary")
    vectors, before, path, old = start, None, None, []
    for _ in range(ROUNDS):
        spread, path = written(blockridge.product(blocks, vectors).select("p", F.col("data").alias("v")), "range")
        old.append(path)
        if before is not None:
            both = spread.join(vectors.withColumnRenamed("v", "q"), "p").select("v", "q")

            def inner(batches, wide=wide):
                for batch in batches:
                    for v, q in zip(*batch.columns, strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_pack(np.frombuffer(q.as_py()).reshape(-1, wide).T @ np.frombuffer(v.as_py()).reshape(-1, wide))], pa.binary())], ["what", "data"])

            small = _collected(both.mapInArrow(inner, "what int, data binary"), "what")[0].reshape(wide, wide)
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
            use = values > 1e-12 * max(values[0], 1e-300)
            values, turn = values[use], turn[:, use]
            if wide == n_train or wide < width or (len(before) == len(values) and np.abs(before - values).max() <= TOLERANCE * values[0]):
                break
            before = values
        else:
            before = np.zeros(0)
        wide = width if vectors is start else wide
        masked = spread.mapInArrow(each(lambda p, v: learns(p) * v, wide), "p long, v binary")
        _, size_of, right = np.linalg.svd(_triangle(masked, wide))
        basis = (right.T / np.where(size_of > 1e-10 * size_of[0], size_of, np.inf))[:, size_of > 1e-10 * size_of[0]]
        vectors = spread.mapInArrow(each(lambda p, v, basis=basis: learns(p) * (v @ basis), basis.shape[1]), "p long, v binary")
        wide = basis.shape[1]
        for done in old[:-2]:
            clean_up(spark, done)
        old = old[-2:]
    scores = settled(spread.mapInArrow(each(lambda p, v: v @ turn / np.sqrt(values), len(values)), "p long, v binary"))
    for done in old:
        clean_up(spark, done)
    blocks.unpersist()
    sign = _signs(packed, scores, values, learns)
    share = float(values.sum() / whole) if whole > 0 else float("nan")

    def report(key, own, found):
        at = own.column("at").to_numpy() % size
        v = np.frombuffer(found.column("v")[0].as_py()).reshape(size, -1)[at] * sign
        flat_values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        return pa.table({"subject": own.column("subject"), "split": own.column("split"), "components": flat_values, "explained": pa.array(np.full(len(at), share))})

    place = blockridge._numbered(rows, n_test).select("subject", "split", "at").withColumn("p", F.floor(F.col("at") / size).cast("long"))
    return place.groupBy("p").cogroup(scores.groupBy("p")).applyInArrow(report, "subject long, split string, components array<double>, explained double")


def _signs(packed: DataFrame, scores: DataFrame, values: np.ndarray, learns) -> np.ndarray:
    """The sign that makes the largest loading of each component positive; loadings are summed for some components at a time."""
    columns = len(packed.select("x").first()["x"]) // 8 // blockridge.BLOCK
    step, out = max(1, LOADINGS // columns), []
    both = packed.join(scores, "p")
    for a in range(0, len(values), step):

        def run(batches, a=a):
            held = 0
            for batch in batches:
                for p, x, v in zip(*batch.columns, strict=True):
                    u = np.frombuffer(v.as_py()).reshape(-1, len(values))[:, a : a + step]
                    held = held + (u * learns(p.as_py())).T @ np.frombuffer(x.as_py()).reshape(len(u), -1)
            if not np.isscalar(held):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([_pack(r) for r in held], pa.binary())], ["what", "data"])

        def largest(batches):
            for batch in batches:
                loads = [np.frombuffer(x.as_py()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(np.sign(x[np.abs(x).argmax()])) for x in loads])], ["what", "sign"])

        summed = tree_sum(both.select("p", "x", "v").mapInArrow(run, "what int, data binary"), ["what"], _tasks(both))
        found = {r.what: r.sign for r in summed.select("what", "data").mapInArrow(largest, "what int, sign double").collect()}
        out += [found[w] or 1.0 for w in sorted(found)]
    return np.array(out)
