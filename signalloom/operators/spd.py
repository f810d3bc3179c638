"""Positive definite matrices: regularisation, log-Cholesky distance, reconstruction metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .connectivity import correlation, matrices_of
from .krr import r_of


def regularised(m: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """Symmetric part with its eigenvalues clamped from below."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    out = (vectors * np.maximum(values, least)) @ vectors.T
    return (out + out.T) / 2


def log_cholesky_distance(a: np.ndarray, b: np.ndarray, least: float = 1e-5) -> float:
    """Frobenius norm of the difference of lower Cholesky factors with logarithms on their diagonals."""
    logs = []
    for m in (a, b):
        low = np.linalg.cholesky(regularised(m, least))
        low[np.diag_indices(len(low))] = np.log(np.diag(low))
        logs.append(low)
    return float(np.linalg.norm(logs[0] - logs[1]))


def reconstruction(original: np.ndarray, rebuilt: np.ndarray) -> dict[str, float]:
    """mse, mae, correlation of the whole flattened correlation matrices (0 if undefined), and their distance."""
    if original.shape != rebuilt.shape:
        raise ValueError(f"shapes differ: {original.shape} and {rebuilt.shape}")
    d = original - rebuilt
    a, b = correlation(original), correlation(rebuilt)
    r = r_of(a.ravel(), b.ravel())
    return {"mse": float((d * d).mean()), "mae": float(np.abs(d).mean()), "fc_correlation": 0.0 if np.isnan(r) else r, "riemannian_distance": log_cholesky_distance(a, b)}


METRICS = ("mse", "mae", "fc_correlation", "riemannian_distance")


def evaluate_reconstruction(pairs: DataFrame) -> DataFrame:
    """(subject, original, rebuilt) matrices in one row to the four metrics; no shuffle."""
    kind = dict(pairs.dtypes)["subject"]

    def run(batches):
        for batch in batches:
            got = [reconstruction(a, b) for a, b in zip(matrices_of(batch.column("original")), matrices_of(batch.column("rebuilt")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("subject"), *[pa.array([g[m] for g in got], pa.float64()) for m in METRICS]], ["subject", *METRICS])

    return pairs.select("subject", "original", "rebuilt").where("original is not null and rebuilt is not null").mapInArrow(run, f"subject {kind}, " + ", ".join(f"{m} double" for m in METRICS))
