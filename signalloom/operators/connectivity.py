"""Correlation matrices and their triangles, and features of patch matrices.

Input rows are (subject, m array<array<double>>): one entity's matrix in one row, so nothing shuffles. Small matrices stay
in the JVM; over ``NARROW`` rows the correlations of a batch go to numpy through Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

NARROW = 16


def correlation(m: np.ndarray) -> np.ndarray:
    """Correlations of the rows; 0 for a constant row, on the diagonal too."""
    centred = m - m.mean(axis=1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(axis=1))
    safe = np.where(norm > 0, norm, 1)
    return np.where(np.outer(norm > 0, norm > 0), (centred / safe[:, None]) @ (centred / safe[:, None]).T, 0.0)


def triangle(square: np.ndarray) -> np.ndarray:
    """Strict lower triangle, row by row."""
    return square[np.tril_indices(len(square), -1)]


def matrices_of(column: pa.Array) -> list[np.ndarray | None]:
    """The matrices of a column of nested lists, as views of its flat values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, values = column.values.offsets.to_numpy(), column.values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for k, (a, b) in enumerate(zip(column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist(), strict=True)):
        if not column[k].is_valid:
            out.append(None)
            continue
        widths = np.diff(rows[a : b + 1])
        if len(widths) and (widths != widths[0]).any():
            raise ValueError("rows of a matrix differ in length")
        out.append(values[rows[a] : rows[b]].reshape(b - a, -1) if b > a else np.zeros((0, 0)))
    return out


def per_matrix(frame: DataFrame, compute, schema: str = "array<double>", name: str = "features") -> DataFrame:
    """Adds compute(matrix as numpy) of each row's m."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    out = StructType([*frame.schema.fields, StructField(name, kind)])
    names = frame.columns

    def run(batches):
        for batch in batches:
            got = [None if m is None else np.asarray(compute(m)).tolist() for m in matrices_of(batch.column(names.index("m")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, name])

    return frame.mapInArrow(run, out)


def _unit(m):
    """Rows centred and of length 1; constant rows are 0."""
    row = lambda x: arrays.let(arrays.mean(x), lambda c: F.transform(x, lambda v: v - c))
    scaled = lambda x: arrays.let(F.sqrt(arrays.dot(x, x)), lambda n: F.transform(x, lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0))))
    return F.transform(m, lambda x: arrays.let(row(x), scaled))


def fc_long(matrices: DataFrame, diagonal: bool = True, lower_only: bool = False) -> DataFrame:
    """(subject, i, j, r): the correlation matrix, or its strict lower triangle. For narrow matrices."""
    unit = matrices.select("subject", _unit(F.col("m")).alias("u"))
    left = unit.select("subject", "u", F.posexplode("u").alias("i", "x"))
    pairs = left.select("subject", "i", "x", F.posexplode("u").alias("j", "y"))
    pairs = pairs.where("i > j") if lower_only else pairs if diagonal else pairs.where("i <> j")
    return pairs.select("subject", "i", "j", arrays.dot(F.col("x"), F.col("y")).alias("r"))


def fc_features(matrices: DataFrame, wide: bool | None = None) -> DataFrame:
    """(subject, features): the strict lower triangle, row by row. wide: matrices may have over NARROW rows."""
    if wide is None or wide:
        return per_matrix(matrices.select("subject", "m"), lambda m: triangle(correlation(m))).select("subject", "features")
    unit = matrices.select("subject", _unit(F.col("m")).alias("u"))
    rows = F.transform(F.sequence(F.lit(1), F.size("u") - 1), lambda i: F.transform(F.slice("u", 1, i), lambda y: arrays.dot(F.get(F.col("u"), i), y)))
    return unit.select("subject", F.when(F.size("u") > 1, F.flatten(rows)).otherwise(F.array().cast("array<double>")).alias("features"))


def cosine_triangle(matrices: DataFrame) -> DataFrame:
    """(subject, features): cosines (norms + 1e-8) between the rows, strict lower triangle."""

    def compute(m: np.ndarray) -> np.ndarray:
        unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
        return triangle(unit @ unit.T)

    return per_matrix(matrices.select("subject", "m"), compute).select("subject", "features")


def roi_temporal_features(matrices: DataFrame, rois: int, steps: int) -> DataFrame:
    """Patches (rois x steps rows, ROI by ROI) averaged over their hidden values, then correlated over the steps."""

    def compute(m: np.ndarray) -> np.ndarray:
        return triangle(correlation(m.mean(axis=1).reshape(rois, steps)))

    return per_matrix(matrices.select("subject", "m"), compute).select("subject", "features")


def similarity_features(matrices: DataFrame, layout: tuple[int, int] | None) -> DataFrame:
    """ROI correlations where patches have a layout (rois, steps), cosines between patches otherwise."""
    return roi_temporal_features(matrices, *layout) if layout else cosine_triangle(matrices)


def pooled(matrices: DataFrame) -> DataFrame:
    """(subject, features): mean of the rows."""
    return matrices.select("subject", arrays.mean_pool(F.col("m")).alias("features"))
