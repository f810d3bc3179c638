"""Around encoders: input preparation, token selection, and fault-isolated application of any per-entity function.

The encoder itself is a plain function of a batch of matrices; loading it once per worker is the function's own business.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def prepared(matrices: DataFrame, n: int, rows: int | None = None, height: int | None = None, channels: int | None = None, pad: str = "right") -> DataFrame:
    """Input matrices: n time points a row; rows padded with -1 to a height if given, and replicated to channels if given."""
    m = F.transform(F.col("m"), lambda row: arrays.pad_or_crop(row, n, "center", pad))
    if rows is not None:
        m = F.when(F.size("m") == rows, m).otherwise(F.raise_error(F.lit(f"expected {rows} rows")).cast("array<array<double>>"))
    if height is not None:
        blank = F.array_repeat(F.lit(-1.0), n)
        missing = F.greatest(F.lit(height) - F.size("m"), F.lit(0))
        top = F.floor(missing / 2).cast("int")
        m = F.concat(F.array_repeat(blank, top), m, F.array_repeat(blank, missing - top))
    return matrices.withColumn("m", arrays.replicated(m, channels) if channels else m)


def first_token(tokens) -> F.Column:
    """The class token of a token matrix."""
    return F.get(tokens, F.lit(0))


def patch_tokens(tokens) -> F.Column:
    """All tokens but the class token."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def pooled_tokens(tokens) -> F.Column:
    return arrays.mean_pool(tokens)


def split_patches(x, width: int = 16) -> F.Column:
    """A series cut to whole patches of so many values."""
    return arrays.reshape(F.slice(x, 1, (F.size(x) / width).cast("int") * width), width)


def applied(frame: DataFrame, compute: Callable[[list], list], column: str = "m", result: str = "array<double>", batch: int = 8) -> DataFrame:
    """Adds ``result`` = compute(values of the column) for batches of rows, and ``error``. A failing batch is tried again
    row by row; a failing row has a null result and its error's text, and the others go on."""
    from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

    schema = StructType([*frame.schema.fields, StructField("result", _parse_datatype_string(result)), StructField("error", StringType())])
    names = frame.columns

    def one_by_one(values: list) -> list[tuple]:
        out = []
        for v in values:
            try:
                out.append((np.asarray(compute([v])[0]).tolist(), None))
            except Exception as error:  # any failure of one entity is its own
                out.append((None, f"{type(error).__name__}: {error}"))
        return out

    def run(batches):
        for rows in batches:
            values, got = rows.column(names.index(column)).to_pylist(), []
            for k in range(0, len(values), batch):
                part = values[k : k + batch]
                try:
                    got += [(np.asarray(r).tolist(), None) for r in compute(part)]
                except Exception:  # found again, row by row
                    got += one_by_one(part)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([g[0] for g in got], _arrow(result)), pa.array([g[1] for g in got], pa.string())], [*names, "result", "error"])

    return frame.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    inner = kind.replace(" ", "")
    return pa.list_(_arrow(inner[6:-1])) if inner.startswith("array<") else {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}[inner]


def ordered(features: DataFrame, key: str = "subject") -> DataFrame:
    """Features in the order of their entities."""
    return features.orderBy(key)
