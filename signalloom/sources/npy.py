"""npy and npz files as a Spark data source, to read and to write.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(folder)                             subject, name, dtype, shape, values
    spark.read.format("npy").option("values", "false").load(folder)   the same without values: headers only are read
    frame.select("subject", "m").write.format("npy").mode("append").save(folder)

Reading: the folder's files, by their extension, in partitions of up to ``FILES`` files and ``BYTES`` bytes (a larger file is
one of its own); the subject is the file's name without it and without ``suffix`` (an option). A header is read by itself, so shapes and sizes of a folder cost a few hundred bytes a file; values come
in Fortran or C order, of any number type, as doubles in the order of rows. An npz file gives a row for each of its arrays.
Object arrays (which would need pickle) are an error, and so is a file that isn't one.

Writing: a row (subject, m as array<array<double>>) is a file of float64 (``dtype`` is an option). Tasks write beside the target, in
a folder of the job; commit moves what the successful attempts wrote, ``MOVES`` files at a time, and then writes ``_SUCCESS``, abort removes the folder, so a
killed or repeated job leaves no partial file at its target. Subjects that differ only in the task that wrote them are an
error at commit, before anything is moved.

Files are reached by pyarrow's file systems, so the folder may be any URI that they know; a plain path is a local or mounted one.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "subject string, name string, dtype string, shape array<long>, values array<double>"
#: Files and bytes of a partition, partitions that few files are dealt to, bytes of values of a batch, files moved at a time.
FILES, BYTES, PARTS, BATCH, MOVES = 256, 64 << 20, 64, 4 << 20, 32


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)


def header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, Fortran order, dtype) of an npy stream, which then stands at its values."""
    version = np.lib.format.read_magic(stream)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"npy version {version}")
    shape, fortran, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, fortran, dtype


def _array(stream, values: bool) -> tuple[str, list[int], np.ndarray | None]:
    shape, fortran, dtype = header(stream)
    if not values:
        return dtype.str, list(shape), None
    count = int(np.prod(shape, dtype=np.int64))
    data = stream.read(count * dtype.itemsize)
    if len(data) != count * dtype.itemsize:
        raise ValueError(f"{len(data)} bytes of values, {count * dtype.itemsize} expected")
    flat = np.frombuffer(data, dtype)
    return dtype.str, list(shape), (flat.reshape(shape, order="F").ravel() if fortran else flat).astype(np.float64)


@dataclass
class Files(InputPartition):
    """(path, subject) of some files."""

    files: list[tuple[str, str]]


def _dealt(files: list[tuple[str, str, int]]) -> list[Files]:
    """(path, subject, bytes) in partitions."""
    most, out, held = max(1, min(FILES, -(-len(files) // PARTS))), [], 0
    for path, subject, size in files:
        if not out or held + size > BYTES or len(out[-1].files) >= most:
            out.append(Files([]))
            held = 0
        out[-1].files.append((path, subject))
        held += size
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    subject, name, dtype, shape, values = zip(*rows, strict=True)
    if values[0] is None:
        flat = pa.nulls(len(rows), pa.list_(pa.float64()))
    else:
        ends = np.cumsum([0, *map(len, values)])
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(subject), pa.array(name, pa.string()), pa.array(dtype), pa.array(shape, pa.list_(pa.int64())), flat], ["subject", "name", "dtype", "shape", "values"])


class NpyReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, values: bool):
        self.folder, self.suffix, self.values = folder, suffix, values

    def partitions(self) -> list[Files]:
        own, folder = _opened(self.folder)
        found = own.get_file_info(pafs.FileSelector(folder, recursive=False))
        ends = (self.suffix + ".npy", self.suffix + ".npz")
        named = sorted((f.path, f.base_name, f.size or 0) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(ends) and f.base_name[0] not in "._")
        # of a file whose header alone is read the size doesn't count
        return _dealt([(path, unquote(name[: -len(ends[0])]), size if self.values else 0) for path, name, size in named])

    def read(self, partition: Files):
        if partition is None:
            return
        own, _ = _opened(self.folder)
        held, size = [], 0
        for path, subject in partition.files:
            for row in self._rows(own, path):
                own_size = 0 if row[-1] is None else row[-1].nbytes
                if held and (size + own_size > BATCH or len(held) >= 1024):
                    yield _batch(held)
                    held, size = [], 0
                held.append((subject, *row))
                size += own_size
        if held:
            yield _batch(held)

    def _rows(self, own: pafs.FileSystem, path: str):
        """(name, dtype, shape, values) of each array of a file."""
        with own.open_input_file(path) as stream:
            try:
                if path.endswith(".npz"):
                    with zipfile.ZipFile(stream) as members:
                        for name in sorted(members.namelist()):
                            with members.open(name) as member:
                                yield name.removesuffix(".npy"), *_array(member, self.values)
                else:
                    yield None, *_array(stream, self.values)
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, dtype: str, overwrite: bool):
        self.folder, self.dtype, self.overwrite = folder, dtype, overwrite
        self.job = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        own, folder = _opened(self.folder)
        attempt = f"{folder}/{self.job}/{uuid.uuid4().hex}"
        own.create_dir(attempt, recursive=True)
        files = []
        for batch in iterator:
            for subject, m in zip(batch.column("subject").to_pylist(), batch.column("m"), strict=True):
                rows = m.values
                matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
                held = io.BytesIO()
                np.lib.format.write_array(held, np.ascontiguousarray(matrix, self.dtype), allow_pickle=False)
                path = f"{attempt}/{quote(str(subject), safe='')}.npy"
                with own.open_output_stream(path) as out:
                    out.write(held.getvalue())
                files.append(path)
        return Written(files)

    def commit(self, messages) -> None:
        own, folder = _opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rsplit("/", 1)[1] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a subject has several rows")
        if self.overwrite:
            for f in own.get_file_info(pafs.FileSelector(folder)):
                if f.type == pafs.FileType.File:
                    own.delete_file(f.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda path, name: own.move(path, f"{folder}/{name}"), files, names):  # an error is raised here
                pass
        self.abort(messages)
        with own.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        own, folder = _opened(self.folder)
        if own.get_file_info(f"{folder}/{self.job}").type == pafs.FileType.Directory:
            own.delete_dir(f"{folder}/{self.job}")


class NpySource(DataSource):
    """Options: path, suffix (of names, before the extension), values (false: headers only), dtype (of what is written)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], self.options.get("suffix", ""), self.options.get("values", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        names = {f.name for f in schema.fields}
        if not {"subject", "m"} <= names:
            raise ValueError(f"subject and m are written, not {sorted(names)}")
        return NpyWriter(self.options["path"], self.options.get("dtype", "<f8"), overwrite)


def read(spark: SparkSession, folder: str, suffix: str = "", values: bool = True) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("suffix", suffix).option("values", str(values).lower()).load(folder)


def write(frame: DataFrame, folder: str, dtype: str = "<f8") -> None:
    """(subject, m) as a file for each subject."""
    frame.sparkSession.dataSource.register(NpySource)
    m = F.transform("m", lambda row: F.transform(row, lambda v: v.cast("double")))
    frame.select(F.col("subject").cast("string").alias("subject"), m.alias("m")).write.format("npy").option("dtype", dtype).mode("append").save(folder)


def matrix(values, shape) -> Column:
    """The rows of a two-dimensional array; one-dimensional ones are a single row."""
    width = F.element_at(shape, -1).cast("int")
    rows = F.when(F.size(shape) > 1, shape[0]).otherwise(1).cast("int")
    whole = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(values, r * width + 1, width))
    return F.when(F.size(shape) > 2, F.raise_error(F.lit("arrays of one or two dimensions are matrices")).cast("array<array<double>>")).when(rows == 0, F.array().cast("array<array<double>>")).otherwise(whole)


def signals(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(subject, m) of a folder of matrices."""
    return read(spark, folder, suffix).select("subject", matrix(F.col("values"), F.col("shape")).alias("m"))
