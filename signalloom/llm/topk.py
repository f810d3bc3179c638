"""Exact top-k inner products by sequential reading of sorted lists (no random access).

Every candidate row gets a number and goes to a block. Within a block each component has a list of (value, candidate) sorted by
value; for a query it is read from the end of its largest contributions, ``STEPS`` pieces one after another. What a
list has told so far bounds every candidate's score: the lower bound takes the least contribution of each list that
hasn't named the candidate, the upper bound that list's frontier. After each piece the k-th best lower bound is
compared with the upper bounds; candidates that can't reach it drop out, and reading stops when those that nobody has named can't
qualify either and few candidates are left (a ``SHARE``-th of the block), whose final scores are then resolved. The k-th best score that a query has found
in earlier blocks of a task bounds its reading in later ones, which often end after the first piece.

Blocks are written once. The queries come in groups of ``GROUP`` rows (a bound: the driver and each task hold one group at
a time), and each group reads the blocks in place; so candidates are shuffled once, into their blocks, however many
queries there are, and a task sends on k rows a query at most.

Edge cases: vectors that are null or hold a null or non-finite component, and rows without id, take no part; every other row
is a candidate for all queries but itself, also where it repeats an id; a row that repeats a query's id is a query of
its own; vectors of different lengths are never compared; fewer than k candidates give as many rows; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Components in a block and in a group of queries.
ENTRIES = 1 << 20
#: Candidates in a block, queries in a group, pieces of a list; candidates (per k, or one over the share of a block) that
#: are resolved rather than read on.
CANDIDATES, GROUP, STEPS, FEW, SHARE = 16384, 16384, 16, 4, 32
SCALE = 1024


def scaled(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<long>): floor(1024 x) of the vectors that take part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # exists() is null if a comparison with a null element is; isNull comes first, so it is true there
    good = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, values: np.ndarray):
        """order and values: lists x candidates, by growing value; rows and ids: number and id of each candidate."""
        self.rows, self.ids, self.order, self.values = rows, ids, order.astype(np.intp), values
        self.floats, self.largest = values.astype(np.float64), np.abs(values).max(initial=0)
        self.read = 0  # entries read, of all queries

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, block: np.ndarray) -> Lists:
        order = np.argsort(block, axis=0, kind="stable").T.astype(np.int32)
        return cls(rows, ids, np.ascontiguousarray(order), np.take_along_axis(block.T, order.astype(np.int64), axis=1))

    def best(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates of a query, the row ``own`` left out, by score and id; of candidates that
        score under ``least`` any number may be missing."""
        n = len(self.ids)
        candidates = np.flatnonzero(self.rows != own)
        # 64-bit floats hold all sums exactly, or else Python integers do
        exact = float(self.largest) * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2.0**52
        values = self.floats if exact else self.values.astype(object)
        top, bottom = np.flatnonzero(query > 0), np.flatnonzero(query < 0)  # lists read from their upper and lower end
        weight = query[np.concatenate((top, bottom))].astype(values.dtype)
        ends = np.concatenate((values[top, 0], values[bottom, -1])) * weight if n else weight
        lower = np.zeros(n, values.dtype) + ends.sum()  # nothing read: the least contribution of every list
        seen, number = np.zeros((len(weight), n), np.float32), n * np.arange(len(weight))[:, None]
        step, depth, enough = -(-n // STEPS), 0, max(FEW * k, n // SHARE)
        while len(weight) and depth < n and len(candidates) > enough:
            stop = min(n, depth + step)
            pieces = (top, slice(n - stop, n - depth)), (bottom, slice(depth, stop))
            names = np.concatenate([self.order[x] for x in pieces])
            gains = np.concatenate([values[x] for x in pieces]) * weight[:, None]
            front = np.concatenate((gains[: len(top), 0], gains[len(top) :, -1]))
            self.read += names.size
            extra = (gains - ends[:, None]).ravel()
            if exact:
                lower += np.bincount(names.ravel(), weights=extra, minlength=n)
            else:
                np.add.at(lower, names.ravel(), extra)
            seen.reshape(-1)[names + number] = 1
            depth = stop
            slack = float(np.abs(front - ends).sum()) * 1e-5 + 1  # of the float32 product
            if float(front.sum()) - slack > (float(lower.max()) if least is None else least):
                continue  # even a candidate that no list has named can qualify
            # a list that hasn't named a candidate gives it what stands at the frontier, at most
            room = (front - ends).astype(np.float32)
            held = lower[candidates].astype(np.float64)
            upper = held + float((front - ends).sum()) - (room @ seen)[candidates] + slack
            kth = np.partition(held, len(candidates) - k)[len(candidates) - k]
            candidates = candidates[upper >= (kth if least is None else max(kth, least))]
        scores = self.resolved(query, candidates)
        first = np.lexsort((self.ids[candidates], -scores))[:k]
        return self.ids[candidates[first]], scores[first]

    def resolved(self, query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Final scores: what the lists say of a few candidates, put together."""
        if not hasattr(self, "block"):
            self.block = np.zeros(self.order.shape[::-1], np.int64)
            np.put_along_axis(self.block, self.order.T, self.values.T, axis=0)
        return self.block[candidates] @ query if len(candidates) else np.zeros(0, np.int64)


def blocks(points: DataFrame, number: int) -> DataFrame:
    """One row a block: dim, rows, ids, order and values of its lists; written."""

    def pack(key, table):
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, rows = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        lists = Lists.of(rows, ids, flat.reshape(len(ids), -1))
        return pa.table({"dim": [key[0].as_py()], **{n: [x.tobytes()] for n, x in (("rows", rows), ("ids", ids), ("order", lists.order.astype(np.int32)), ("list", lists.values))}})

    dealt = points.withColumn("dim", F.size("v").cast("long")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)))
    return stored(dealt.groupBy("dim", "block").applyInArrow(pack, "dim long, rows binary, ids binary, order binary, list binary"))


def search(vectors: DataFrame, queries=None, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. queries: a condition on vec_id."""
    queries = F.col("vec_id") % 100 == 0 if queries is None else queries
    spark = vectors.sparkSession
    points = stored(scaled(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id()))
    size = F.size("v").cast("long")
    count, entries, asked, wide = points.agg(F.count("*"), F.sum(size), F.count_if(queries), F.sum(F.when(queries, size))).first()
    lists = blocks(points, max(1, -(-count // candidates), -(-(entries or 0) // ENTRIES)))
    groups = max(1, -(-asked // group), -(-(wide or 0) // ENTRIES))
    path = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    parts = []
    for number in range(groups):
        own = points.where(queries).where(F.pmod(F.xxhash64("row"), F.lit(groups)) == number)
        got = own.select("row", "vec_id", "v").toArrow()  # about ``group`` rows
        found = lists.mapInArrow(_reader(got, k), "query_row long, query_id long, vec_id long, score long")
        if groups > 1:  # results are written, so that no plan holds more than one group
            found.write.mode("append").parquet(path)
        else:
            parts.append(found)
    found = spark.read.schema("query_row long, query_id long, vec_id long, score long").parquet(path) if groups > 1 else parts[0]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reader(got: pa.Table, k: int):
    """A function of batches of blocks that gives the k best of a task's blocks for each query of a group."""
    rows, ids = (got.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))
    vectors = [np.array(v, np.int64) for v in got.column("v").to_pylist()]

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k_row in range(batch.num_rows):
                r = {c: batch.column(c)[k_row].as_py() for c in batch.schema.names}
                names = np.frombuffer(r["ids"], np.int64)
                shape = (r["dim"], len(names))
                lists = Lists(np.frombuffer(r["rows"], np.int64), names, np.frombuffer(r["order"], np.int32).reshape(shape), np.frombuffer(r["list"], np.int64).reshape(shape))
                for q, vector in enumerate(vectors):
                    if len(vector) != r["dim"]:
                        continue
                    had = best.get(q)
                    new = lists.best(vector, rows[q], k, int(had[1][-1]) if had is not None and len(had[1]) == k else None)
                    if had is not None:
                        new = np.concatenate((had[0], new[0])), np.concatenate((had[1], new[1]))
                        first = np.lexsort((new[0], -new[1]))[:k]
                        new = new[0][first], new[1][first]
                    best[q] = new
        for start in range(0, len(held := list(best)), 1000):
            part = held[start : start + 1000]
            sizes = [len(best[q][0]) for q in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[part], sizes)), pa.array(np.repeat(ids[part], sizes)), *(pa.array(np.concatenate([best[q][c] for q in part]).astype(np.int64)) for c in (0, 1))], ["query_row", "query_id", "vec_id", "score"])

    return run
