"""Cohorts: filters, matching, sampling, splits and folds."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder, settled


def having(frame: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids."""
    return frame.join(ids, key, "left_semi")


def pending(frame: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done; rows with a null key stay."""
    return frame.join(done, key, "left_anti")


def complete(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return frame.na.drop(how="any", subset=columns)


def first_by(frame: DataFrame, key: str, order: list) -> DataFrame:
    """Of the rows that share a key the first in order: one pre-aggregated pass, no window over a hot key."""
    rest = [c for c in frame.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return frame.groupBy(key).agg(first).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def match_first(entities: DataFrame, scores: DataFrame, entity_key: str, score_key: str, order: list, as_text: bool = False) -> DataFrame:
    """entities inner-joined with the first score row of their id; as_text compares the ids as text."""
    one = first_by(scores, score_key, order).withColumnRenamed(score_key, "_key")
    a, b = F.col(entity_key), F.col("_key")
    return entities.join(one, a.cast("string") == b.cast("string") if as_text else a == b).drop("_key")


def without_summary_rows(frame: DataFrame, subject: str = "subject", words: tuple[str, ...] = ("", "mean", "std", "min", "max", "median", "STATISTICS")) -> DataFrame:
    """Rows that aren't summary rows; null subjects stay."""
    return frame.where(F.coalesce(~F.col(subject).isin(*words), F.lit(True)))


def numbered(frame: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Adds the zero-based place in a total order. Ranges are sorted in parallel: a range partitioning, a count of
    each range, and a local number; no single task sees all rows."""
    split = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    split = settled(split)  # counts and numbers have to be of the same partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return split.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def evenly_spaced(frame: DataFrame, order: list, k: int) -> DataFrame:
    """k rows at places trunc(i (n-1)/(k-1)) of the total order; all rows if there are fewer; the first for k = 1."""
    n = frame.count()
    k = min(k, n)
    if k <= 0:
        return frame.limit(0)
    wanted = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    places = frame.sparkSession.createDataFrame([(p,) for p in wanted], "pos long")
    return numbered(frame, order).join(F.broadcast(places), "pos", "left_semi")


def head(frame: DataFrame, order: list, n: int) -> DataFrame:
    return frame.orderBy(*order).limit(n)


def missing_fields(frame: DataFrame, text: str, required: list[str]) -> F.Column:
    """Required names that a JSON object lacks; all of them if it isn't an object."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(F.json_object_keys(F.col(text)), F.array().cast("array<string>")))


#: Rows up to which kernel ridge takes its folds from the seeded permutation, and places in a packed piece of it.
COHORT, PIECE = 1_000_000, 1 << 16
#: Pieces that the driver sends at once.
SENT = 256


def seeded(n: int, seed: int) -> np.ndarray:
    """numpy's legacy permutation of n places. Its draws follow each other, so one process makes it, whatever n is; the numbers lie in a
    mapped file and not in the process's own memory."""
    if not n:
        return np.zeros(0, np.int32)
    order = np.asarray(np.memmap(tempfile.TemporaryFile(), np.int32 if n <= 1 << 31 else np.int64, "w+", shape=(n,)))
    for k in range(0, n, PIECE):
        order[k : k + PIECE] = np.arange(k, min(n, k + PIECE))
    np.random.RandomState(seed).shuffle(order)
    return order


def _groups(n: int, starts: list[int], seed: int) -> np.ndarray:
    """The group of each place: groups are stretches of the seeded permutation from each start on."""
    order = seeded(n, seed)
    group = np.asarray(np.memmap(tempfile.TemporaryFile(), np.int32, "w+", shape=(max(n, 1),)))[:n]
    for k, (begin, end) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
        for at in range(begin, end, PIECE):
            group[order[at : min(end, at + PIECE)]] = k
    return group


def _joined(rows: DataFrame, group: np.ndarray, name: str) -> DataFrame:
    """rows (pos, ...) with the group of their place. Groups go to the shared folder in packed pieces, some at a time, and become rows in tasks."""
    spark, n = rows.sparkSession, len(group)
    path = new_folder(spark, "groups")
    for first in range(0, max(n, 1), PIECE * SENT):
        starts = list(range(first, min(n, first + PIECE * SENT), PIECE))
        pieces = pa.table({"start": pa.array(starts, pa.int64()), "data": pa.array([group[k : k + PIECE].tobytes() for k in starts], pa.binary())})
        spark.createDataFrame(pieces, "start long, data binary").write.mode("append").parquet(path)

    def unpacked(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(data.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(own))), pa.array(own)], ["pos", name])

    table = spark.read.schema("start long, data binary").parquet(path).mapInArrow(unpacked, f"pos long, {name} int")
    return rows.join(table.hint("merge"), "pos")


def random_split(frame: DataFrame, order: list, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ceil(test n) places of the seeded legacy permutation are the test set. The driver makes the permutation,
    one small number a row; ``hash_split`` and ``keyed_split`` need none."""
    placed = numbered(frame, order)
    n = placed.count()
    group = _groups(n, [0, int(np.ceil(test * n))], seed)
    return _joined(placed, group, "_group").withColumn("split", F.when(F.col("_group") == 0, "test").otherwise("train")).drop("_group", "pos")


def hash_split(frame: DataFrame, key: str, parts: int = 5) -> DataFrame:
    """Adds ``split`` by the first eight hex digits of the md5 of the key: remainder 0 is test. Needs no order and no count."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return frame.withColumn("split", F.when(number % parts == 0, "test").otherwise("train"))


def fold_of(n: int, folds: int = 5, seed: int | None = 42) -> np.ndarray:
    """Fold of each of n places: shuffled by the legacy generator, the first n mod folds one longer."""
    if not 2 <= folds <= n:
        raise ValueError(f"{folds} folds need 2 to n = {n}")
    order = np.arange(n) if seed is None else np.random.RandomState(seed).permutation(n)
    out = np.empty(n, np.int64)
    for k, part in enumerate(np.array_split(order, folds)):
        out[part] = k
    return out


def with_folds(frame: DataFrame, order: list, folds: int = 5, seed: int | None = 42) -> DataFrame:
    """Adds ``pos`` and ``fold``, by the seeded legacy permutation, which the driver makes, or without a seed by ranges of places."""
    placed = numbered(frame, order)
    n = placed.count()
    if not 2 <= folds <= n:
        raise ValueError(f"{folds} folds need 2 to n = {n}")
    if seed is None:
        return placed.withColumn("fold", fold_at(F.col("pos"), n, folds))
    return _joined(placed, _groups(n, [k * (n // folds) + min(k, n % folds) for k in range(folds)], seed), "fold")


# ---- permutations of any size ---------------------------------------------------------------------------------------

#: Rounds of the keyed bijection, and steps of its walk back into the range beyond which a row is an error.
ROUNDS, WALK = 4, 64


def _side(n: int) -> int:
    """The least a with a * a >= n."""
    return math.isqrt(max(n, 1) - 1) + 1


def permuted(pos, n: int, seed: int = 42) -> F.Column:
    """The place of pos (0 to n - 1) in a keyed permutation of n places, an expression without any table: a Feistel network over
    pairs (left, right) of numbers below the root of n, whose rounds are md5 sums of key, round and right. The square of that
    root is over n by twice the root at most; a place that falls outside walks on until it is inside again, which keeps it a
    bijection. WALK steps are more than any place needs for n up to a thousand, and for larger n leave out one with odds of
    under (2 / sqrt(n)) ** WALK; such a row would be an error, never a wrong place."""
    a = _side(n)
    drawn = lambda r, k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), r.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    whole = lambda x: F.floor(x / F.lit(a)).cast("long")
    network = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair(whole(x), x % a), lambda s, k: pair(s["r"], (s["l"] + drawn(s["r"], k)) % a), lambda s: s["l"] * a + s["r"])
    walk = F.sequence(F.lit(1), F.lit(max(1, min(a * a - n, WALK))))
    place = F.aggregate(walk, network(pos.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit(f"no place among {n} within {WALK} steps")).cast("long"))


def fold_at(place, n: int, folds: int) -> F.Column:
    """The fold of a place of n: the first n mod folds folds are one longer."""
    base, extra = divmod(n, folds)
    longer = F.lit(extra * (base + 1))
    return F.when(place < longer, F.floor(place / F.lit(base + 1))).otherwise(extra + F.floor((place - longer) / F.lit(max(base, 1)))).cast("int")


def keyed_split(frame: DataFrame, order: list, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` for tables of any size: the first ceil(test n) places of a keyed permutation of the total order are the
    test set. Sizes are exact and nothing is made on the driver."""
    placed = settled(numbered(frame, order))
    n = placed.count()
    return placed.withColumn("split", F.when(permuted(F.col("pos"), n, seed) < math.ceil(test * n), "test").otherwise("train")).drop("pos")


def keyed_folds(frame: DataFrame, order: list, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``pos`` and ``fold`` for tables of any size, by a keyed permutation of the total order."""
    placed = settled(numbered(frame, order))
    n = placed.count()
    if not 2 <= folds <= n:
        raise ValueError(f"{folds} folds need 2 to n = {n}")
    return placed.withColumn("fold", fold_at(permuted(F.col("pos"), n, seed), n, folds))


def nested_folds(n: int, outer: int, inner: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(outer fold of each place, its inner fold in the learning rows of every outer fold, -1 where it isn't one of them)."""
    fold = fold_of(n, outer, seed)
    within = np.full((n, outer), -1, np.int64)
    for f in range(outer):
        learn = np.flatnonzero(fold != f)
        within[learn, f] = fold_of(len(learn), min(inner, len(learn)), seed)
    return fold, within
