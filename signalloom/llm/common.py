"""What the corpus operators share: batches, block keys, packed key exchange, components.

Packed key exchange. Several operators need, for each of billions of 64-bit keys, a fact about the whole corpus (how
often it occurs, whether it repeats). A row per key would cost a shuffle far larger than the corpus. Instead documents
are dealt to blocks of a few MB of text (``in_blocks``); each block sends its distinct sorted keys to hash buckets as
packed arrays (``pack``), each bucket merges what it gets and answers block by block, and the answers meet the block's
documents again in a cogroup. A key occurs once per block however hot it is, so no task sees a hot key's occurrences.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so a batch holds few of them.
BATCH_ROWS = 256
#: One over the share of rows from which a key counts as hot.
HOT = 1024
#: Bytes of text in a block of the packed key exchange.
BLOCK_BYTES = 8 << 20
#: Keys that one bucket of the packed key exchange may hold.
BUCKET_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches):
    """The batches in slices of few rows: Spark's own hold up to 64 MB, and Python objects of a whole one would take far
    more. No setting of the session has to change for it."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine, where none is set, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="shared-")).rstrip("/")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: smaller than a checkpoint, for wider tables. by: columns
    whose values get folders of their own, so that a filter on them reads no more."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; a folder of our own only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def whole_row(docs: DataFrame):
    """A struct of all columns of docs, so that no name of theirs can clash with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def held_out(doc_id="doc_id"):
    """True for documents that no model learns from: crc32 of the decimal id, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(rate: float, *columns) -> F.Column:
    """True for about that share of rows, by a hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) < rate * 1_000_003


def hot_or_cold(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined (inner, on key) with facts, which has one row a key and the number of its rows in count; total is
    their sum. Keys that hold over 1 / HOT of all rows are HOT at most: they are broadcast, and left out of the shuffle in which
    the others meet, so that no task gets the rows of a hot key. Mostly there are none, and rows are read once."""
    least = max(total // HOT, 32)
    hot = facts.where(F.col(count) > least).drop(count)
    keys = [r[0] for r in hot.select(key).collect()]
    cold = facts.where(F.col(count) <= least).drop(count)
    if not keys:
        return rows.join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.where(~F.col(key).isin(keys)).join(cold, key))


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# ---- hashes ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Vocabulary(dict):
    """Word to number, in order of first sight."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def hashed_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in a row, number of words of each text)."""
    import xxhash

    known, parts, lengths = Vocabulary(), [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (byte_words(text) if lower else (text or "").encode("utf-8", "surrogatepass").split())
        lengths[k] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return hashes[numbers] if len(known) else np.zeros(0, np.uint64), lengths


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of hashes[i:i+length] for every i that has so many; of polynomial form, then mixed."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.full(len(hashes), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    inverse = np.full(n, back, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    return mix((sums[length:] - sums[:n]) * inverse + np.uint64(length))


# ---- packed key exchange --------------------------------------------------------------------------------------------


def in_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(docs with ``_order``, a hash of id and text, and ``_block``; number of blocks). Blocks are ranges of the unsigned hash,
    so that the order of documents doesn't depend on how many blocks there are, and neither null nor repeated ids crowd
    one. Where rows equal in id and text would fill a block, the table is written with a number for each row, which
    then goes into the hash."""
    hashed = F.xxhash64(F.col(doc_id), F.col(text))
    sizes = docs.groupBy(hashed.alias("_order")).agg(F.sum(F.octet_length(F.col(text))).alias("size"))
    size, most = sizes.agg(F.sum("size"), F.max("size")).first()
    if (most or 0) > BLOCK_BYTES and sizes.where(F.col("size") > BLOCK_BYTES).join(docs.groupBy(hashed.alias("_order")).count().where("count > 1"), "_order").first():
        docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
        hashed = F.xxhash64(F.col(doc_id), F.col(text), F.col("_row"))
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    return docs.withColumn("_order", hashed).withColumn("_block", F.floor(F.shiftrightunsigned("_order", 11) / F.lit(float(1 << 53)) * blocks).cast("long")), blocks


def bucket_count(spark: SparkSession, keys: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(keys // BUCKET_KEYS) + 1)


def planes(values: np.ndarray) -> bytes:
    """Values with their first bytes first, then their second ones and so on: the high bytes of small values are runs of
    zeros, which the shuffle's codec shortens."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(packed: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed, np.uint64), dtype=np.uint64)


REQUEST = "_bucket long, _block long, _keys binary, _facts binary"
REPLY = "_block long, _bucket long, _answer binary"


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of keys by bucket, the buckets that have any, where each starts in that order, and the end)."""
    where = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    there, starts = np.unique(where[order], return_index=True)
    return order, there, np.append(starts, len(keys))


def requests(block: int, keys: np.ndarray, facts: np.ndarray, buckets: int) -> pa.Table:
    """Rows for the buckets, from a block's distinct sorted keys and a fact for each."""
    order, there, starts = _dealt(keys, buckets)
    own = [order[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
    return pa.table({"_bucket": pa.array(there, pa.int64()), "_block": pa.array(np.full(len(there), block, np.int64)), "_keys": pa.array([pack(keys[o]) for o in own], pa.binary()), "_facts": pa.array([planes(facts[o]) for o in own], pa.binary())})


def merged(rows: pa.Table, dtype) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows, by block: (rows as dicts, all keys in their order, the facts, the block of each, number of each key)."""
    got = sorted(rows.select(["_block", "_bucket", "_keys", "_facts"]).to_pylist(), key=lambda r: r["_block"])
    keys = [unpack(r["_keys"]) for r in got]
    facts = np.concatenate([from_planes(r["_facts"], dtype) for r in got])
    blocks = np.repeat(np.array([r["_block"] for r in got], np.int64), [len(k) for k in keys])
    return got, np.concatenate(keys), facts, blocks, np.array([len(k) for k in keys], np.int64)


def replies(got: list, sizes: np.ndarray, answer: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return pa.table({"_block": pa.array([r["_block"] for r in got], pa.int64()), "_bucket": pa.array([r["_bucket"] for r in got], pa.int64()), "_answer": pa.array([planes(answer[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def answers(rows: pa.Table, keys: np.ndarray, buckets: int, dtype) -> np.ndarray:
    """The buckets' answers, in the order of the block's distinct sorted keys."""
    out = np.zeros(len(keys), dtype)
    order, there, starts = _dealt(keys, buckets)
    at = {bucket: slice(s, e) for bucket, s, e in zip(there.tolist(), starts[:-1], starts[1:], strict=True)}
    for r in rows.select(["_bucket", "_answer"]).to_pylist():
        out[order[at[r["_bucket"]]]] = from_planes(r["_answer"], dtype)
    return out


def sorted_block(rows: pa.Table) -> pa.Table:
    """A block's rows by the unsigned ``_order``, whatever order they came in."""
    place = rows.column("_order").to_numpy().view(np.uint64)
    return rows if (place[1:] >= place[:-1]).all() else rows.take(np.argsort(place, kind="stable"))


# ---- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node of its component.

    Alternating large-star and small-star steps until every component is a star; each is a pre-aggregated minimum and a
    join, and every round is written to the shared checkpoint folder. Rounds grow with the logarithm of the longest path.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        ends = edges.groupBy("u").agg(F.count("*").alias("n"))
        loose = ends.where("n > 1").select("u").unionByName(edges.select(F.col("v").alias("u")).join(ends.select("u"), "u", "left_semi"))
        if loose.first() is None:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
