"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through Golay-code keys.

A fingerprint is cut in three segments of 22, 21 and 21 bits. Two or fewer differing bits leave, in cyclic order, a
segment without error followed by one with at most one (pigeonhole). The key of such an ordered pair is the first segment
itself and the 12-bit index of the codeword of the perfect [23,12,7] Golay code that the second decodes to. One side
of the join stores the index of its own segment, the other probes the indices of all words one bit away (one to six
distinct ones), so a pair with at most one error there always meets. Candidates are verified by the bits that differ.

Buckets of over ``BUCKET`` fingerprints aren't joined: their members go by exact midpoints instead. Two fingerprints
differ in two bits or fewer exactly if some word is within one bit of both, and at most 65 are within one bit of a
word, so linking the members of each midpoint to its smallest finds the same components with 65 rows a member.

Wider distances (``keep_first`` takes ``WIDE`` bits: at 0.8 of shared five-word shingles, fingerprints of three words
differ in 6 of 64 bits on average) go by keys of two segments. Among three segments with five errors or fewer, two have
at most two each (pigeonhole), and words at most two bits apart share an index of the words one bit away; so the keys
are all pairs of such indices, one to 36 for each two segments. Beyond five bits pairs whose errors crowd in two segments
(3 + 3 and more) can be missed, so the fingerprint is cut a second time, turned by half its length: of random errors the
keys then find 99.8 % at seven bits, 99 % at eight and 97 % at nine (95, 90 and 82 % by one cut).

Rows are sorted by key, members of a key compared, and of the links found in a batch only a spanning forest goes on, so a
crowd of copies gives no more rows than it has members. A key of over ``RUN`` members is cut in chunks of so many: each is
compared within itself where it lies, and every two chunks of the key then meet in a task of their own. Wide links are
verified by a second fingerprint, of five-word shingles, before their ends count as joined: the forest is of verified
links alone. Each distinct pair of fingerprints is a node, so that documents that agree in the first one alone aren't
joined unless the second one verifies it. Nodes are named by 64-bit hashes of the pair.

Edge cases: null or empty texts have fingerprint 0 and link like any other; equal fingerprints are one node, so copies
are never expanded to pairs; repeated rows and ids give repeated rows; a null doc_id counts for a component's smallest
only if no other id is there; extra columns are ignored by ``link`` and kept by ``keep_first``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_words, components, cut, hot_or_cold, small, whole_row

SHINGLE, SEED, DISTANCE, WIDE = 3, 42, 2, 9
#: Of wide links a second fingerprint, of five-word shingles, differs in so many bits at most: at a similarity of 0.8 it
#: differs in 9.7 on average, with a deviation of 2.9.
SECOND_SHINGLE, SECOND_SEED, SECOND_DISTANCE = 5, 7, 17
#: Rows of a batch in which members of a key are compared; members of a key that one task compares.
COMPARED, RUN = 50_000, 16_384
#: Turns of the fingerprint before it is cut in segments for wide links.
TURNS = (0, 32)
#: Fingerprints in a bucket up to which its pairs are compared directly.
BUCKET = 64
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = byte_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    over = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        over += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, second: bool = False) -> DataFrame:
    """(doc_id, fp long) of every row, with a second fingerprint if asked."""
    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0)]
            for words, seed in [(shingle, SEED), (SECOND_SHINGLE, SECOND_SEED)][: 1 + second]:
                columns.append(pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "second"][: len(columns)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long" + ", second long" * second)


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the nearest codeword."""

    def __init__(self):
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        each = [remainder(1 << b) for b in range(23)]
        low, high = (np.zeros(1 << n, np.int64) for n in (12, 11))
        for b in range(12):
            low[1 << b : 2 << b] = low[: 1 << b] ^ each[b]
        for b in range(11):
            high[1 << b : 2 << b] = high[: 1 << b] ^ each[12 + b]
        self.low, self.high = low, high
        self.error = np.zeros(1 << 11, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.error[int(self.syndrome(np.array([word]))[0])] = word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 4095] ^ self.high[words >> 12]

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(stored keys, n x 3; probed keys, n x 3 x 23, with repeats)."""
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    stored, probed = np.zeros((len(fps), 3), np.int64), np.zeros((len(fps), 3, 23), np.int64)
    for i in range(3):
        j = (i + 1) % 3
        head = (i << 34) | (parts[i] << 12)
        stored[:, i] = head | code.index(parts[j])
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], np.int64)
        near = code.index(parts[j][:, None] ^ flips[None, :])
        probed[:, i, : near.shape[1]] = head[:, None] | near
        probed[:, i, near.shape[1] :] = stored[:, i, None]
    return stored, probed


def keyed(uniq: DataFrame) -> DataFrame:
    """(fp, stored array<long>, probed array<long>) of distinct fingerprints."""

    def run(batches):
        code = Golay()
        for batch in small(batches):
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            stored, probed = golay_keys(fps.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stored.tolist(), pa.list_(pa.int64())), pa.array([np.unique(p).tolist() for p in probed], pa.list_(pa.int64()))], ["fp", "stored", "probed"])

    return uniq.select("fp").mapInArrow(run, "fp long, stored array<long>, probed array<long>")


def near_in_runs(keys: np.ndarray, fps: np.ndarray, distance: int, seconds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows that share a key, as numbers of rows. keys are sorted; seconds, if given,
    are the second fingerprints, which have to agree as well. Rows of the same fingerprints are one node. Members of a run
    are compared at growing steps; pairs that are joined already aren't looked at, so memory stays linear in the rows."""
    both = np.zeros(len(fps), np.int64) if seconds is None else seconds
    order = np.lexsort((both, fps))
    new = np.ones(len(fps), bool)
    new[1:] = (np.diff(fps[order]) != 0) | (np.diff(both[order]) != 0)
    number = np.empty(len(fps), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    words, proofs, root = fps[first].view(np.uint64), both[first].view(np.uint64), np.arange(len(first))
    out, at, step = [], np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        i, j = number[at], number[at + step]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(words[i] ^ words[j]) <= distance
        i, j = i[near], j[near]
        if seconds is not None:
            agree = np.bitwise_count(proofs[i] ^ proofs[j]) <= SECOND_DISTANCE
            i, j = i[agree], j[agree]
        if len(i):
            above: dict[int, int] = {}

            def top(x: int, above=above) -> int:
                while x in above:
                    x = above[x]
                return x

            for x, y, r, s in zip(i.tolist(), j.tolist(), root[i].tolist(), root[j].tolist(), strict=True):
                p, q = top(r), top(s)
                if p != q:
                    above[max(p, q)] = min(p, q)
                    out.append((x, y))
            moved = np.arange(len(first))
            for r in above:
                moved[r] = top(r)
            root = moved[root]
        step += 1
    ends = np.array(out, np.int64).reshape(-1, 2)
    return first[ends[:, 0]], first[ends[:, 1]]


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """Number of the group of each row: rows in a row with the same values in all columns."""
    new = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def wide_links(uniq: DataFrame, distance: int, run: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints up to so many bits apart, by keys of two segments. Where uniq has a
    column second, those fingerprints have to agree as well (chance meetings of wide links don't join anything), and where
    it has a column node, a and b are nodes. run: members of a key that one task compares."""
    spark, run = uniq.sparkSession, run or RUN
    names = [c for c in ("fp", "second", "node") if c in uniq.columns]
    fields = lambda *more: ", ".join(f"{n} long" for n in (*more, *names))

    def keyed_pairs(batches):
        code = Golay()
        for batch in small(batches):
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            made, sizes = [], []
            for turn, by in enumerate(TURNS):
                words = fps.view(np.uint64)
                words = words >> np.uint64(by) | words << np.uint64(64 - by) if by else words
                parts = [((words >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
                near = [code.index(p[:, None] ^ np.array([0, *(1 << k for k in range(b))], np.int64)[None, :]) for p, (_, b) in zip(parts, SEGMENTS, strict=True)]
                for rows in zip(*near, strict=True):
                    own = [np.unique(r) for r in rows]
                    keys = [(3 * turn + n << 24 | own[i][:, None] << 12 | own[j][None, :]).ravel() for n, (i, j) in enumerate(combinations(range(3), 2))]
                    made += keys
                    sizes.append(sum(map(len, keys)))
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made) if made else np.zeros(0, np.int64)), *(pa.array(np.repeat(np.tile(x, len(TURNS)), sizes)) for x in own)], ["key", *names])

    def comparing(by: int, keep: bool):
        """A function of batches sorted by their first so many columns, which compares the rows of each group. keep: rows of
        groups of a whole chunk, or of a later one, go on as well (key, chunk, then as names)."""

        def compared(batches):
            rows = [np.zeros(0, np.int64) for _ in range(by + len(names))]
            for batch in batches:
                rows = [np.concatenate((x, batch.column(c).to_numpy().astype(np.int64))) for c, x in enumerate(rows)]
                group = _groups(rows[:by])
                done = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on in the next batch
                if done >= COMPARED:
                    yield found([x[:done] for x in rows])
                    rows = [x[done:] for x in rows]
            yield found(rows)

        def found(rows):
            group, own = _groups(rows[:by]), dict(zip(names, rows[by:], strict=True))
            i, j = near_in_runs(group, own["fp"], distance, own.get("second"))
            label = own.get("node", own["fp"])
            columns = [label[i], label[j]]
            if keep:
                whole = np.flatnonzero((rows[1] > 0) | (np.bincount(group, minlength=1)[group] == run))
                none = [pa.nulls(len(i), pa.int64())] * len(rows)
                more = [pa.nulls(len(whole), pa.int64())] * 2
                arrays = [pa.concat_arrays([pa.array(x), y]) for x, y in zip(columns, more, strict=True)]
                arrays += [pa.concat_arrays([x, pa.array(y[whole])]) for x, y in zip(none, rows, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, ["a", "b", "key", "chunk", *names])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b"])

        return compared

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = uniq.select(*names).mapInArrow(keyed_pairs, fields("key")).repartition(parts, "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(*names))
    rows = rows.select("key", F.floor((place - 1) / run).alias("chunk"), *names)
    near = cut(rows.mapInArrow(comparing(2, True), "a long, b long, " + fields("key", "chunk")).distinct())
    out, crowd = near.where("a is not null").select("a", "b"), near.where("key is not null").drop("a", "b")
    last = crowd.groupBy("key").agg(F.max("chunk").alias("last")).where("last > 0")
    if last.first() is None:
        return out
    other = crowd.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).where("other <> chunk")
    meet = other.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), *names)
    by = ["key", "low", "high"]
    across = meet.repartition(parts, *by).sortWithinPartitions(*by, *names).mapInArrow(comparing(3, False), "a long, b long")
    return cut(out.unionByName(across).distinct())


def links(uniq: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints whose transitive closure holds every pair DISTANCE or fewer bits apart."""
    keys = cut(keyed(uniq))
    stored = keys.select(F.explode("stored").alias("key"), F.col("fp").alias("b"))
    probed = keys.select(F.explode("probed").alias("key"), F.col("fp").alias("a"))
    hot = cut(stored.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = probed.join(stored.join(hot, "key", "left_anti"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowd = probed.join(hot, "key", "left_semi").select("a").distinct()
    middle = crowd.select("a", F.explode(F.expr("concat(array(a), transform(sequence(0, 63), i -> a ^ shiftleft(1L, i)))")).alias("mid"))
    star = middle.withColumn("b", F.min("a").over(Window.partitionBy("mid"))).where("a <> b").select("a", "b").distinct()
    return pairs.unionByName(star)


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id. Fingerprints link at ``distance`` or fewer differing bits."""
    wide = distance > DISTANCE
    own = ["fp", *["second"] * wide]
    node = F.xxhash64(*own) if wide else F.col("fp")
    prints = cut(fingerprints(docs, doc_id, text, shingle, wide).withColumn("node", node))
    uniq = cut(prints.groupBy("node", *own).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = cut(components(wide_links(uniq, distance) if wide else links(uniq)).withColumnsRenamed({"node": "member"}))
    classes = roots.join(uniq, roots.member == uniq.node)
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    mapped = classes.join(least, "root").select("node", "least")
    full = cut(uniq.join(mapped, "node", "left").select("node", "n", F.coalesce("least", "first").alias("component_id")))
    found = hot_or_cold(prints.select("doc_id", "fp", "node"), full, "node", "n", prints.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = WIDE) -> DataFrame:
    """The documents whose id is their component's smallest; of repeated rows of one id, one row; a null id stays."""
    linked = cut(link(docs, doc_id, text, distance=distance))
    rows = docs.select(whole_row(docs), F.col(doc_id).cast("long").alias("doc_id"))
    kept = linked.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    again = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    out = rows.join(kept, "doc_id", "left_semi")
    if again.first():
        out = out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.unionByName(rows.where("doc_id is null")).select("row.*")
