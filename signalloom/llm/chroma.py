"""Chroma audio fingerprints of media columns, and their alignment.

A recording is a sequence of frames of twelve pitch classes: from PCM samples by short-time spectra (``pcm_chroma``), or
from a text read as a score, a word a frame and a byte a note (``text_chroma``). ``FILTERS`` rectangle filters over a
window of ``WIDTH`` frames, evaluated by an integral image, are each quantised to two Gray-coded bits: one packed
32-bit integer a frame. Thresholds are ratios of the filters' two areas, so loudness cancels.

Alignment in a corpus. Recordings of equal integers are one class; its smallest id stands for it, and each other member
gets one row that says so. Between the classes, content-selected landmarks (minimisers of hashes of three integers in
windows of ``WINDOW`` frames, of ``DENSE`` frames in recordings of up to ``SHORT`` integers) vote for pairs: holders of a
landmark that stands in ``FEW`` places at most meet each other; of a landmark in more places, each meets the hub, the
least class, and the least of those that one landmark is all of; and three landmarks that follow each other at equal distances are a landmark of their own with a hub of
its own, whose three votes count at once. So rows stay in proportion to places, and two recordings that share three
landmarks in a row are linked or share a hub, whatever else holds the single landmarks. A pair with ``MET`` votes at one offset
(or all landmarks of the shorter recording, where it has fewer) is a candidate; for it the integers of both recordings are
read, and all their common landmarks counted, those in many places too, in a histogram of offsets of distinct places. The best
offset (ties: the smallest) stands if it has ``VOTES`` of them, or all landmarks of the shorter recording where it has
fewer (under 16 words), and if in the stretch between the outermost of them few bits differ. ``bit_error_rate`` is
that of the whole overlap at this offset, over every integer.

What hubs leave apart is made up for: of classes that the found pairs don't connect, all pairs that share enough landmarks in
many places at one offset are enumerated and compared too (``_apart``). So each pair of classes that meets the limits is
reported, or its two classes are connected by pairs that are: the components are those of all pairs.

That is ``aligned``, whose rows stay in proportion to recordings. ``matched`` gives every pair that meets the limits, in arrays: what is shared
in many places is counted there by rooms of packed recordings and not by hubs.

Edge cases: null, empty or short recordings have no integers and no rows; repeated rows of an id never align with
themselves, and where they differ they vote together and the shortest is compared; null ids are left out; an empty table gives no rows; other columns are ignored. Not found: a short passage of a
long recording that holds under three of its landmarks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, components, cut, hot_or_cold, mix, small, stored

FILTERS, WIDTH, WINDOW, VOTES, MOST_ERRORS = 16, 12, 48, 3, 0.15
DENSE, SHORT = 12, 96
#: Places of a landmark up to which its holders meet each other; ids up to which they are broadcast.
FEW, LISTED = 16, 1_000_000
#: Votes at one offset that make a candidate, and recordings whose landmarks a task remembers.
MET, REMEMBERED = 2, 64
#: Holders of two landmarks at one distance that a task compares with all the others.
CHUNK = 256
#: Landmarks of the holders of a chunk, and rows that numpy works on at once.
CHUNK_MARKS, MOST = 1 << 16, 1 << 21
#: Landmarks in many places up to which any three of a recording are a landmark of their own.
SPREAD = 12
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, number of pitch classes) of each filter, by rule."""
    return [(k % 5, (5 * k) % 7, 6 if k % 2 else 4) for k in range(FILTERS)]


def pcm_chroma(samples: np.ndarray, rate: int, frame: int = 4096, hop: int = 1024, low: float = 28.0, high: float = 3520.0) -> np.ndarray:
    """Frames x 12 energies of pitch classes of mono samples."""
    n = max(0, 1 + (len(samples) - frame) // hop)
    if not n:
        return np.zeros((0, 12), np.float32)
    at = np.arange(frame)[None, :] + hop * np.arange(n)[:, None]
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(frame), axis=1)) ** 2
    tone = np.fft.rfftfreq(frame, 1 / rate)
    used = np.flatnonzero((tone >= low) & (tone <= high))
    to = np.zeros((len(tone), 12))
    to[used, np.round(12 * np.log2(tone[used] / 440.0)).astype(int) % 12] = 1
    return (power @ to).astype(np.float32)


def text_chroma(text: str | None) -> np.ndarray:
    """Words x 12 counts of bytes by their value modulo 12."""
    found = byte_words(text)
    if not found:
        return np.zeros((0, 12), np.float32)
    notes = np.frombuffer(b"".join(found), np.uint8) % 12
    frame = np.repeat(np.arange(len(found)), [len(w) for w in found])
    return np.bincount(frame * 12 + notes, minlength=12 * len(found)).reshape(-1, 12).astype(np.float32)


def packed(chroma: np.ndarray) -> np.ndarray:
    """The packed integer of every window of WIDTH frames."""
    n = len(chroma) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    loud = chroma.sum(axis=1, keepdims=True)
    image = np.zeros((len(chroma) + 1, 13))
    np.cumsum(chroma / np.where(loud > 0, loud, 1), axis=0, out=image[1:, 1:])
    np.cumsum(image[1:, 1:], axis=1, out=image[1:, 1:])
    image = np.ascontiguousarray(image.T)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        strip = image[p1] - image[p0]
        return strip[t1 : t1 + n] - strip[t0 : t0 + n]

    out, w = np.zeros(n, np.uint32), WIDTH
    for k, (kind, p, h) in enumerate(filters()):
        whole = area(0, w, p, p + h)
        if kind == 0:  # band against the rest
            one, two = whole * (12 - h), (w - whole) * h
        elif kind == 1:  # lower half of the band against its upper half
            one = area(0, w, p, p + h // 2)
            two = whole - one
        elif kind == 2:  # first half of the window against its second
            one = area(0, w // 2, p, p + h)
            two = whole - one
        elif kind == 3:  # opposite quarters
            one = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
            two = whole - one
        else:  # middle third of the window against the others
            one = 2 * area(w // 3, 2 * w // 3, p, p + h)
            two = whole - one / 2
        one, two = one + 0.25, two + 0.25
        level = (one > 0.8 * two).astype(np.uint8) + (one > two) + (one > 1.25 * two)
        out |= GRAY[level] << np.uint32(2 * k)
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    """Share of differing bits of two equally long sequences of integers."""
    return float(np.bitwise_count(a ^ b).mean() / 32) if len(a) else 1.0


def overlap_errors(a: np.ndarray, b: np.ndarray, offset: int, first: int = 0, last: int | None = None) -> float:
    """Bit errors of the overlap of a and b at an offset of a against b, of a's places from first to last."""
    start, stop = max(first, offset, 0), min(len(a), len(b) + offset, len(a) if last is None else last + 1)
    return bit_errors(a[start:stop], b[start - offset : stop - offset]) if stop > start else 1.0


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset of a against b, equal integers at it, bit errors of the overlap) of the fullest bin of the histogram of
    offsets at which integers are equal; ties go to the smallest offset."""
    order = np.argsort(b, kind="stable")
    from_, to = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    offsets = np.concatenate([i - order[f:t] for i, (f, t) in enumerate(zip(from_, to, strict=True))] or [np.zeros(0, int)])
    if not len(offsets):
        return 0, 0, 1.0
    values, counts = np.unique(offsets, return_counts=True)
    best = int(values[np.argmax(counts)])
    return best, int(counts.max()), overlap_errors(a, b, best)


def landmarks(prints: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit hashes) of the minimisers of hashes of three integers, every window having one."""
    if len(prints) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = prints.astype(np.uint64)
    own = mix(mix(x[:-2] << np.uint64(32) | x[1:-1]) + x[2:])
    width, have, least = min(window, len(own)), 1, own
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    # the leftmost place of the least hash in the window at which it becomes the least
    at = [c + int(np.argmin(own[c : c + width])) for c in change.tolist()]
    at = np.unique(np.array(at, np.int64))
    return at, own[at]


def marked(prints: np.ndarray, votes: int = VOTES) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks, of a short recording or one with few of them dense ones, at last all; one or two integers are a landmark."""
    if 0 < len(prints) < 3:
        return np.zeros(1, np.int64), mix(np.array([int(prints[0]) << 32 | int(prints[-1])], np.uint64) ^ np.uint64(len(prints)))
    at, keys = landmarks(prints)
    if len(prints) <= SHORT or len(at) < votes:
        at, keys = landmarks(prints, DENSE)
    return landmarks(prints, 1) if len(at) < votes else (at, keys)


def mark_sets(prints: np.ndarray, votes: int = VOTES) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(the sets of landmarks of a recording, how many are as good as all): its own, and where those are dense the ones that a long
    recording would have, as it has only these and their triples have to meet."""
    own, wide = marked(prints, votes), landmarks(prints)
    return [own, *([wide] if 2 < len(wide[0]) < len(own[0]) else [])], min(len(own[0]), votes)


def counted(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int, int] | None:
    """(offset, votes, first place, last place) of the fullest bin of the histogram of offsets of common landmarks (places, keys) of two
    recordings, y's being sorted by key; a vote is a place of x. Ties go to the smallest offset; None without any."""
    (at, keys), (to, other) = x, y
    begin, end = np.searchsorted(other, keys, "left"), np.searchsorted(other, keys, "right")
    n = end - begin
    place = np.repeat(at, n)
    if not len(place):
        return None
    offset = place - to[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(place))]
    votes = np.unique(np.column_stack((offset, place)), axis=0)
    values, counts = np.unique(votes[:, 0], return_counts=True)
    best = values[np.argmax(counts)]
    own = votes[votes[:, 0] == best, 1]
    return int(best), len(own), int(own.min()), int(own.max())


def triples(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each landmark the 64-bit hash of it, the next two and their distances (0 for the last two landmarks), and the
    distances of those two."""
    n = max(0, len(at) - 2)
    whole, one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    one[:n], two[:n] = at[1 : n + 1] - at[:n], at[2 : n + 2] - at[:n]
    whole[:n] = mix(mix(mix(keys[:n]) + keys[1 : n + 1] + one[:n].astype(np.uint64)) + keys[2 : n + 2] + two[:n].astype(np.uint64))
    return whole, one, two


def _printed(batches, rate: int | None):
    """(id, integers) of recordings: texts, or with a rate 16-bit mono PCM."""
    for batch in small(batches):
        for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield name, packed(text_chroma(x) if rate is None else pcm_chroma(np.frombuffer(x or b"", "<i2").astype(np.float32), rate))


def _node(prints: np.ndarray) -> int:
    """The class of a recording: a hash of its integers."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(prints.astype("<u4").tobytes())).view(np.int64))


def _batched(rows, schema: pa.Schema, most: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def fingerprints(media: DataFrame, media_id: str, column: str, rate: int | None = None) -> DataFrame:
    """(media_id, prints binary of packed little-endian integers). column: text, or with a rate 16-bit mono PCM."""
    schema = pa.schema([("media_id", pa.int64()), ("prints", pa.binary())])
    run = lambda batches: _batched(((n, p.astype("<u4").tobytes()) for n, p in _printed(batches, rate)), schema, 64)
    return media.select(F.col(media_id).cast("long").alias("media_id"), F.col(column).alias("x")).mapInArrow(run, "media_id long, prints binary")


def marks_of(media: DataFrame, rate: int | None, votes: int) -> DataFrame:
    """(media_id, node, few, marks array of (key, place, triple, one, two)) of media (media_id, x) that have integers. few: landmarks
    that are as good as all, ``votes`` at most."""
    mark = pa.struct([("key", pa.int64()), ("place", pa.int32()), ("triple", pa.int64()), ("one", pa.int32()), ("two", pa.int32())])
    schema = pa.schema([("media_id", pa.int64()), ("node", pa.int64()), ("few", pa.int32()), ("marks", pa.list_(mark))])

    def rows(batches):
        for name, own in _printed(batches, rate):
            parts, few = mark_sets(own, votes)
            if not few:
                continue
            following = [np.concatenate(x) for x in zip(*(triples(*p) for p in parts), strict=True)]
            at, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = [keys.view(np.int64), at, following[0].view(np.int64), *following[1:]]
            yield name, _node(own), few, [dict(zip(("key", "place", "triple", "one", "two"), x, strict=True)) for x in zip(*(c.tolist() for c in columns), strict=True)]

    run = lambda batches: _batched(rows(batches), schema)
    return media.mapInArrow(run, "media_id long, node long, few int, marks array<struct<key: long, place: int, triple: long, one: int, two: int>>")


def _held(classes: DataFrame) -> tuple[DataFrame, int]:
    """((id, few, key, place, n) of landmarks that several recordings hold, n being its places; number of all landmarks)."""
    marks = classes.select(F.col("media_id").alias("id"), "few", F.inline("marks"))
    places = cut(marks.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "n"))
    total = classes.agg(F.sum(F.size("marks"))).first()[0] or 0
    return stored(hot_or_cold(marks, places.withColumn("_n", F.col("n")), "key", "_n", total)), total


def _met(held: DataFrame) -> DataFrame:
    """(a, b, start, place, few): holders of a landmark in few places meet each other."""
    pair = lambda x, y: F.struct(x.id.alias("a"), y.id.alias("b"), (x.place - y.place).alias("start"), x.place.alias("place"), F.least(x.few, y.few).alias("few"))
    group = held.where(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "place", "few"))).alias("g"))
    return group.select(F.explode(F.flatten(F.transform("g", lambda y: F.transform(F.filter("g", lambda x: x.id > y.id), lambda x: pair(x, y))))).alias("p")).select("p.*")


def _votes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, start, place, few, rare): places of recording a at which a landmark votes for b, a being the larger id, rare if it stands in
    few places; (id, few, key, place) of landmarks in more)."""
    held, total = _held(classes)
    met = _met(held)
    # the others meet a hub
    crowd = held.where(F.col("n") > FEW)

    def hubs(rows: DataFrame, by: str, least=("id", "place", "few")) -> DataFrame:
        named = cut(rows.groupBy(by).agg(F.min(F.struct(*least)).alias("h"), F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("_n")).where("first <> last").select(by, "h", "_n"))
        return hot_or_cold(rows, named, by, "_n", total).where("id <> h.id")

    def row(at: F.Column) -> list[F.Column]:
        larger, shift = F.col("id") > F.col("h.id"), F.col("place") - F.col("h.place")
        return [F.greatest("id", "h.id").alias("a"), F.least("id", "h.id").alias("b"), F.when(larger, shift).otherwise(-shift).alias("start"), F.when(larger, at).otherwise(at - shift).alias("place"), F.least("few", "h.few").alias("few")]

    single = hubs(crowd, "key").select(*row(F.col("place")))
    lone = cut(crowd.where("few = 1").select("key").distinct())
    if lone.first() is not None:
        # a recording of one landmark is linked with all that hold it
        single = single.unionByName(hubs(crowd.join(lone, "key", "left_semi"), "key", ("few", "id", "place")).select(*row(F.col("place"))))
    three = F.explode(F.array("place", F.col("place") + F.col("one"), F.col("place") + F.col("two"))).alias("at")
    runs = hubs(crowd.where("triple <> 0"), "triple").select("*", three).select(*row(F.col("at")))
    votes = met.withColumn("rare", F.lit(True)).unionByName(single.unionByName(runs).withColumn("rare", F.lit(False)))
    return votes.groupBy("a", "b", "start", "place").agg(F.min("few").alias("few"), F.max("rare").alias("rare")), crowd.select("id", "few", "key", "place")


def _shared(rows: DataFrame) -> DataFrame:
    """(media_id, match_id) of recordings a and b that may share enough landmarks at one offset, of rows (a, b, at, to, few_a, few_b), one for
    each pair of landmarks at one distance that both hold, without a place where one holds it more than once."""
    need = F.least(F.min("few_a"), F.min("few_b"))
    found = rows.groupBy("a", "b", (F.col("at") - F.col("to")).alias("offset")).agg(F.count("*").alias("n"), need.alias("need"))
    # v landmarks at an offset have v - 1 distances from the first, all different, however often each is found
    found = found.groupBy("a", "b").agg(F.max(F.when(F.col("offset").isNotNull(), F.col("n"))).alias("n"), F.sum("n").alias("total"), F.max(F.col("offset").isNull()).alias("again"), F.min("need").alias("need"))
    return found.where("2 * n >= need * (need - 1) or again and total >= need - 1").select(F.col("a").alias("media_id"), F.col("b").alias("match_id"))


def _apart(crowd: DataFrame, bins: DataFrame, links: DataFrame, verified) -> DataFrame | None:
    """What ``verified`` leaves of pairs (media_id, match_id) that links (media_id, match_id) don't connect and that share enough landmarks at one
    offset, two of them at least in many places; None without any. bins: (a, b) of one vote of a landmark in few places.

    Only landmarks, and then pairs of landmarks at one distance, whose holders lie in several components are looked at; a pair of
    recordings that shares v landmarks at an offset shares v (v - 1) / 2 pairs of them. The rows that meet are one a recording and pair
    of landmarks, so that a recording that repeats itself isn't met by the square of its repeats. First the holders of any three landmarks
    meet the least of them, so that copies with differences are connected; what that leaves apart is enumerated."""
    root = cut(components(links.select(F.col("media_id").alias("a"), F.col("match_id").alias("b"))))
    root = F.broadcast(root) if root.count() <= LISTED else root
    own = lambda frame, id_, comp: frame.join(root.select(F.col("node").alias(id_), F.col("root").alias("_root")), id_, "left").withColumn(comp, F.coalesce("_root", id_)).drop("_root")

    def spanning(rows: DataFrame, by: str) -> DataFrame:
        """rows of keys that are held in several components, with the number of holders and the fewest landmarks of one."""
        facts = cut(rows.groupBy(by).agg(F.count("*").alias("n"), F.min("few").alias("least"), F.min("comp").alias("_first"), F.max("comp").alias("_last")).where("_first <> _last").select(by, "n", "least", F.col("n").alias("_n")))
        total = facts.agg(F.sum("n")).first()[0] or 0
        return stored(hot_or_cold(rows, facts, by, "_n", total))

    marks = spanning(own(crowd.distinct(), "id", "comp"), "key")
    several = marks.groupBy("id", "comp", "few").agg(F.collect_set(F.struct("place", "key")).alias("g")).where(F.size("g") > 1)
    if several.first() is None:
        return None
    two = several.select("id", "comp", "few", "g", F.explode("g").alias("x")).select("id", "comp", "few", "x", F.explode(F.filter("g", lambda y: y.place > F.col("x.place"))).alias("y"))
    two = stored(two.select("id", "comp", "few", F.col("x.place").alias("one"), F.col("y.place").alias("two"), F.xxhash64("x.key", "y.key", F.col("y.place") - F.col("x.place")).alias("both")))
    met = spanning(two, "both")
    # of three landmarks each has two others
    ends = met.select("id", F.explode(F.array("one", "two")).alias("place")).groupBy("id", "place").count().where("count > 1").select("id", "place")
    whole = met.join(ends.withColumnRenamed("place", "one"), ["id", "one"], "left_semi").join(ends.withColumnRenamed("place", "two"), ["id", "two"], "left_semi")
    used = whole.where("least > 2").unionByName(met.where("least <= 2").select(*whole.columns))
    # a recording that repeats itself has two landmarks at one distance many times: they are one row, of no place
    once = stored(used.groupBy("both", "id", "comp", "few").agg(F.when(F.count("*") == 1, F.min("one")).alias("place")))

    # any three landmarks of recordings that have few: their holders meet the least one
    later = lambda x: F.explode(F.filter("g", lambda y: y.place > F.col(f"{x}.place")))
    threes = several.where(F.size("g").between(3, SPREAD)).select("id", "comp", "g", F.explode("g").alias("x")).select("*", later("x").alias("y")).select("*", later("y").alias("z"))
    threes = stored(threes.select("id", "comp", F.xxhash64("x.key", "y.key", "z.key", F.col("y.place") - F.col("x.place"), F.col("z.place") - F.col("x.place")).alias("three")).distinct())
    hubs = cut(threes.groupBy("three").agg(F.min(F.struct("id", "comp")).alias("h"), F.min("comp").alias("_first"), F.max("comp").alias("_last"), F.count("*").alias("_n")).where("_first <> _last").select("three", "h", "_n"))
    beside = hot_or_cold(threes, hubs, "three", "_n", threes.count()).where("comp <> h.comp")
    first = verified(beside.select(F.col("id").alias("media_id"), F.col("h.id").alias("match_id")).distinct())
    now = lambda frame, comp: frame
    if first is not None:
        ends = own(own(first.select("media_id", "match_id"), "media_id", "a"), "match_id", "b").select("a", "b")
        joined = cut(components(ends))
        joined = F.broadcast(joined) if joined.count() <= LISTED else joined
        now = lambda frame, comp: frame.join(joined.select(F.col("node").alias(comp), F.col("root").alias("_root")), comp, "left").withColumn(comp, F.coalesce("_root", comp)).drop("_root")
    rest = spanning(now(once, "comp"), "both")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    left = rest.select("both", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), F.col("id").alias("a"), F.col("comp").alias("x"), F.col("place").alias("at"), F.col("few").alias("few_a"))
    right = rest.select("both", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("id").alias("b"), F.col("comp").alias("y"), F.col("place").alias("to"), F.col("few").alias("few_b"))
    crowded = _shared(left.join(right, ["both", "chunk"]).where("a > b and x <> y"))
    ids = cut(several.select("id"))
    held = lambda frame, side: frame.join(F.broadcast(ids) if ids.count() <= LISTED else ids, F.col(side) == F.col("id"), "left_semi")
    mixed = now(now(own(own(held(held(bins.select("a", "b"), "a"), "b"), "a", "x"), "b", "y"), "x"), "y").where("x <> y").select(F.col("a").alias("media_id"), F.col("b").alias("match_id"))
    second = verified(crowded.unionByName(mixed).distinct())
    return second if first is None else first if second is None else first.unionByName(second)


def aligned(media: DataFrame, media_id: str, column: str, rate: int | None = None, votes: int = VOTES, most_errors: float = MOST_ERRORS) -> DataFrame:
    """media_id, class_id (smallest id of equal recordings), match_id, start (offset of the recording against its match, in
    frames), votes, bit_error_rate (of the overlap). A row for each pair of classes that align, between their smallest ids
    (the larger is media_id), and one for each other member of a class, whose match is the class."""
    slim = media.where(F.col(media_id).isNotNull()).select(F.col(media_id).cast("long").alias("media_id"), F.col(column).alias("x"))
    # read more than once, computed once
    found = stored(marks_of(slim, rate, votes))
    ids = found.groupBy("node", "media_id").agg(F.max(F.size("marks")).alias("size"))
    classes = cut(ids.groupBy("node").agg(F.min("media_id").alias("class_id"), F.count("*").alias("n")))
    copies = hot_or_cold(ids, classes.where("n > 1"), "node", "n", found.count()).where("media_id <> class_id")
    members = copies.select("media_id", "class_id", F.col("class_id").alias("match_id"), F.lit(0).alias("start"), F.col("size").alias("votes"), F.lit(0.0).alias("bit_error_rate"))

    each, crowd = _votes(_first(found, cut(copies.select("media_id", "node"))))
    bins = each.groupBy("a", "b", "start").agg(F.count("*").alias("votes"), F.min("few").alias("few"), F.max("rare").alias("rare"))
    enough = F.col("votes") >= F.when(F.col("few") <= MET, 1).otherwise(MET)
    bins = stored(bins.where(enough | F.col("rare")).select("a", "b", enough.alias("enough")).distinct())
    pairs = cut(bins.where("enough").select(F.col("a").alias("media_id"), F.col("b").alias("match_id")))
    verified = stored(_verified(pairs, slim, rate, votes, most_errors))

    def others(apart: DataFrame) -> DataFrame | None:
        """What stands of pairs that weren't candidates before; None if there are no such pairs."""
        rest = cut(apart.join(pairs, ["media_id", "match_id"], "left_anti"))
        return stored(_verified(rest, slim, rate, votes, most_errors)) if rest.first() is not None else None

    apart = _apart(crowd, bins.where("not enough"), verified, others)
    if apart is not None:
        verified = verified.unionByName(apart)
    return members.unionByName(verified.select("media_id", F.col("media_id").alias("class_id"), "match_id", "start", "votes", "bit_error_rate"))


def _first(found: DataFrame, copies: DataFrame) -> DataFrame:
    """One row a class: copies of another recording are left out, and repeated rows of an id."""
    few = copies.count() <= LISTED
    rows = found.join(F.broadcast(copies) if few else copies, ["media_id", "node"], "left_anti")
    again = found.groupBy("media_id", "node").count().where("count > 1").select("media_id", "node")
    if again.first() is None:
        return rows
    once = rows.join(again, ["media_id", "node"], "left_semi").dropDuplicates(["node"])
    return rows.join(again, ["media_id", "node"], "left_anti").unionByName(once)


def _verified(pairs: DataFrame, media: DataFrame, rate: int | None, votes: int, most_errors: float) -> DataFrame:
    """pairs with start, votes and bit_error_rate, where the best offset has the votes and the stretch between its landmarks differs
    in few bits. Only recordings of a pair are read again."""
    ids = cut(pairs.select(F.explode(F.array("media_id", "match_id")).alias("media_id")).distinct())
    own = media.join(F.broadcast(ids) if ids.count() <= LISTED else ids, "media_id", "left_semi")
    schema = pa.schema([("media_id", pa.int64()), ("length", pa.int32()), ("prints", pa.binary())])

    def rows(batches):
        for name, p in _printed(batches, rate):
            if len(p):
                yield name, len(p), p.astype("<u4").tobytes()

    prints = stored(own.mapInArrow(lambda batches, schema=schema: _batched(rows(batches), schema, 64), "media_id long, length int, prints binary"))

    def side(name: str) -> DataFrame:
        mine = cut(pairs.select(F.col(name).alias("media_id")).distinct())
        some = prints.join(F.broadcast(mine) if mine.count() <= LISTED else mine, "media_id", "left_semi")
        return some.groupBy(F.col("media_id").alias(name)).agg(F.min(F.struct("length", "prints")).alias(f"{name}_r"))

    met = pairs.join(side("media_id"), "media_id").join(side("match_id"), "match_id")
    schema = pa.schema([("media_id", pa.int64()), ("match_id", pa.int64()), ("start", pa.int32()), ("votes", pa.int32()), ("stretch", pa.float64()), ("bit_error_rate", pa.float64())])

    def compared(batches):
        known: dict[bytes, tuple] = {}

        def read(held: bytes) -> tuple:
            """(integers, landmarks sorted by key, how many are as good as all)."""
            if held not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = np.frombuffer(held, "<u4")
                parts, few = mark_sets(own, votes)
                at, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys, kind="stable")
                known[held] = own, (at[order], keys[order]), few
            return known[held]

        for batch in small(batches):
            for r in batch.to_pylist():
                x, mine, few = read(r["media_id_r"]["prints"])
                y, theirs, other = read(r["match_id_r"]["prints"])
                found = counted(mine, theirs)
                if found is not None and found[1] >= min(few, other):
                    start, n, first, last = found
                    yield r["media_id"], r["match_id"], start, n, overlap_errors(x, y, start, first, last + 2), overlap_errors(x, y, start)

    return met.mapInArrow(lambda batches: _batched(compared(batches), schema), "media_id long, match_id long, start int, votes int, stretch double, bit_error_rate double").where(F.col("stretch") <= most_errors)


# ---- every pair -----------------------------------------------------------------------------------------------------


def _bins(pair: np.ndarray, offset: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, offset, votes, first place, last place) of each bin, sorted by pair and offset; a vote is a place."""
    order = np.lexsort((place, offset, pair))
    pair, offset, place = pair[order], offset[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (offset[1:] != offset[:-1])
    once = new.copy()
    once[1:] |= place[1:] != place[:-1]
    pair, offset, place, new = pair[once], offset[once], place[once], new[once]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(pair))[: len(begin)]
    return pair[begin], offset[begin], end - begin, place[begin], place[end - 1]


def _fullest(bins: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The fullest bin of each pair, of several the one with the smallest offset."""
    order = np.lexsort((bins[1], -bins[2], bins[0]))
    pair = bins[0][order]
    order = order[np.append(np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])]
    return tuple(x[order] for x in bins)


def _equal(owner: np.ndarray, rank: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Equal landmarks (ranks) of a left and a right recording, all of some left ones at a time: (x, y, rank, offset, place of x). Landmarks are
    given by their owner, in its order; left and right say for each owner whether it is one."""
    there, own = np.flatnonzero(right[owner]), np.flatnonzero(left[owner])
    there = there[np.argsort(rank[there], kind="stable")]
    begin = np.searchsorted(rank[there], rank[own], "left")
    n = np.searchsorted(rank[there], rank[own], "right") - begin
    turn = np.cumsum(np.bincount(owner[own], weights=n, minlength=len(left)))[owner[own]] // MOST
    for t in np.unique(turn).tolist():
        some = turn == t
        mine, first, count = own[some], begin[some], n[some]
        k = np.repeat(np.arange(len(mine)), count)
        other = there[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(k))]
        x = mine[k]
        yield owner[x], owner[other], rank[x], place[x] - place[other], place[x]


def room_pairs(key: int, ids: np.ndarray, few: np.ndarray, side: np.ndarray, owner: np.ndarray, n: np.ndarray, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(larger, smaller places in ids) of recordings of a room, left (side 0) and right ones (1) or both (2), that have votes enough by the given landmarks
    and whose first common landmark, in the order of n and key, is that of the room."""
    order = np.lexsort((keys, n))
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    own, size, found = rank[np.argmax(keys == key)], len(ids), []
    for x, y, r, offset, at in _equal(owner, rank, place, side != 1, side != 0):
        use = (ids[x] > ids[y]) | (side[x] != 2)
        x, y, r, offset, at = x[use], y[use], r[use], offset[use], at[use]
        pair, first = x * size + y, np.full(size * size, len(keys))
        np.minimum.at(first, pair, r)
        use = first[pair] == own
        pair, _, votes, _, _ = _fullest(_bins(pair[use], offset[use], at[use]))
        found.append(pair[votes >= np.minimum(few[pair // size], few[pair % size])])
    pair = np.concatenate(found) if found else np.zeros(0, np.int64)
    x, y = pair // size, pair % size
    return np.where(ids[x] > ids[y], x, y), np.where(ids[x] > ids[y], y, x)


def _errors(flat: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of differing bits of n integers from places x and y of flat on, 1 for none."""
    out, turn = np.ones(len(n)), np.cumsum(n) // MOST
    for t in np.unique(turn).tolist():
        some = np.flatnonzero((turn == t) & (n > 0))
        count = n[some]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        bits = np.cumsum(np.bitwise_count(flat[np.repeat(x[some], count) + at] ^ flat[np.repeat(y[some], count) + at]), dtype=np.int64)
        sums = np.diff(np.append(0, bits[ends - 1])) if len(ends) else bits
        out[some] = sums / count / 32
    return out


def compared(prints: list[np.ndarray], x: np.ndarray, y: np.ndarray, votes: int = VOTES, most_errors: float = MOST_ERRORS) -> tuple[np.ndarray, ...]:
    """(x, y, start, votes, bit error rate of the overlap) of the pairs (places in prints) that stand: as ``counted`` and ``overlap_errors`` have
    them pair by pair."""
    size, parts, few = len(prints), [], np.zeros(len(prints), np.int64)
    for k, own in enumerate(prints):
        sets, few[k] = mark_sets(own, votes)
        parts.append([np.concatenate(c) for c in zip(*sets, strict=True)])
    owner = np.repeat(np.arange(size), [len(p[0]) for p in parts])
    place, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    rank = np.unique(keys, return_inverse=True)[1]
    asked, left, right = np.zeros(size * size, bool), np.zeros(size, bool), np.zeros(size, bool)
    asked[x * size + y], left[x], right[y] = True, True, True
    found = []
    for i, j, _, offset, at in _equal(owner, rank, place, left, right):
        use = asked[i * size + j]
        found.append(_fullest(_bins((i * size + j)[use], offset[use], at[use])))
    pair, start, count, first, last = (np.concatenate([f[k] for f in found]) for k in range(5))
    use = count >= np.minimum(few[pair // size], few[pair % size])
    pair, start, count, first, last = (v[use] for v in (pair, start, count, first, last))
    x, y, length = pair // size, pair % size, np.array([len(p) for p in prints])
    flat, begin = np.concatenate(prints), np.cumsum(length) - length
    low, high = np.maximum(start, 0), np.minimum(length[x], length[y] + start)
    within, until = np.maximum(low, first), np.minimum(high, last + 3)
    stretch = _errors(flat, begin[x] + within, begin[y] + within - start, np.maximum(until - within, 0))
    x, y, start, count, low, high = (v[stretch <= most_errors] for v in (x, y, start, count, low, high))
    return x, y, start, count, _errors(flat, begin[x] + low, begin[y] + low - start, np.maximum(high - low, 0))


def _rooms(crowd: DataFrame, votes: int) -> DataFrame:
    """(key, lo, hi, ids, a, b): recordings that share enough landmarks in many places, by rooms; a and b are places in ids.

    A room is a landmark, and two of the chunks that its holders are dealt to. A recording is in those of its landmarks, in the order of
    rarity, that can be the first of enough that a pair shares: with v landmarks and at least t to share, v - t + 1. So each pair meets where its first
    common landmark is, and is counted in that room alone."""
    shared = stored(crowd.distinct().groupBy("id", "few").agg(F.array_sort(F.collect_list(F.struct("n", "key", "place"))).alias("g")))
    # a recording with fewer landmarks is content with fewer common ones
    low = cut(crowd.where(F.col("few") < votes).groupBy("key").agg(F.min("few").alias("least")))
    each = F.transform("g", lambda x, i: F.struct(x.key.alias("key"), (F.size("g") - i).alias("reach"), F.coalesce(F.get("g", i - 1)["key"] != x.key, F.lit(True)).alias("new")))
    rows = shared.select("id", "few", "g", F.explode(F.filter(each, lambda x: x.new)).alias("e")).select("id", "few", "g", "e.key", "e.reach")
    rows = rows.join(F.broadcast(low) if low.count() <= LISTED else low, "key", "left").where("reach >= least(few, coalesce(least, few))").drop("reach", "least")
    facts = cut(rows.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.size("g")).alias("size")).where("_n > 1"))
    facts = facts.select("key", "_n", F.greatest(F.ceil(F.col("_n") / CHUNK), F.ceil(F.col("size") / CHUNK_MARKS)).cast("int").alias("chunks"))
    dealt = hot_or_cold(rows, facts, "key", "_n", facts.agg(F.sum("_n")).first()[0] or 0).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    rooms = dealt.groupBy("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list(F.struct("id", "few", side.alias("side"), "g")).alias("members"))
    schema = "key long, lo int, hi int, ids array<long>, a array<int>, b array<int>"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                room = batch.slice(k, 1)
                who = room.column(3).flatten()
                ids, few, side, g = (who.field(c) for c in range(4))
                ids, few, side = (v.to_numpy() for v in (ids, few, side))
                owner = np.repeat(np.arange(len(ids)), g.value_lengths().to_numpy())
                n, keys, place = (v.to_numpy() for v in g.flatten().flatten())
                a, b = room_pairs(room.column(0)[0].as_py(), ids, few, side, owner, n, keys, place.astype(np.int64))
                if len(a):
                    used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
                    lists = [[x] for x in (ids[used], at[: len(a)].astype(np.int32), at[len(a) :].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*room.columns[:3], pa.array(lists[0], pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.int32())) for x in lists[1:])], ["key", "lo", "hi", "ids", "a", "b"])

    return stored(rooms.mapInArrow(run, schema))


MATCH = "struct<match_id: long, start: int, votes: int, bit_error_rate: double>"


def _of_rooms(rooms: DataFrame, media: DataFrame, rate: int | None, votes: int, most_errors: float) -> DataFrame:
    """(id, matches, above) of the pairs of rooms that stand: matches with smaller ids, and larger ids. Recordings of pairs are read again."""
    ids = cut(rooms.select(F.explode("ids").alias("media_id")).distinct())
    own = media.join(F.broadcast(ids) if ids.count() <= LISTED else ids, "media_id", "left_semi")
    prints = stored(fingerprints(own, "media_id", "x", rate).where("length(prints) > 0"))
    place = rooms.select("key", "lo", "hi", F.posexplode("ids").alias("at", "media_id")).join(prints, "media_id")
    held = place.groupBy("key", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("at", "prints"))).alias("held"))
    schema = pa.schema([("id", pa.int64()), ("matches", pa.list_(pa.struct([("match_id", pa.int64()), ("start", pa.int32()), ("votes", pa.int32()), ("bit_error_rate", pa.float64())]))), ("above", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                room = batch.slice(k, 1)
                names, a, b = (room.column(c).flatten().to_numpy() for c in range(3))
                prints = [np.frombuffer(x.as_py(), "<u4") for x in room.column(3).flatten().field(1)]
                x, y, *facts = compared(prints, a.astype(np.int64), b.astype(np.int64), votes, most_errors)
                order = np.lexsort((y, x))
                size = np.bincount(x, minlength=len(names))
                match = pa.StructArray.from_arrays([pa.array(names[y[order]]), *(pa.array(f[order].astype(np.int32)) for f in facts[:2]), pa.array(facts[2][order])], ["match_id", "start", "votes", "bit_error_rate"])
                matches = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), match)
                order, count = np.lexsort((x, y)), np.bincount(y, minlength=len(names))
                above = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(names[x[order]]))
                found = pa.table([pa.array(names), matches, above], schema=schema).filter(pa.array(size + count > 0))
                yield from found.to_batches()

    return rooms.join(held, ["key", "lo", "hi"]).select("ids", "a", "b", "held").mapInArrow(run, f"id long, matches array<{MATCH}>, above array<long>")


def _single(media: DataFrame, found: DataFrame, rate: int | None, votes: int) -> tuple[DataFrame, DataFrame]:
    """media and its landmarks with one row an id that has several with integers: the shortest."""
    again = cut(found.groupBy("media_id").count().where("count > 1").select("media_id"))
    if again.first() is None:
        return media, found
    kind = dict(media.dtypes)["x"]

    def sized(batches):
        for batch in small(batches):
            own = [p.astype("<u4").tobytes() for _, p in _printed([batch], rate)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(p) for p in own], pa.int64()), pa.array(own, pa.binary())], ["media_id", "x", "length", "prints"])

    rows = media.join(again, "media_id", "left_semi").select("media_id", "x").mapInArrow(sized, f"media_id long, x {kind}, length long, prints binary")
    one = cut(rows.where("length > 0").groupBy("media_id").agg(F.min_by("x", F.struct("length", "prints")).alias("x")))
    return media.join(again, "media_id", "left_anti").unionByName(one), found.join(again, "media_id", "left_anti").unionByName(marks_of(one, rate, votes))


def matched(media: DataFrame, media_id: str, column: str, rate: int | None = None, votes: int = VOTES, most_errors: float = MOST_ERRORS) -> DataFrame:
    """media_id, class_id (smallest id of equal recordings), n_links, matches: array of (match_id, start, votes, bit_error_rate) as in
    ``aligned``. Every pair of classes that meets the limits is there, however many recordings hold its landmarks: in the row of the larger of their
    smallest ids; n_links counts the pairs both ways. Each other member of a class has one match, the class. Recordings without any match have no row.

    Holders of a landmark in few places meet as rows. What is shared in many places is counted by rooms of packed recordings (``_rooms``), so that
    rows grow with recordings and rooms, and only the work, and the result's arrays, with the square of a crowd."""
    slim = media.where(F.col(media_id).isNotNull()).select(F.col(media_id).cast("long").alias("media_id"), F.col(column).alias("x"))
    slim, found = _single(slim, stored(marks_of(slim, rate, votes)), rate, votes)
    ids = found.select("node", "media_id", F.size("marks").alias("size"))
    classes = cut(ids.groupBy("node").agg(F.min("media_id").alias("class_id"), F.count("*").alias("n")))
    copies = hot_or_cold(ids, classes.where("n > 1"), "node", "n", found.count()).where("media_id <> class_id")
    match = lambda *facts: F.struct(*[f.cast(t).alias(n) for f, (n, t) in zip(facts, (("match_id", "long"), ("start", "int"), ("votes", "int"), ("bit_error_rate", "double")), strict=True)])
    members = copies.select("media_id", "class_id", F.lit(1).alias("n_links"), F.array(match(F.col("class_id"), F.lit(0), F.col("size"), F.lit(0.0))).alias("matches"))

    held, _ = _held(_first(found, cut(copies.select("media_id", "node"))))
    crowd = held.where(F.col("n") > FEW).select("id", "few", "key", "place", "n")
    bins = _met(held).groupBy("a", "b", "start").agg(F.count_distinct("place").alias("votes"), F.min("few").alias("few"))
    pairs = stored(bins.groupBy("a", "b").agg((F.max("votes") >= F.min("few")).alias("enough")))
    # those with too few votes by landmarks in few places may have the others by landmarks in many
    several = stored(crowd.groupBy("id").agg(F.collect_set("key").alias("keys")))
    side = lambda name, keys: several.select(F.col("id").alias(name), F.col("keys").alias(keys))
    more = pairs.where("not enough").join(side("a", "x"), "a").join(side("b", "y"), "b").where(F.arrays_overlap("x", "y"))
    asked = cut(pairs.where("enough").select("a", "b").unionByName(more.select("a", "b")).select(F.col("a").alias("media_id"), F.col("b").alias("match_id")))
    few = _verified(asked, slim, rate, votes, most_errors).select("media_id", "match_id", match(*(F.col(c) for c in ("match_id", "start", "votes", "bit_error_rate"))).alias("m"))
    few = stored(few)
    none, nobody = F.array().cast(f"array<{MATCH}>"), F.array().cast("array<long>")
    rows = few.select(F.col("media_id").alias("id"), F.array("m").alias("matches"), nobody.alias("above")).unionByName(few.select(F.col("match_id").alias("id"), none.alias("matches"), F.array("media_id").alias("above")))
    rows = rows.unionByName(_of_rooms(_rooms(crowd, votes), slim, rate, votes, most_errors))
    # a pair that landmarks of both kinds have found is the same twice
    both = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"), F.size(F.array_distinct(F.flatten(F.collect_list("above")))).alias("above"))
    return members.unionByName(both.select(F.col("id").alias("media_id"), F.col("id").alias("class_id"), (F.size("matches") + F.col("above")).alias("n_links"), "matches"))
