import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm import common, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_link(rows, distance=2):
    """doc ids, texts -> component ids by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


@given(st.text(alphabet="aBc \t\n\x0b\x1c\xa0É", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("the cat sat",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64("the cat sat".encode(), seed=42).intdigest()


def test_golay_decoding():
    code = simhash.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    codewords = words ^ code.error[code.syndrome(words)]
    assert (code.syndrome(codewords) == 0).all() and (np.bitwise_count(words ^ codewords) <= 3).all()
    assert len(np.unique(code.index(np.arange(1 << 23, dtype=np.int64)))) == 4096


def test_every_near_pair_shares_a_key():
    random = np.random.default_rng(1)
    code = simhash.Golay()
    fps = random.integers(0, 1 << 63, 60, dtype=np.uint64) * 2 + random.integers(0, 2, 60, dtype=np.uint64)
    for errors in (0, 1, 2):
        for _ in range(60):
            flip = np.uint64(sum(1 << int(b) for b in random.choice(64, errors, replace=False)))
            stored, probed = simhash.golay_keys(fps, code)[0], simhash.golay_keys(fps ^ flip, code)[1]
            assert all(set(s) & set(p.ravel()) for s, p in zip(stored.tolist(), probed))


def fixture():
    random = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        words = random.choice(vocabulary, 120).tolist()
        rows.append((10 * d, " ".join(words)))
        for c in range(int(random.integers(0, 4))):
            changed = list(words)
            changed[int(random.integers(120))] = "new"
            rows.append((10 * d + c + 1, " ".join(changed if c else words)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "two words"), (7, rows[3][1]), (7, rows[3][1]), (None, "lonely text of a null id")]


@pytest.mark.parametrize("bucket", [64, 1])
def test_link_against_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    rows = fixture()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted(map(tuple, simhash.link(frame).collect()), key=str)
    assert got == plain_link(rows)


def test_chain_of_midpoints(spark):
    """A crowd within a few bits of a centre, joined by chains of two bits."""
    fps = [0] + [(1 << a) | (1 << b) for a in range(0, 20, 2) for b in (a + 1,)] + [0b1111, 0b111111, 1 << 40 | 0b111 << 50]
    uniq = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (64, 2):
        edges = simhash.links(uniq, bucket).collect()
        got = {frozenset((r.a, r.b)) for r in edges}
        near = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
        if bucket == 64:
            assert got == near
        parts = {r.node: r.root for r in common.components(spark.createDataFrame([tuple(e) for e in got], "a long, b long")).collect()}
        assert {f for f in fps if f in parts} == set().union(*near)
        assert parts[0] == parts[0b1111] == parts[0b111111]


def test_keep_first(spark):
    rows = fixture()
    frame = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], "doc_id long, text string, _kept string, row int")
    for distance in (2, 5):
        got = simhash.keep_first(frame, distance=distance)
        assert got.columns == frame.columns
        kept = [r.doc_id for r in got.collect()]
        expected = {d for d, _, c in plain_link(rows, distance) if d == c} | {None}
        assert len(kept) == len(set(kept)) and set(kept) >= expected  # the second fingerprint may keep a few apart
        assert distance > 2 or set(kept) == expected


def test_wide_links_up_to_five_bits_are_complete(spark, monkeypatch):
    random = np.random.default_rng(4)
    fps = [int(x) for x in random.integers(-(1 << 62), 1 << 62, 120)]
    for f in fps[:60]:
        for errors in (1, 3, 5):
            fps.append((f ^ sum(1 << int(b) for b in random.choice(62, errors, replace=False))))
    crowd = [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 62, (300, 2))]
    fps = sorted({*fps, *crowd})
    want = {r.node: r.root for r in common.components(spark.createDataFrame([(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 5], "a long, b long")).collect()}
    for rows in (50_000, 7):
        monkeypatch.setattr(simhash, "COMPARED", rows)
        edges = simhash.wide_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 5)
        assert {r.node: r.root for r in common.components(edges).collect()} == want


def test_chance_links_join_nothing():
    """A-X and X-B are near by chance; the second fingerprints agree for A and B alone."""
    a, x, b = 0, 0b1111, 0b11111111
    seconds = np.array([5, ~5, 5 ^ 0b11])
    fps = np.array([a, x, b])
    i, j = simhash.near_in_runs(np.zeros(3, np.int64), fps, 9, seconds)
    assert list(zip(fps[i], fps[j], strict=True)) == [(a, b)]
    assert len(simhash.near_in_runs(np.zeros(3, np.int64), fps, 9)[0]) == 2


def test_equal_first_fingerprints_are_verified_by_the_second():
    """Three rows of one fingerprint: the second and third agree, the first is a stranger."""
    seconds = np.array([5, ~5, ~5 ^ 0b11])
    i, j = simhash.near_in_runs(np.zeros(3, np.int64), np.array([7, 7, 7]), 9, seconds)
    assert list(zip(i, j, strict=True)) == [(1, 2)]


def test_wide_links_find_nine_bits(spark):
    """Of random pairs nine bits apart at least nine in ten meet."""
    random = np.random.default_rng(5)
    fps = [int(x) for x in random.integers(-(1 << 62), 1 << 62, 300)]
    pairs = [(f, f ^ sum(1 << int(b) for b in random.choice(62, 9, replace=False))) for f in fps]
    edges = simhash.wide_links(spark.createDataFrame([(f,) for p in pairs for f in p], "fp long"), 9)
    got = {frozenset(e) for e in edges.collect()}
    assert sum(frozenset(p) in got for p in pairs) >= 0.9 * len(pairs)


def test_long_runs_are_cut_in_chunks(spark):
    """Members of crowded keys that stand in different chunks are linked as if one task had compared them all."""
    random = np.random.default_rng(9)
    crowd = sorted({int(sum(1 << int(b) for b in random.choice(21, n, replace=False))) for n in random.integers(1, 9, 400)})
    seconds = [int(x) for x in random.integers(0, 2, len(crowd)) * ((1 << 60) - 1)]
    frame = spark.createDataFrame(list(zip(crowd, seconds, strict=True)), "fp long, second long")
    parts = lambda edges: {r.node: r.root for r in common.components(edges).collect()}
    want = parts(simhash.wide_links(frame, 5))
    for run in (16, 50):
        edges = simhash.wide_links(frame, 5, run)
        assert all(seconds[crowd.index(a)] == seconds[crowd.index(b)] for a, b in edges.collect())
        assert parts(edges) == want


def test_wide_links_against_all_verified_pairs(spark, monkeypatch):
    """A crowd in which most near fingerprints disagree in the second one."""
    random = np.random.default_rng(8)
    centres = random.integers(-(1 << 62), 1 << 62, 40)
    rows = {}
    for f in random.integers(-(1 << 62), 1 << 62, 10).tolist():
        for c in centres.tolist():
            for _ in range(3):
                near = [sum(1 << int(b) for b in random.choice(62, n, replace=False)) for n in (2, 6)]
                rows.setdefault(f ^ near[0], c ^ near[1])
    apart = lambda p, q: ((p ^ q) & (1 << 64) - 1).bit_count()
    want = {(a, b) for a in rows for b in rows if a < b and apart(a, b) <= 5 and apart(rows[a], rows[b]) <= simhash.SECOND_DISTANCE}
    parts = lambda edges: {r.node: r.root for r in common.components(edges).collect()}
    for held in (50_000, 7):
        monkeypatch.setattr(simhash, "COMPARED", held)
        edges = simhash.wide_links(spark.createDataFrame(list(rows.items()), "fp long, second long"), 5)
        assert {tuple(sorted(e)) for e in edges.collect()} <= want
        assert parts(edges) == parts(spark.createDataFrame(sorted(want), "a long, b long"))


def five_word_pairs(rows, least=0.8):
    """Pairs of ids whose sets of five-word shingles are so similar: exact, by the rarest shingles of each text."""
    sets, count = {}, Counter()
    for doc_id, text in rows:
        words = common.byte_words(text)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        count.update(sets[doc_id])
    seen, pairs = defaultdict(list), []
    for doc_id, own in sets.items():
        rarest = sorted(own, key=lambda s: (count[s], s))[: len(own) - math.ceil(least * len(own)) + 1]
        for other in {x for s in rarest for x in seen[s]}:
            both = len(own & sets[other])
            if both >= least * (len(own) + len(sets[other]) - both):
                pairs.append((doc_id, other))
        for s in rarest:
            seen[s].append(doc_id)
    return sets, pairs


def test_wide_recall_against_all_pairs_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, pairs = five_word_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    component = {r.doc_id: r.component_id for r in simhash.link(docs, distance=simhash.WIDE).collect()}
    assert len(pairs) > 50
    assert sum(component[a] == component[b] for a, b in pairs) >= 0.9 * len(pairs)
    members = defaultdict(list)
    for doc_id, least in component.items():
        members[least].append(doc_id)
    gone = [d for d, least in component.items() if d != least]
    strangers = [d for d in gone if not any(sets[d] & sets[o] for o in members[component[d]] if o != d) and sets[d]]
    assert not strangers


def test_near_copies_of_a_passage(spark):
    """Copies with one word in fifty replaced share 0.8 of their five-word shingles or more; most meet at seven bits."""
    random = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(0, 80, 2):
        words = random.choice(vocabulary, 300).tolist()
        other = [("new" if random.random() < 0.01 else w) for w in words]
        rows += [(d, " ".join(words)), (d + 1, " ".join(other))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} >= set(range(0, 80, 2)) and len(kept) <= 46


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, 2000)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, -5: -5, 2000: -5}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.link(frame).collect() == [] and simhash.keep_first(frame).collect() == []
