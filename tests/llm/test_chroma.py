import numpy as np

from signalloom.llm import chroma


def tune(rate=8000, seconds=24, seed=0):
    random = np.random.default_rng(seed)
    t = np.arange(rate // 4) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (int(random.integers(24)) / 12) * t) for _ in range(4 * seconds)]).astype(np.float32) * 8000


def test_pitch_classes():
    t = np.arange(8000) / 8000
    for steps in (0, 3, 7, 12):
        got = chroma.pcm_chroma(np.sin(2 * np.pi * 440 * 2 ** (steps / 12) * t), 8000)
        assert (got.argmax(axis=1) == steps % 12).all()


def test_filters_by_plain_sums():
    frames = np.random.default_rng(0).random((30, 12))
    got = chroma.packed(frames)
    unit = frames / frames.sum(axis=1, keepdims=True)
    w = chroma.WIDTH
    for i in range(len(frames) - w + 1):
        window, value = unit[i : i + w], 0
        for k, (kind, p, h) in enumerate(chroma.filters()):
            band = window[:, p : p + h]
            if kind == 0:
                one, two = band.sum() * (12 - h), (w - band.sum()) * h
            elif kind == 1:
                one, two = band[:, : h // 2].sum(), band[:, h // 2 :].sum()
            elif kind == 2:
                one, two = band[: w // 2].sum(), band[w // 2 :].sum()
            elif kind == 3:
                one = band[: w // 2, : h // 2].sum() + band[w // 2 :, h // 2 :].sum()
                two = band.sum() - one
            else:
                one = 2 * band[w // 3 : 2 * w // 3].sum()
                two = band.sum() - one / 2
            ratio = (one + 0.25) / (two + 0.25)
            value |= [0, 1, 3, 2][int(ratio > 0.8) + int(ratio > 1) + int(ratio > 1.25)] << 2 * k
        assert got[i] == value


def test_recordings_align():
    whole = tune()
    a = chroma.packed(chroma.pcm_chroma(whole, 8000, 2048, 512))
    noisy = whole[512 * 40 :] * 0.5 + np.random.default_rng(1).normal(0, 60, len(whole) - 512 * 40)
    b = chroma.packed(chroma.pcm_chroma(noisy, 8000, 2048, 512))
    offset, equal, errors = chroma.align(a, b)
    assert offset == 40 and equal > 50 and errors < 0.1
    other = chroma.packed(chroma.pcm_chroma(tune(seed=5), 8000, 2048, 512))
    assert chroma.align(a, other)[2] > 0.25
    assert chroma.align(a[:0], b) == (0, 0, 1.0)


def test_landmarks_are_the_same_wherever_they_lie():
    x = np.random.default_rng(2).integers(0, 1 << 32, 500, dtype=np.uint32)
    y = np.concatenate((x[100:400], x[:50]))
    at, keys = chroma.landmarks(x)
    to, other = chroma.landmarks(y)
    inside = [k for p, k in zip(at, keys) if 100 + chroma.WINDOW <= p < 400 - chroma.WINDOW]
    assert inside and set(inside) <= set(other.tolist())
    assert len(chroma.landmarks(x[:2])[0]) == 0 and len(chroma.landmarks(x[:3])[0]) == 1


def test_media_columns(spark):
    whole = tune(seconds=40)
    pcm = lambda s: np.clip(s, -32768, 32767).astype("<i2").tobytes()
    rows = [(1, pcm(whole)), (5, pcm(whole[1024 * 60 :])), (7, pcm(tune(seconds=40, seed=9))), (8, None), (9, b""), (None, pcm(whole)), (1, pcm(whole))]
    media = spark.createDataFrame([(i, x, 0) for i, x in rows], "media_id long, audio binary, votes int")
    got = chroma.aligned(media, "media_id", "audio", 8000, votes=2).collect()
    assert [(r.media_id, r.match_id, r.start) for r in got] == [(5, 1, -60)] and got[0].bit_error_rate == 0


def test_texts_against_all_pairs(spark):
    random = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("ing", "ou", "est", "xyz")]
    base = [random.choice(words, 400).tolist() for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(10, " ".join(base[0][50:] + base[1][:30])), (11, " ".join(base[2][:200] + base[3][:200])), (12, None), (13, "few words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.media_id, r.match_id): r for r in chroma.aligned(frame, "doc_id", "text").collect()}
    assert set(got) == {(10, 0), (11, 2), (11, 3)}
    for (a, b), r in got.items():
        x, y = (chroma.packed(chroma.text_chroma(dict(rows)[k])) for k in (a, b))
        assert chroma.align(x, y)[0] == r.start
    assert chroma.aligned(frame.limit(0), "doc_id", "text").collect() == []


def test_short_exact_copies(spark):
    random = np.random.default_rng(4)
    texts = [" ".join("".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)) for n in (12, 13, 14, 15, 16, 20, 40, 61, 80, 100, 120) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)] + [(3000, "la " * 30), (3001, "la " * 30), (3002, "la " * 11)]
    got = chroma.aligned(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.media_id, r.match_id) for r in got) == [*((1000 + i, i) for i in range(len(texts))), (3001, 3000)]
    assert all(r.start == 0 and r.bit_error_rate == 0 for r in got)


def test_hubs_of_single_landmarks_draw_nothing_apart(spark):
    """B and C share a passage whose landmarks older recordings hold too, each another one."""
    random = np.random.default_rng(5)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    passage, older = made(150), []
    marks = lambda w: chroma.landmarks(chroma.packed(chroma.text_chroma(" ".join(w))))
    for place, key in zip(*marks(passage), strict=True):
        while key not in marks(w := made(100) + passage[max(0, place - 4) : place + 18] + made(100))[1]:
            pass
        older.append((len(older), w))
    rows = [*older, (500, made(200) + passage + made(200)), (600, made(150) + passage + made(250)), (700, made(90) + passage + made(250))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = chroma.aligned(frame, "doc_id", "text").collect()
    assert sorted((r.media_id, r.match_id, r.start) for r in got) == [(600, 500, -50), (700, 500, -110), (700, 600, -60)]
    assert all(r.votes >= 3 and 0.1 < r.bit_error_rate < 0.5 for r in got)  # of the overlap, most of which differs


def test_connected_as_all_pairs_are(spark):
    """Texts of shared passages: who shares three landmarks in a row at one offset is connected."""
    random = np.random.default_rng(6)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    passages, common_ones = [made(150) for _ in range(8)], [made(60) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [made(60), passages[int(random.integers(8))] if i % 3 else made(80), made(40), common_ones[int(random.integers(6))], made(30)]
        rows.append((i, " ".join(sum(parts, []))))
    marks = {i: chroma.landmarks(chroma.packed(chroma.text_chroma(t))) for i, t in rows}
    threes = {i: set(chroma.triples(*m)[0].tolist()) - {0} for i, m in marks.items()}
    got = chroma.aligned(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    root = {i: i for i, _ in rows}
    for r in sorted(got, key=lambda r: (r.media_id, r.match_id)):
        a, b = root[r.media_id], root[r.match_id]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    pairs = [(i, j) for i in threes for j in threes if i < j and threes[i] & threes[j]]
    assert len(pairs) > 50 and all(root[i] == root[j] for i, j in pairs)


def marks_of(text):
    """(key, place) of all landmarks, and how many are as good as all."""
    own = chroma.packed(chroma.text_chroma(text))
    at, keys = chroma.marked(own)
    few = min(len(at), chroma.VOTES)
    wide, held = chroma.landmarks(own)
    if 2 < len(wide) < len(at):
        at, keys = np.concatenate((at, wide)), np.concatenate((keys, held))
    return set(zip(keys.tolist(), at.tolist())), few


def all_pairs(texts):
    """{(larger id, smaller id): (start, votes)} by all landmarks of all members, copies left out."""
    first = {}
    for i, t in sorted(texts.items()):
        own = chroma.packed(chroma.text_chroma(t))
        if len(own):
            first.setdefault(own.tobytes(), i)
    marks = {i: marks_of(texts[i]) for i in first.values()}
    holders = {}
    for i, (m, _) in marks.items():
        for key, place in m:
            holders.setdefault(key, []).append((i, place))
    found = {}
    for h in holders.values():
        for x, p in h:
            for y, q in h:
                if x > y:
                    found.setdefault((x, y), {}).setdefault(p - q, set()).add(p)
    best = {k: min((-len(v), o) for o, v in v.items()) for k, v in found.items()}
    return {k: (o, -n) for k, (n, o) in best.items() if -n >= min(marks[k[0]][1], marks[k[1]][1])}


def test_all_pairs_of_shared_passages_long_texts_and_ties(spark):
    random = np.random.default_rng(8)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    passages = [made(200) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [made(30), passages[i % 12], made(20), passages[int(random.integers(12))] if i % 4 else made(50), made(30)]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(100, " ".join(made(6000) + passages[0] + made(6000))), (101, rows[3][1]), (102, rows[3][1]), (102, rows[3][1])]
    rows += [(103, " ".join(passages[5] * 2)), (104, " ".join(passages[5]))]  # two offsets with as many votes
    got = chroma.aligned(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    copies = {(101, 3), (102, 3)}
    assert {(r.media_id, r.class_id, r.match_id) for r in got if r.class_id != r.media_id} == {(m, c, c) for m, c in copies}
    assert len(got) == len({(r.media_id, r.match_id) for r in got})
    want = all_pairs(dict(rows))
    assert {(r.media_id, r.match_id): (r.start, r.votes) for r in got if r.class_id == r.media_id} == want and len(want) > 150
    texts = {i: chroma.packed(chroma.text_chroma(t)) for i, t in rows}
    for r in got:
        assert abs(r.bit_error_rate - chroma.overlap_errors(texts[r.media_id], texts[r.match_id], r.start)) < 1e-12


def test_landmarks_in_many_places_go_by_hubs(spark):
    """A passage of forty recordings: rows in proportion to them, all connected."""
    random = np.random.default_rng(9)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    passage = made(200)
    rows = [(i, " ".join(made(40 + i) + passage + made(30))) for i in range(40)]
    got = chroma.aligned(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    root = {i: i for i, _ in rows}
    for r in got:
        a, b = root[r.media_id], root[r.match_id]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert set(root.values()) == {0} and len(got) <= 4 * len(rows)


def test_landmarks_in_many_places_whose_hubs_differ(spark):
    """Two recordings share landmarks that many others hold singly, each another one and no three in a row, and are linked."""
    random = np.random.default_rng(10)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    marks = lambda w: chroma.landmarks(chroma.packed(chroma.text_chroma(" ".join(w))))
    whole = lambda w: chroma.packed(chroma.text_chroma(" ".join(w)))
    passage = made(170)
    one = made(100) + passage + made(100)
    held = set(marks(passage)[1].tolist())
    while True:  # one word of the passage is another, so that landmarks in between are lost
        other = made(90) + passage[:80] + made(1) + passage[81:] + made(100)
        x, y = marks(one), marks(other)
        order = np.argsort(y[1])
        best = chroma.counted(x, (y[0][order], y[1][order]))
        common = sorted(set(x[1].tolist()) & set(y[1].tolist()))
        if best[1] == len(common) == 4 and not set(chroma.triples(*x)[0].tolist()) - {0} & set(chroma.triples(*y)[0].tolist()) - {0} and set(common) <= held:
            break
    assert chroma.overlap_errors(whole(one), whole(other), best[0], best[2], best[3] + 2) <= chroma.MOST_ERRORS
    older, where = [], dict(zip(marks(passage)[1].tolist(), marks(passage)[0].tolist(), strict=True))
    for key in common:
        for _ in range(chroma.FEW + 2):
            while key not in marks(w := made(60) + passage[max(0, where[key] - 2) : where[key] + 15] + made(60))[1]:
                pass
            older.append(w)
    rows = [*enumerate(older), (500, one), (600, other)]
    got = chroma.aligned(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r.media_id, r.match_id, -r.start, r.votes) for r in got] == [(600, 500, best[0], 4)]


def test_near_copies_that_hubs_leave_apart_are_not_all_pairs(spark):
    """Copies of a recording with other words here and there: rows in proportion to them, connected as all pairs are."""
    random = np.random.default_rng(11)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    base, rows = made(150), []
    for i in range(150):
        words = list(base)
        for k in random.choice(150, 2, replace=False):
            words[k] = made(1)[0]
        rows.append((i, " ".join(words)))
    got = chroma.aligned(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    prints = {i: chroma.packed(chroma.text_chroma(t)) for i, t in rows}
    marks = {i: [np.concatenate(x) for x in zip(*chroma.mark_sets(p)[0], strict=True)] for i, p in prints.items()}
    order = {i: np.argsort(m[1], kind="stable") for i, m in marks.items()}

    def stands(i, j):
        found = chroma.counted(tuple(marks[i]), (marks[j][0][order[j]], marks[j][1][order[j]]))
        return found is not None and found[1] >= 3 and chroma.overlap_errors(prints[i], prints[j], found[0], found[2], found[3] + 2) <= chroma.MOST_ERRORS

    def roots(pairs):
        root = {i: i for i, _ in rows}
        for i, j in pairs:
            a, b = root[i], root[j]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        return root

    pairs = [(i, j) for i in prints for j in prints if i > j and stands(i, j)]
    assert roots(pairs) == roots([(r.media_id, r.match_id) for r in got]) and len(pairs) > 1000
    assert len(got) < 2 * len(rows)


def test_a_recording_that_repeats_itself_meets_others_once(spark):
    """Rows of pairs of landmarks: one a recording and pair, however often it holds the pair."""
    rows = spark.createDataFrame([(2, 1, None, 5, 3, 3), (2, 1, 7, None, 3, 3), (4, 3, 7, None, 3, 3), (6, 5, 9, 4, 3, 3), (6, 5, 9, 4, 3, 3), (8, 7, 1, 1, 3, 3), (8, 7, 2, 2, 3, 3), (8, 7, 5, 5, 3, 3)], "a long, b long, at int, to int, few_a int, few_b int")
    assert sorted(map(tuple, chroma._shared(rows).collect())) == [(2, 1), (8, 7)]


def standing(texts):
    """{(larger id, smaller id): (start, votes, bit errors)} of all pairs, each compared by itself; copies left out."""
    first = {}
    for i, t in sorted(texts.items()):
        own = chroma.packed(chroma.text_chroma(t))
        if len(own):
            first.setdefault(own.tobytes(), (i, own))
    prints, marks, few = dict(first.values()), {}, {}
    for i, p in prints.items():
        sets, few[i] = chroma.mark_sets(p)
        at, keys = (np.concatenate(x) for x in zip(*sets, strict=True))
        order = np.argsort(keys, kind="stable")
        marks[i] = at[order], keys[order]
    out = {}
    for i in prints:
        for j in prints:
            found = chroma.counted(marks[i], marks[j]) if i > j else None
            if found and found[1] >= min(few[i], few[j]) and chroma.overlap_errors(prints[i], prints[j], found[0], found[2], found[3] + 2) <= chroma.MOST_ERRORS:
                out[i, j] = found[0], found[1], chroma.overlap_errors(prints[i], prints[j], found[0])
    return out


def crowds():
    """Near copies, a passage of many recordings, a line that is also a recording, copies, differing rows of an id."""
    random = np.random.default_rng(12)
    made = lambda n: ["".join(random.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
    base, passage, line, rows = made(150), made(200), made(14), []
    for i in range(60):
        words = list(base)
        for k in random.choice(150, 2, replace=False):
            words[k] = made(1)[0]
        rows.append((i, words))
    rows += [(100 + i, made(20 + i) + passage + (line if i % 2 else made(14)) + made(30)) for i in range(40)]
    rows += [(200 + i, made(40) + line + made(60)) for i in range(25)] + [(300, line), (301, line[:13]), (302, passage + base), (303, line * 8)]
    rows = [(i, " ".join(w)) for i, w in rows]
    return [*rows, (400, rows[3][1]), (401, None), (402, "few words"), (300, " ".join(line + made(200))), (7, None), (8, rows[8][1]), (None, rows[8][1])]


def test_every_pair_of_crowds_is_matched(spark, monkeypatch):
    rows = crowds()
    want = standing({i: t for i, t in reversed(rows) if t and i is not None})
    assert len(want) > 1500
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (256, 10):
        monkeypatch.setattr(chroma, "CHUNK", chunk)
        got = chroma.matched(frame, "doc_id", "text").collect()
        assert len(got) == len({r.media_id for r in got}) <= len(rows)
        assert [(r.media_id, [m.match_id for m in r.matches]) for r in got if r.media_id != r.class_id] == [(400, [3])]
        found = {(r.media_id, m.match_id): (m.start, m.votes, m.bit_error_rate) for r in got for m in r.matches if r.media_id == r.class_id}
        assert found == want and sum(len(r.matches) for r in got) == len(want) + 1
        links = {r.media_id: r.n_links for r in got if r.media_id == r.class_id}
        assert links == {i: sum(i in pair for pair in want) for i in {i for pair in want for i in pair}}
    assert chroma.matched(frame.limit(0), "doc_id", "text").collect() == []


def test_rooms_work_in_parts(monkeypatch):
    texts = [t for _, t in crowds()[:100]]
    prints = [chroma.packed(chroma.text_chroma(t)) for t in texts]
    x, y = np.nonzero(np.tri(100, k=-1))
    whole = sorted(zip(*(c.tolist() for c in chroma.compared(prints, x, y)), strict=True))
    monkeypatch.setattr(chroma, "MOST", 500)
    assert whole == sorted(zip(*(c.tolist() for c in chroma.compared(prints, x, y)), strict=True))
    assert {(i, j): (o, v, e) for i, j, o, v, e in whole} == standing(dict(enumerate(texts)))
