import hashlib
import re

import numpy as np
import pytest

from signalloom.llm import common, queries, rlz


def plain(rows, n):
    """The definition, window by window."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - n + 1):
            if d is not None:
                first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(random):
    vocabulary = [f"w{i}" for i in range(50)]
    text = lambda n: random.choice(vocabulary, n).tolist()
    shared = [text(16), text(9), text(40)]
    rows = []
    for d in random.permutation(60).tolist():
        words = text(int(random.integers(0, 40)))
        for s in shared:
            if random.random() < 0.3:
                at = int(random.integers(0, len(words) + 1))
                words[at:at] = s[int(random.integers(0, 4)) : len(s) - int(random.integers(0, 4))]
        rows.append((d, " ".join(words)))
    # a window over two factors: each half, and the seam, from documents of their own
    a, b = text(14), text(14)
    rows += [(-3, " ".join(a)), (-2, " ".join(b)), (-1, " ".join(a[8:] + b[:6])), (100, " ".join(a + b))]
    again = text(5)
    return [*rows, (101, " ".join(again * 10)), (102, None), (103, ""), (104, " \t"), (105, rows[3][1]), (105, rows[3][1]), (None, rows[5][1]), (106, rows[5][1] + "  \n x"), (107, rows[7][1].upper()), (None, " ".join(text(30)) + " é😀"), (-9, "x " * 4000), (108, "x " * 3000 + "y")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("length_anchor", [(10, 4), (8, 8), (12, 5)])
def test_against_all_windows(spark, seed, length_anchor, monkeypatch):
    rows = corpus(np.random.default_rng(seed))
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n_words int, _kind string, _order int")
    monkeypatch.setattr(common, "BLOCK_BYTES", 1500)
    got = rlz.parse(frame, length=length_anchor[0], anchor=length_anchor[1], keep=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, length_anchor[0])


def test_factors_are_passages_of_earlier_documents(spark, monkeypatch):
    rows = [r for r in corpus(np.random.default_rng(5)) if r[0] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {d: (t or "").split() for d, t in rows}
    results = []
    for size in (8 << 20, 900):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        got = rlz.parse(frame, length=10, anchor=4, keep=True).collect()
        results.append(sorted(map(str, got)))
        for r in got:
            covered = set()
            for f in r.factors:
                assert f.n_words >= 10 and f.from_doc < r.doc_id
                assert texts[r.doc_id][f.start_word : f.start_word + f.n_words] == texts[f.from_doc][f.from_word : f.from_word + f.n_words]
                covered |= set(range(f.start_word, f.start_word + f.n_words))
            assert len(covered) == r.n_removed
    assert results[0] == results[1]  # however many blocks there are
    assert any(len(r.factors) > 1 for r in got)


def test_one_factor_while_the_reference_goes_on():
    place = np.array([(1, 5), (1, 6), (1, 7), (1, 9), (2, 10), (2, 11)], rlz.PLACE)
    begins, sizes = rlz.factors(np.array([0, 0, 0, 0, 0, 1]), np.array([3, 4, 5, 6, 7, 0]), place)
    assert begins.tolist() == [0, 3, 4, 5] and sizes.tolist() == [3, 1, 1, 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rlz.parse(empty).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    nothing = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, rlz.parse(nothing).collect()))) == sorted(map(str, [(1, 0, 0, none), (None, 0, 0, none), (2, 0, 0, none)]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(same_rows, sf):
    same_rows(queries.op11_rlz, queries.oracle_sql()["op11_rlz"], sf)
