import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import common, queries, suffix


def plain(rows, n):
    """Maximal spans of windows of n words that two or more rows hold."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    holders = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(k)
    out = []
    for k, w in enumerate(words):
        covered = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i : i + n])]) > 1:
                covered[i : i + n] = True
        out += [(rows[k][0], s, e, e - s) for s, e in suffix._runs(covered)]
    return sorted(out, key=str)


def corpus(random):
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: random.choice(vocabulary, n).tolist()
    shared = [text(14), text(11), text(30)]
    rows = []
    for d in range(50):
        words = text(int(random.integers(0, 40)))
        for s in shared:
            if random.random() < 0.3:
                at = int(random.integers(0, len(words) + 1))
                cut = s[int(random.integers(0, 4)) :]
                words[at:at] = cut
        rows.append((d, " ".join(words)))
    again = text(6)
    rows += [(60, " ".join(again * 10)), (61, None), (62, ""), (63, " \t"), (64, rows[3][1]), (64, rows[3][1]), (None, rows[5][1] + "  \n x"), (65, rows[7][1].upper())]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("length_anchor", [(10, 3), (10, 10), (12, 5)])
def test_spans_against_all_windows(spark, seed, length_anchor, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 700)
    rows = corpus(np.random.default_rng(seed))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start_word int, _kind string")
    got = suffix.spans(frame, length=length_anchor[0], anchor=length_anchor[1]).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.n_words) for r in got), key=str) == plain(rows, length_anchor[0])
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(t)
    assert all(any(t and len(t[r.start_char : r.end_char].split()) == r.n_words for t in texts[r.doc_id]) for r in got)


def test_one_copy_of_each_window_stays(spark, monkeypatch):
    rows = [r for r in corpus(np.random.default_rng(9)) if r[0] is not None]
    frame = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], "doc_id long, text string, n_chars long, _block string")
    n = 10
    results = []
    for size in (10_000_000, 500):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        results.append(sorted(map(tuple, suffix.drop_repeats(frame, n, 4).collect()), key=str))
    assert results[0] == results[1]  # however many blocks there are
    kept = suffix.drop_repeats(frame, n, 4)
    assert kept.columns == frame.columns
    got = kept.collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    before, after = ({w for _, t in source for w in words(t)} for source in (rows, [(r.doc_id, r.text) for r in got]))
    assert before == after
    flagged = {p[0] for p in plain(rows, n)}
    same = {r.doc_id: r.text for r in got}
    assert all(same[d] == t for d, t in rows if d not in flagged)
    assert sum(len(words(r.text)) for r in got) < sum(len(words(t)) for _, t in rows)


def test_minimisers_cover_every_window():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 300, dtype=np.uint64)
    for length, anchor in ((10, 3), (50, 8), (9, 9), (13, 1)):
        least = common.window_hashes(hashes, anchor)
        expected = [least[i : i + length - anchor + 1].min() for i in range(300 - length + 1)]
        assert np.array_equal(suffix.minimisers(hashes, length, anchor), np.array(expected))


def test_window_hashes_depend_on_words_alone():
    a = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    b = np.concatenate((a[40:], a))
    assert np.array_equal(common.window_hashes(a, 7), common.window_hashes(b, 7)[60:])


def test_empty_and_all_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.spans(empty).collect() == [] and suffix.drop_repeats(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in suffix.drop_repeats(twice, 3, 2).collect())
    assert len(got) == 3 and got[1:] == [(3, None), (4, "")] and got[0][1] == "a b c d"


def test_same_rows_as_sql(same_rows):
    same_rows(queries.op7_suffix, queries.oracle_sql()["op7_suffix"])


def test_a_block_takes_few_bytes_a_word():
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(random.choice(words, 1000)) for _ in range(400)]
    rows = pa.table({"_order": pa.array(range(400), pa.int64()), "text": texts})
    tracemalloc.start()
    suffix.Block(rows, 50, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 400_000
