import math
from collections import Counter

import pytest

from signalloom.llm import common, lm, queries


def plain(rows, order, alpha=lm.ALPHA, least=lm.MIN_COUNT):
    docs = [(d, (t or "").lower().split()) for d, t in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)

    def value(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= least else alpha * value(gram[1:])

    return sorted(((d, len(w), sum(math.log(value(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))) for d, w in docs), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_counting(spark, order, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 200)
    rows = [(i, " ".join("abcdefg"[(i * k) % 7] for k in range(1, 3 + i % 9))) for i in range(40)] + [(100, None), (101, ""), (102, " "), (3, "a b c"), (3, "a b c"), (None, "a b"), (103, "A B " * 300)]
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, _facts string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm.score(frame, order=order).collect()), key=str)
    want = plain(rows, order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a[2] - b[2]) < 1e-9 * max(1, abs(b[2])) for a, b in zip(got, want))


def test_null_score_without_words(spark):
    frame = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(frame).collect()}
    assert got[1].score is None and got[1].log_score == 0 and got[2].score == pytest.approx(0.0)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing():
    import numpy as np

    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert np.array_equal(common.unpack(common.pack(keys)), keys) and len(common.unpack(common.pack(keys[:0]))) == 0


def test_same_rows_as_sql(same_rows):
    same_rows(queries.op3_backoff, queries.oracle_sql()["op3_backoff"])


def test_null_and_repeated_ids_fill_several_blocks(spark, monkeypatch):
    from signalloom.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 4000)
    nulls = spark.range(2000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text")
    same = spark.range(2000).selectExpr("1L as doc_id", "'the same text' as text")
    for docs in (nulls, same):
        dealt, blocks = common.in_blocks(docs)
        got = dealt.groupBy("_block").count().collect()
        assert blocks > 3 and len(got) > 3 and max(r["count"] for r in got) < 1000
