import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from signalloom.llm import queries, toxicity


def test_words_and_grams():
    assert toxicity.words("You, IDIOT! it's Ünder you") == {"you", "idiot", "it's", "ünder"} and toxicity.words(None) == set()
    s, e = toxicity.START, toxicity.END
    assert sorted(toxicity.grams("ab", 3)) == sorted([s, s + "a", s + "ab", "a", "ab", "ab" + e, "b", "b" + e, e])


def plain(texts, order, cutoff):
    """word -> log-ratios of its symbols, straight from the definition."""
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        for w in set(text.split()):
            whole = toxicity.START + w + toxicity.END
            counts[toxic].update(whole[i : i + n] for n in range(1, order + 1) for i in range(len(whole) - n + 1))
    kept = {g for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= cutoff}
    kinds = len({g for g in kept if len(g) == 1})
    before = lambda g: sum(x + g in kept for x in {k[0] for k in kept})
    low = {g: before(g) for g in kept if g[0] != toxicity.START and len(g) < order}
    ones = lambda values: toxicity.discount(sum(v == 1 for v in values), sum(v == 2 for v in values))
    less = {n: ones([v for g, v in low.items() if len(g) == n]) for n in range(1, order)}
    full = lambda g: len(g) == order or (g[0] == toxicity.START and len(g) > 1)
    own = [ones([v for g, v in c.items() if full(g)]) for c in counts]

    def shared(g):
        if not g:
            return 1 / kinds
        following = [v for k, v in low.items() if len(k) == len(g) and k[:-1] == g[:-1]]
        if not sum(following):
            return shared(g[1:])
        return (max(low.get(g, 0) - less[len(g)], 0) + less[len(g)] * sum(v > 0 for v in following) * shared(g[1:])) / sum(following)

    def p(k, g):
        following = {x: v for x, v in counts[k].items() if len(x) == len(g) and x[:-1] == g[:-1] and full(x)}
        n = sum(following.values())
        if not n:
            return shared(g[1:])
        rest = n - sum(max(v - own[k], 0) for x, v in following.items() if x in kept)
        return ((max(following.get(g, 0) - own[k], 0) if g in kept else 0) + rest * shared(g[1:])) / n

    def steps(w):
        whole = toxicity.START + w + toxicity.END
        at = [whole[max(0, k - order + 1) : k + 1] for k in range(1, len(whole))]
        return [math.log(p(1, g) / p(0, g)) for g in at]

    return steps, p


def model_of(texts, order, cutoff):
    held = Counter(), Counter()
    for text, toxic in texts:
        for w in set(text.split()):
            held[toxic].update(toxicity.grams(w, order))
    full = lambda g: len(g) == order or (g[0] == toxicity.START and len(g) > 1)
    d = [toxicity.discount(sum(v == 1 and full(g) for g, v in c.items()), sum(v == 2 and full(g) for g, v in c.items())) for c in held]
    names = sorted(g for g in held[0] | held[1] if held[0][g] + held[1][g] >= cutoff)
    got = toxicity.ratios(names, np.array([held[1][g] for g in names]), np.array([held[0][g] for g in names]), (d[1], d[0]), order)
    return toxicity.Model(*got, order=order)


def test_ratios_by_the_definition():
    random = np.random.default_rng(0)
    made = lambda: "".join(random.choice(list("abcde"), int(random.integers(1, 7))))
    stock = [made() for _ in range(60)]
    texts = [(" ".join(random.choice(stock, 12).tolist() + ["bad"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(60)]
    for order, cutoff in ((3, 1), (4, 3), (6, 2)):
        steps, p = plain(texts, order, cutoff)
        known = toxicity._Ratios(model_of(texts, order, cutoff))
        for w in ["bad", "badly", "abad", "zzz", "a", *stock[:25]]:
            assert np.allclose(known.steps(w), steps(w), atol=1e-9, rtol=0)
        for k in (0, 1):  # probabilities of all symbols after a context sum to one
            assert abs(sum(p(k, toxicity.START + "b" + x) for x in [*"abcde", toxicity.START, toxicity.END]) - 1) < 1e-9


def test_every_letter_of_long_words_is_scored():
    texts = [(f"{a}nasty", 1) for a in ("collective", "wonderful", "beautiful", "plentiful")] + [(f"{a}goody", 0) for a in ("collective", "wonderful", "beautiful", "plentiful")]
    known = toxicity._Ratios(model_of(texts * 6, 8, 3))
    assert known["mercifulnasty"] > known["mercifulgoody"] + 0.01
    long = "x" * 200
    assert known[long + "wonderfulnasty"] > known[long + "wonderfulgoody"] + 0.01


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op10_toxicity(spark, d).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_length_alone_is_no_evidence(spark):
    """Ordinary documents joined to ever longer ones stay ordinary; a toxic one among a hundred of them is found as a rule."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = docs.join(labels, "doc_id").where("toxic is not null and text is not null").orderBy("doc_id").select("text", "toxic").limit(3000).collect()
    ordinary, toxic = ([r.text for r in rows if r.toxic == k] for k in (0, 1))
    scores = toxicity.fit(docs, labels).scorer()
    for k in (1, 10, 100, 400):
        joined = [" ".join(ordinary[s : s + k]) for s in range(0, len(ordinary) - k, max(k, 100))]
        assert max(scores(joined)) < 0.5, k
    assert len(joined[0]) > 500_000
    assert np.mean(np.array(scores([" ".join(ordinary[s : s + 30] + [toxic[s // 30]]) for s in range(0, 1500, 30)])) >= 0.5) > 0.5


def test_chance_goes_on_beyond_the_last_expressions():
    bins = np.bincount(toxicity.bin_of(np.random.default_rng(0).exponential(0.05, 400_000)), minlength=toxicity.BINS[2])
    chance = toxicity.Chance(bins)
    for x in (0.05, 0.2, 0.4, 0.9, 2.0):
        assert abs(chance.log_share(x) + x / 0.05) < 0.3 + 0.08 * x / 0.05
    assert chance.evidence([0.3, 0.25, 0.2], 100_000) < 3 < chance.evidence([0.9, 0.9, 0.9], 100_000)
    empty = toxicity.Chance(np.zeros(toxicity.BINS[2], np.int64))
    assert empty.evidence([], 0) == 0 and empty.evidence([1.0], 1) >= 0


def fixture(spark):
    random = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(300):
        words = random.choice(plain, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            words[5] = words[20] = "nasty"
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "nasty nasty nasty w1 w2 w3", "x"), (1003, "w1 w2 w3", "x"), (1003, "w1 w2 w3", "x"), (None, "w1", "x")]
    labels += [(None, 1), (1, None), (4, 0), (4, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, _toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_edge_cases_and_filter(spark):
    docs, labels = fixture(spark)
    model = toxicity.fit(docs, labels)
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1002][0].predicted == 1 and [r.predicted for r in got[1003]] == [0, 0]
    assert got[1000][0].score == got[1001][0].score < 0.5 and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert sum(r.predicted for k, rows in got.items() for r in rows if k is not None and k < 300 and k % 4 == 0) >= 72
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, rows in got.items() if not rows[0].predicted}


def test_scripts_without_spaces(spark):
    docs, labels = fixture(spark)
    random = np.random.default_rng(1)
    runs = ["".join(chr(0x4E00 + int(c)) for c in random.integers(0, 40, 40)) for _ in range(201)]
    bad = "\u9f98\u9f99"
    rows = [(2000 + i, r[:20] + bad * (i % 4 == 0) + r[20:30] + "\uff0c" + r[30:], "x") for i, r in enumerate(runs[:200])]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(d, int(d % 4 == 0)) for d, _, _ in rows], labels.schema))
    model, run = toxicity.fit(docs, labels), runs[-1]
    x, y = model.scorer()([run[:30] + bad + run[30:], run])
    assert x > 0.5 > y


def test_sample_is_bounded_for_repeated_ids(spark):
    docs = spark.range(4000).selectExpr("1L as doc_id", "concat('w', id % 7, ' nasty') as text")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity._counts

    def counts(learn):
        seen.append(learn.count())
        return real(learn)

    toxicity._counts = counts
    try:
        toxicity.fit(docs, labels, sample=100)
    finally:
        toxicity._counts = real
    assert 50 < seen[0] < 200


def test_nothing_to_learn_from(spark):
    docs, labels = fixture(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, model).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(docs.limit(0), model).collect() == []
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).agg(F.sum("predicted")).first()[0] == 0
