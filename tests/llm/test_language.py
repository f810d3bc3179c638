import math

import numpy as np
from pyspark.sql import functions as F

from signalloom.llm import langid, queries


def test_counts_of_whole_texts_in_pieces(monkeypatch):
    texts = ["the cat sat", None, "", "é ü" * 50, "word " * 400]
    whole = langid.trigram_counts(texts, 512)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.array_equal(whole, langid.trigram_counts(texts, 512))
    assert whole[0].sum() == len(" the cat sat ") - 2
    assert whole[1].sum() == whole[2].sum() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language(spark, d).join(docs, "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def plain_vector(text, model):
    """A text's vector by a loop over its letters, in Python's own numbers."""
    shown = " " + "".join(chr(b) if b >= 128 or 97 <= b <= 122 else " " for b in (text or "").lower().encode()) + " "
    counts, mask = {}, (1 << 32) - 1
    for a, b, c in zip(*(map(ord, shown[k:]) for k in range(3)), strict=False):
        if [a, b, c].count(32) < 2:
            code = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask) ^ (c * 0xC2B2AE3D & mask)
            code = ((code ^ (code >> 15)) * 0x2C1B3C6D & mask) >> 12
            counts[code % len(model.idf)] = counts.get(code % len(model.idf), 0) + 1
    return {k: math.log(1 + n) * float(model.idf[k]) for k, n in counts.items()}


def test_every_document_against_a_plain_nearest_centroid(spark):
    """Languages, scores and rejections of the whole table, and those of odd and very long texts, without arrays."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.fit(docs)
    odd = [(10**6 + k, t) for k, t in enumerate([None, "", "1 2 3", "é", "A", "ab", "\x00", "漢字", "der die das " * 60_000, "x" * 300_000])]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("clash"))
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in langid.identify(frame, model).collect():
        vector = plain_vector(texts[r.doc_id], model)
        length = math.sqrt(sum(v * v for v in vector.values())) or 1.0
        cosines = [sum(v * float(row[k]) for k, v in vector.items()) / length for row in model.matrix]
        best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        same = {model.languages[k] for k, c in enumerate(cosines) if c > cosines[best] - 1e-5}
        assert r.lang_pred in same and abs(r.score - min(1, max(0, cosines[best]))) < 1e-5
        far = model.farthest[r.lang_pred]
        assert r.rejected == (1 - cosines[best] > far) or abs(1 - cosines[best] - far) < 1e-5


def test_several_centroids_and_edge_cases(spark):
    rows = [(i, text, lang, "extra") for i, (text, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr")] * 40)]
    rows += [(1000, None, "en", "x"), (1001, "", "fr", "x"), (1002, "123 !? ²_", None, "x"), (1003, "THE MAT", None, "x"), (1003, "THE MAT", None, "x"), (1004, "漢字", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    assert set(model.languages) == {"en", "fr"}
    got = {}
    for r in langid.identify(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[k][0].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0
    assert [r.lang_pred for r in got[1003]] == ["en", "en"]
    assert got[1004][0].lang_pred in ("en", "fr") and got[1004][0].rejected
    random = np.random.default_rng(0)
    points = langid.unit(np.concatenate([random.normal(c, 0.05, (30, 8)) for c in np.eye(8)[:3]]))
    assert len(langid.centroids(points, 3, 0.05)) == 3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def test_sample_is_bounded_for_null_and_repeated_ids(spark):
    rows = [(None, f"the cat {i} sat", "en") for i in range(20000)] + [(7, "le chat", "fr")] * 20000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    real = langid.unit
    langid.unit = lambda x: seen.append(len(x)) or real(x)
    try:
        model = langid.fit(docs)
    finally:
        langid.unit = real
    assert set(model.languages) <= {"en", "fr"} and max(seen) < 6000
