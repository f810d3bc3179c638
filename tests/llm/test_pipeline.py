import zlib

import pytest

import corpus_pipeline
from signalloom.llm import queries, simhash, suffix

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage leaves."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_decide_and_keep_columns(spark, stages):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert all(s.columns == COLUMNS for s in stages[:-1])
    counts = [docs.count(), *[s.count() for s in stages]]
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[5] == counts[4]
    clean = simhash.link(stages[1]).collect()
    assert len({r.component_id for r in clean}) == len(clean)
    left = suffix.spans(stages[2]).where("n_removable > 0").count()
    assert left <= suffix.spans(stages[1]).where("n_removable > 0").count()


def test_run_gives_the_same_rows(spark, stages):
    run = sorted(map(tuple, corpus_pipeline.run(spark, D).collect()))
    assert run == sorted(map(tuple, stages[-1].collect())) == sorted(map(tuple, queries.pipeline(spark, D).collect()))


@pytest.mark.parametrize("k", range(5))
def test_odd_tables(spark, k):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one word", "en", None, 8), (3, "one word", "en", None, 8), (None, "no id", None, "s", 5), (4, "long " * 20000, "de", "s", 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, D)
    if k < 4:
        assert got.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in got.collect())
    every = [(False, 1), (False, 2), (False, 3), (False, 3), (False, 4), (True, None)]
    if k in (0, 2, 4):
        assert ids == every
    elif k == 1:
        assert ids == [(False, 1), (False, 3), (False, 4), (True, None)]
    else:
        assert set(ids) <= set(every) - {(False, 1), (False, 2)}
    assert stage(spark, docs.limit(0), D).collect() == []
    clashing = docs.withColumn("weight", docs.doc_id).withColumn("row", docs.text).withColumn("_order", docs.doc_id)
    kept = stage(spark, clashing, D)
    assert kept.count() == len(ids) and (k == 4 or kept.columns == clashing.columns)


def test_held_out_rule():
    assert zlib.crc32(b"15") % 5 in range(5)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
