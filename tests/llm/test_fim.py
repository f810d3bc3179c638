import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalloom.llm import fim, queries

TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab \t\n\x0b\x1f\x85  <>PSM"), st.characters(exclude_categories=["Cs"])), max_size=40)


def plain(doc_id, text):
    """The definition, in plain Python."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(spark, rows):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, form string, n int")
    made = fim.arranged(frame).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted((plain(d, t) for d, t in rows), key=key)
    assert all(r.back == (r.row.text or "") for r in made)
    return made


@given(st.lists(st.tuples(st.integers(-(1 << 62), 1 << 62), TEXTS), min_size=20, max_size=60))
@settings(max_examples=8, deadline=None)
def test_any_text(spark, rows):
    check(spark, rows)


def test_edge_cases(spark):
    texts = [None, "", " ", " \n", "a", " a", "a ", "<P>", "x <S> y", "a<", "<S a <P", "M> b", "\x1c a\x1db", "é\x00 b", "😀 😀😀  ", "a " * 60_000, "x" * 200_000]
    rows = [(d, t) for d in (1, 2, 3, 4, 5, 6, 7, 8, None) for t in texts]
    made = check(spark, [*rows, *rows[:5]])  # repeated rows too
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.arranged(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_sentinels_and_rates(spark):
    frame = spark.createDataFrame([(d, f"a{d} (b) c.d\n e f", "y") for d in range(200)], "id long, body string, row string")
    made = fim.arranged(frame, "id", "body", rate=100, spm=0, sentinels=("[p.", "[s*", "[m]")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[p.", "[s*", "[m]"))).collect()
    assert {r.form for r in made} == {"psm"} and all(r.back == r.row.body and r.output.startswith("[p.") for r in made)
    for bad in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.arranged(frame, "id", "body", sentinels=bad)


def test_native(spark):
    plan = queries.op13_fim(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(same_rows, sf):
    same_rows(queries.op13_fim, queries.oracle_sql()["op13_fim"], sf)
