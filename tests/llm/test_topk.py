import numpy as np
import pytest

from signalloom.llm import queries, topk


def plain(rows, k=10):
    good = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))[:k]
            out += [(q, at + 1, i, -s) for at, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("candidates", "group"), [(16384, 16384), (60, 2), (40, 16384)])
def test_against_all_products(spark, candidates, group):
    random = np.random.default_rng(0)
    rows = [(i, random.normal(size=6).tolist()) for i in range(500)]
    rows += [(i, rows[3][1]) for i in range(500, 560)]  # ties
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [0.0] * 6), (900, [0.0] * 6), (100, rows[100][1]), (1000, [1.0, 2.0]), (1001, [3.0, 4.0]), (1100, [])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.search(frame, candidates=candidates, group=group).collect()))
    assert got == plain(rows)


def test_reading_stops_early_on_clear_cases():
    random = np.random.default_rng(1)
    block = random.integers(-20, 20, (2000, 8))
    block[:15] = 500
    lists = topk.Lists.of(np.arange(2000), np.arange(2000), block)
    lists.best(np.full(8, 100), -1, 10)
    assert 0 < lists.read < block.size // 4
    lists = topk.Lists.of(np.arange(2000), np.arange(2000), block[::-1] // 4)
    ids, _ = lists.best(np.full(8, 100), -1, 10, least=200_000)
    assert lists.read <= block.size // topk.STEPS + 8 and len(ids) < 10


def test_bounds_hold_for_any_signs():
    random = np.random.default_rng(4)
    for scale in (3, 1000, 1 << 28):
        block, query = random.integers(-scale, scale, (300, 12)), random.integers(-scale, scale, 12)
        query[:3] = 0
        ids = random.integers(0, 100, 300)
        got = topk.Lists.of(np.arange(300), ids, block).best(query, 7, 5)
        want = sorted((-int(s), int(i)) for n, (s, i) in enumerate(zip(block @ query, ids)) if n != 7)[:5]
        assert [(-s, i) for i, s in zip(got[0].tolist(), got[1].tolist())] == want


def test_large_values_are_exact():
    block = np.array([[1 << 40, 1], [1 << 40, 2], [3, 4]])
    got = topk.Lists.of(np.arange(3), np.arange(3), block).best(np.array([1 << 20, 1]), 9, 2)
    assert got[0].tolist() == [1, 0] and got[1].tolist() == [(1 << 60) + 2, (1 << 60) + 1]


@pytest.mark.parametrize("candidates", [16384, 40])
def test_repeated_ids(spark, candidates):
    random = np.random.default_rng(2)
    rows = [(i % 150, random.normal(size=6).tolist()) for i in range(400)] + [(100, [9.0 + i] * 6) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(frame, candidates=candidates).collect())) == plain(rows)
    rows = [(100, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [3.0, 3.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(100, 1, 7, 3145728), (100, 2, 7, 1048576)]


def test_repeated_and_null_ids_as_sql_has_them(spark, tmp_path):
    import duckdb

    random = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else i % 130 * 10, random.normal(size=4).tolist()) for i in range(300)]
    rows += rows[:40]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, queries.op5_topk(spark, str(tmp_path)).collect())) == sorted(con.sql(queries.oracle_sql()["op5_topk"]).fetchall())


def test_empty(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_same_rows_as_sql(same_rows):
    same_rows(queries.op5_topk, queries.oracle_sql()["op5_topk"])
