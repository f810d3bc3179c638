import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import mixing, queries


def table(spark):
    random = np.random.default_rng(0)
    rows = [(i, "word " * int(random.integers(1, 60)) + ("| x | y" if i % 3 else ""), ["en", "de", None][int(random.choice(3, p=[0.7, 0.2, 0.1]))], f"s{int(random.choice(4, p=[0.6, 0.2, 0.1, 0.1]))}", i) for i in range(600)]
    rows += [(900, None, "en", "s0", 0), (901, "", "de", None, 0), (902, "token text", None, None, 0), (902, "token text", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")


def test_marginals_meet_their_targets(spark):
    docs = mixing.with_cells(table(spark))
    cells = docs.groupBy(*mixing.MARGINALS).agg(F.sum("tokens").alias("tokens"))
    target = spark.createDataFrame([("en", 1.0), ("de", 3.0), ("(none)", 1.0), ("absent", 5.0)], "value string, share double")
    raked = mixing.rake(cells, {"lang": target}, sweeps=30).cache()
    got = {r.lang: r.w for r in raked.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert got == {"en": pytest.approx(0.2, abs=1e-6), "de": pytest.approx(0.6, abs=1e-6), "(none)": pytest.approx(0.2, abs=1e-6)}
    for name in ("source", "topic"):
        own = {r[0]: r[1] for r in cells.where("tokens > 0").groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(mixing.ALPHA))).collect()}
        got = {r[0]: r[1] for r in raked.groupBy(name).agg(F.sum("weight")).collect()}
        assert got == {k: pytest.approx(v / sum(own.values()), rel=1e-5) for k, v in own.items()}


def test_same_as_plain_fitting(spark):
    docs = table(spark)
    cells = mixing.with_cells(docs).groupBy(*mixing.MARGINALS).agg(F.sum("tokens").alias("tokens"))
    rows = [tuple(r) for r in cells.where("tokens > 0").collect()]
    weight = {r[:3]: float(r[3]) for r in rows}
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            tokens = {}
            have = {}
            for r in rows:
                tokens[r[d]] = tokens.get(r[d], 0) + r[3]
                have[r[d]] = have.get(r[d], 0) + weight[r[:3]]
            powers = {k: v**mixing.ALPHA for k, v in tokens.items()}
            weight = {k: w * powers[k[d]] / sum(powers.values()) / have[k[d]] for k, w in weight.items()}
    got = {tuple(r)[:3]: r.weight for r in mixing.rake(cells).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in weight.items()}


def test_sampling(spark):
    docs = table(spark)
    taken = mixing.mix(docs).cache()
    assert {r.row.doc_id for r in taken.collect()} <= set(range(600)) | {902}
    assert taken.where("row.doc_id in (900, 901)").count() == 0
    rates = taken.select("rate", "copies").collect()
    assert all(np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1 for r in rates)
    once = mixing.mix(docs, keep=5.0, repeats=False)
    assert {r.copies for r in once.select("copies").distinct().collect()} == {1}
    plan = taken._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("repeats", [True, False])
@pytest.mark.parametrize("cells", [mixing.CELLS, 1])
def test_null_and_repeated_ids_meet_the_budget(spark, repeats, cells, monkeypatch):
    """Half the ids null, a quarter of all rows equal in id and text, one id of many texts: all are taken at their rate."""
    monkeypatch.setattr(mixing, "CELLS", cells)
    rows = [(None if i % 2 else i, f"word {i}" if i % 4 else "the same words") for i in range(4000)]
    rows += [(7, f"text {i:04d}") for i in range(2000)] + [(8, "twice that is")] * 1500 + [(None, "none that is.")] * 1500
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, keep=0.5, repeats=repeats).select("row.*").collect()
    groups = {"null": lambda d, t: d is None and t[:4] == "word", "own": lambda d, t: d is not None and t[:4] == "word", "one id": lambda d, t: d == 7, "equal": lambda d, t: d == 8, "equal without id": lambda d, t: t[:4] == "none"}
    for name, inside in groups.items():
        n, taken = sum(inside(*r) for r in rows), sum(inside(r.doc_id, r.text) for r in got)
        assert abs(taken - n / 2) < 4 * (n / 4) ** 0.5, (name, n, taken)


def test_limits_without_repeats(spark):
    """Targets that ask for more than there is are cut, the rest redistributed; the budget is met."""
    docs = table(spark)
    cells = mixing.with_cells(docs).groupBy(*mixing.MARGINALS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").cache()
    total = cells.agg(F.sum("tokens")).first()[0]
    for keep in (0.5, 0.9):
        raked = mixing.rake(cells, limit=keep).collect()
        assert abs(sum(r.weight for r in raked) - 1) < 1e-6
        assert all(r.weight <= r.tokens / total / keep * (1 + 1e-9) for r in raked)
        for d, name in enumerate(mixing.MARGINALS):
            tokens, weight = {}, {}
            for r in raked:
                tokens[r[d]] = tokens.get(r[d], 0) + r.tokens
                weight[r[d]] = weight.get(r[d], 0) + r.weight
            goal, most = {k: v**mixing.ALPHA for k, v in tokens.items()}, {k: v / total / keep for k, v in tokens.items()}
            goal = {k: v / sum(goal.values()) for k, v in goal.items()}
            for _ in range(8):
                full = sum(most[k] for k in goal if goal[k] >= most[k])
                free = sum(v for k, v in goal.items() if v < most[k])
                goal = {k: most[k] if v >= most[k] else min(most[k], v * (1 - full) / free) for k, v in goal.items()}
            assert all(abs(weight[k] - goal[k]) < 0.02 for k in goal), (keep, name, weight, goal)
    taken = mixing.mix(docs, keep=0.9, repeats=False)
    assert abs(taken.agg(F.sum("tokens")).first()[0] / total - 0.9) < 0.05


def test_given_topics_and_tokens(spark):
    docs = table(spark).withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).withColumn("size", F.lit(10))
    got = mixing.mix(docs, topic="kind", tokens="size").select("topic", "tokens", "residual").distinct().collect()
    assert {(r.topic, r.tokens) for r in got} == {("a", 10), ("b", 10)} and all(r.residual <= mixing.TOLERANCE for r in got)


def test_empty(spark):
    assert mixing.mix(table(spark).limit(0)).collect() == []


def test_same_rows_as_sql(same_rows):
    same_rows(queries.op6_mixing, queries.oracle_sql()["op6_mixing"], "sf0.01")
