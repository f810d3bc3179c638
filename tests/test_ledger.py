import pytest
from pyspark.sql import functions as F

from signalloom.sources import ledger


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    frame = spark.range(50).withColumn("v", F.col("id") * 2).unionByName(spark.createDataFrame([(None, 1), (7, 14), (7, 14)], "id long, v long"))
    folder, seen = str(tmp_path / "run"), []

    def compute(part, fail_at=None):
        seen.append(sorted(str(r.id) for r in part.collect()))
        if len(seen) == fail_at:
            raise RuntimeError("killed")
        return part.withColumn("w", F.col("v") + 1)

    with pytest.raises(RuntimeError):
        ledger.run(frame, "id", lambda p: compute(p, 3), folder, batches=6)
    assert ledger.done(spark, folder) == {0, 1} and len(seen) == 3
    # a part of a batch that the kill left behind is written again
    spark.range(1).selectExpr("id", "id as v", "id as w").write.mode("overwrite").parquet(f"{folder}/results/batch=2")
    got = ledger.run(frame.limit(0), "id", compute, folder)  # the input that the first run saw
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r.id, r.v, r.v + 1)) for r in frame.collect())
    assert len(seen) == 7 and seen[2] == seen[3] and ledger.done(spark, folder) == set()
    assert got.count() == ledger.run(frame, "id", compute, folder).count() and len(seen) == 7


def test_empty_input(spark, tmp_path):
    frame = spark.createDataFrame([], "id long, v long")
    assert ledger.run(frame, "id", lambda p: p, str(tmp_path / "run")).collect() == []
