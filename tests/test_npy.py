import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.sources import npy, readers


def test_round_trip_of_any_array(spark, tmp_path):
    random = np.random.default_rng(0)
    arrays = {"a": random.normal(size=(3, 4)), "b": np.asfortranarray(random.normal(size=(5, 2))), "c": random.integers(-9, 9, (2, 3)).astype(">i2"), "d": np.arange(4, dtype=np.float32), "e": np.zeros((0, 3)), "f é": np.array([[True, False]])}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}_ts.npy", x)
    np.savez_compressed(tmp_path / "z_ts.npz", one=arrays["a"], two=arrays["d"])
    (tmp_path / "other.txt").write_text("x")
    got = {(r.subject, r.name): r for r in npy.read(spark, str(tmp_path), "_ts").collect()}
    assert {k for k, n in got if n is None} == set(arrays) and {n for k, n in got if k == "z"} == {"one", "two"}
    for name, x in [*(((k, None), v) for k, v in arrays.items()), (("z", "one"), arrays["a"]), (("z", "two"), arrays["d"])]:
        assert got[name].shape == list(x.shape) and np.array_equal(got[name]["values"], x.astype(float).ravel())
    rows = {r.subject: r.m for r in npy.signals(spark, str(tmp_path), "_ts").collect() if r.subject != "z"}
    assert all(np.array_equal(np.array(rows[k]).reshape(np.atleast_2d(x).shape), np.atleast_2d(x).astype(float)) for k, x in arrays.items())


def test_headers_alone(spark, tmp_path):
    path = tmp_path / "s.npy"
    np.save(path, np.zeros((40, 1000)))
    os.truncate(path, 256)  # only the header is there
    assert [(r.shape, r.dtype, r["values"]) for r in npy.read(spark, str(tmp_path), values=False).collect()] == [([40, 1000], "<f8", None)]
    with pytest.raises(Exception, match="bytes of values"):
        npy.read(spark, str(tmp_path)).collect()


def test_objects_and_other_files_are_errors(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        npy.read(spark, str(tmp_path)).collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.npy").write_bytes(b"no array")
    with pytest.raises(Exception, match="x.npy"):
        npy.read(spark, str(tmp_path / "p")).collect()


def test_writes_are_committed_or_leave_nothing(spark, tmp_path):
    frame = spark.range(9).select(F.concat(F.lit("sub/"), "id").alias("subject"), F.array(F.array("id", F.lit(1)), F.array(F.lit(2), F.lit(3))).alias("m")).repartition(3)
    folder = str(tmp_path / "out")
    npy.write(frame, folder, "<f4")
    assert sorted(os.listdir(folder)) == sorted(["_SUCCESS", *[f"sub%2F{k}.npy" for k in range(9)]])
    assert np.load(f"{folder}/sub%2F4.npy").dtype == np.float32 and {r.subject for r in npy.signals(spark, folder).collect()} == {f"sub/{k}" for k in range(9)}
    bad = frame.withColumn("m", F.when(F.col("subject") == "sub/5", F.raise_error(F.lit("no")).cast("array<array<bigint>>")).otherwise(F.col("m")))
    other = str(tmp_path / "bad")
    for wrong, why in ((bad, "no"), (frame.unionByName(frame.limit(1)), "several rows")):
        with pytest.raises(Exception, match=why):
            npy.write(wrong, other)
        assert not os.path.exists(other) or os.listdir(other) == []


def test_wrong_row_count_raises(spark, tmp_path):
    for k, shape in enumerate([(4, 6), (6, 4), (5, 5)]):
        np.save(tmp_path / f"{k}.npy", np.arange(shape[0] * shape[1]).reshape(shape))
    frame = npy.signals(spark, str(tmp_path))
    got = {r.subject: r.m for r in readers.oriented_signals(frame.where("subject <> '2'"), 4, 5).collect()}
    assert np.array(got["0"]).shape == np.array(got["1"]).shape == (4, 5)
    with pytest.raises(Exception, match="expected 4 rows"):
        readers.oriented_signals(frame, 4).collect()


@pytest.mark.parametrize("values", [True, False])
def test_many_small_files_share_partitions(spark, tmp_path, values):
    for k in range(300):
        np.save(tmp_path / f"{k}.npy", np.full((2, 3), float(k)))
    frame = npy.read(spark, str(tmp_path), values=values)
    got = {r.subject: r for r in frame.collect()}
    assert set(got) == {str(k) for k in range(300)} and all(r.shape == [2, 3] for r in got.values())
    assert all(r["values"] == ([float(k)] * 6 if values else None) for k, r in got.items())
    assert frame.rdd.getNumPartitions() <= npy.PARTS


def test_partitions_are_bounded_in_files_and_bytes():
    dealt = npy._dealt([(f"p{k}", f"{k}", 1000) for k in range(npy.FILES * npy.PARTS * 2)])
    assert len(dealt) == npy.PARTS * 2 and {len(p.files) for p in dealt} == {npy.FILES}
    big = npy._dealt([("a", "a", npy.BYTES), ("b", "b", 2 * npy.BYTES), ("c", "c", 1)])
    assert [p.files for p in big] == [[("a", "a")], [("b", "b")], [("c", "c")]] and npy._dealt([]) == []
