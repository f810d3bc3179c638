import json

import pytest
from pyspark.sql import functions as F

from signalloom.sources import readers, sinks
from signalloom.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "participants.tsv").write_text("participant_id\tIST_fluid\tage\nsub-1\t3.5\tn/a\nsub-2\tn/a\t30\n")
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        (tmp_path / split / "cognition_scores.csv").write_text(f"participant_id,cognition_factor\n{split}-1,0.5\n")
    return tmp_path


def test_participants_and_columns(spark, folder):
    frame = readers.load_participants(spark, str(folder / "participants.tsv"))
    assert [tuple(r) for r in frame.collect()] == [("sub-1", 3.5, None), ("sub-2", None, 30)]
    assert readers.cognitive_columns(frame) == ["IST_fluid"]
    with pytest.raises(FileNotFoundError, match="nothing"):
        readers.load_participants(spark, str(folder / "nothing.tsv"))


def test_scores_name_the_missing_split(spark, folder):
    got = readers.load_scores(spark, str(folder))
    assert {(r.participant_id, r.split) for r in got.collect()} == {("train-1", "train"), ("test-1", "test")}
    assert readers.all_subjects(got).count() == 2
    with pytest.raises(FileNotFoundError, match="validation"):
        readers.load_scores(spark, str(folder), splits=("train", "validation"))


def test_score_round_trip(spark, folder):
    scores = spark.createDataFrame([("a", 1.0, "train"), ("b", 2.0, "test")], "participant_id string, cognition_factor double, split string")
    sinks.write_scores(scores, str(folder / "out"))
    assert {tuple(r) for r in readers.load_scores(spark, str(folder / "out")).collect()} == {("a", 1.0, "train"), ("b", 2.0, "test")}
    assert [r.value for r in spark.read.text(str(folder / "out/train/subjects.txt")).collect()] == ["a"]


def test_features_round_trip_and_pruning(spark, tmp_path):
    features = spark.createDataFrame([("a", [1.0, 2.0], "train"), ("b", [3.0], "test")], "subject string, features array<double>, split string")
    sinks.write_features(features, str(tmp_path / "f"))
    got = readers.load_features(spark, str(tmp_path / "f")).where("split = 'test'")
    assert [r.subject for r in got.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString()


def test_signals_are_turned_and_cut(spark, tmp_path):
    m = [[float(10 * i + j) for j in range(6)] for i in range(3)]
    turned = [list(c) for c in zip(*m)]
    spark.createDataFrame([("a", m), ("b", turned)], "subject string, m array<array<double>>").write.parquet(str(tmp_path / "s"))
    got = {r.subject: r.m for r in readers.load_signals(spark, str(tmp_path / "s"), 3, 4).collect()}
    assert got["a"] == got["b"] == [row[1:5] for row in m]
    with pytest.raises(Exception, match="expected 5 rows"):
        readers.load_signals(spark, str(tmp_path / "s"), 5).collect()


def test_listings(spark, tmp_path):
    for name in ("sub-1/func/sub-1_bold.nii", "sub-2/func/sub-2_bold.nii", "sub-2/anat/x.txt"):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * 10)
    root = str(tmp_path / "raw")
    assert {r.subject for r in readers.subjects_with(spark, root, "*_bold.nii").collect()} == {"sub-1", "sub-2"}
    listed = readers.files(spark, root, "*_bold.nii", "_bold.nii")
    assert [r.entity for r in readers.head_of(listed, 1).collect()] == ["sub-1"]
    assert {r.entity for r in readers.processed(spark, root, "_bold.nii").collect()} == {"sub-1", "sub-2"}
    assert sinks.storage(listed).first().n_files == 2
    for run in ("20250101_000000", "20260101_000000"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "results.csv").write_text("a\n")
    (tmp_path / "runs" / "20260101_000000" / "metadata.json").write_text("{}")
    found = readers.runs(spark, str(tmp_path / "runs"))
    assert sum(r.has_metadata for r in found.collect()) == 1 and readers.latest_run(found).first().folder.endswith("20260101_000000")


def test_confounds(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("trans_x\trot_z\tother\n1.5\tn/a\t3\n")
    assert [tuple(r) for r in readers.confounds(spark, str(tmp_path / "c.tsv")).collect()] == [(1.5, 0.0)]
    (tmp_path / "d.tsv").write_text("other\n3\n")
    assert readers.confounds(spark, str(tmp_path / "d.tsv")) is None


def test_text_sinks(spark, tmp_path):
    sinks.write_metadata(spark, {"model": "m", "counts": {"train": 2}}, str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first().value)["counts"]["train"] == 2
    frame = spark.createDataFrame([("a", 0.25)], "method string, r double")
    assert json.loads(sinks.metadata_json(frame).first().value) == {"method": "a", "r": 0.25}
    assert sinks.report(frame, "fc", "r").first().value == "fc: r=0.2500"
    sinks.write_results(frame, str(tmp_path / "res"))
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).first().method == "a"
    sinks.write_statistics(spark.createDataFrame([(0, 1.0, 2.0)], "parcel int, med double, iqr double"), str(tmp_path / "st"))
    assert dict(spark.read.parquet(str(tmp_path / "st")).dtypes)["med"] == "float"


def test_ingest_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = spark.range(20).select("id", (F.col("id") * 2).alias("v"))
    events.where("id < 10").repartition(3).write.parquet(source)
    assert ingest.ingest(spark, source, target, state, events.schema, files_per_batch=2) >= 2
    assert ingest.ingest(spark, source, target, state, events.schema) == 0
    events.where("id >= 10").coalesce(1).write.mode("append").parquet(source)
    assert ingest.ingest(spark, source, target, state, events.schema, lambda d: d.withColumn("v", F.col("v") + 1)) == 1
    got = {r.id: r.v for r in spark.read.parquet(target).collect()}
    assert got == {i: 2 * i + (i >= 10) for i in range(20)}


def test_stateful_totals_and_duplicates(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 2.0), (1, "2024-01-01 00:00:00", 2.0), (2, "2024-01-01 01:00:00", 5.0)]
    frame = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "e"))
    for name, built in (("totals", ingest.running_totals(stream(), "user_id", "1 hour")), ("unique", ingest.deduplicated(stream(), ["user_id", "ts"], "1 hour"))):
        query = built.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {(1, 2, 4.0), (2, 1, 5.0)}
    assert spark.table("unique").count() == 2


def test_metadata_issues(spark, tmp_path):
    good = {"timestamp": "t", "model": "m", "data_dir": "d", "n_train": 1, "n_test": 2, "seed": 42, "deterministic": True, "model_size": "s", "device": "cpu"}
    cases = {"good": json.dumps(good), "few": json.dumps({"model": "m", "n_train": 1}), "bad": "{", "none": None}
    for name, text in cases.items():
        (tmp_path / name).mkdir()
        if text is None:
            (tmp_path / name / "results.csv").write_text("x")
        else:
            (tmp_path / name / "metadata.json").write_text(text)
    got = {r.folder.rsplit("/", 1)[1]: (r.issues, r.advice) for r in readers.metadata_issues(spark, str(tmp_path)).collect()}
    assert got["good"] == ([], [])
    assert got["few"] == (["Missing required fields: timestamp, data_dir", "Missing subject count"], ["seed", "deterministic", "model_size", "device"])
    assert got["bad"][0] == ["Invalid JSON"] and got["none"][0] == ["metadata.json not found"]


def test_saved_comparison_and_reconstruction(spark, tmp_path):
    from signalloom.plans import flows

    results = spark.createDataFrame([("fc_input", 0.25, 10), ("cls", -0.5, 10)], "method string, pearson_r double, n_test long")
    flows.save_comparison(results, str(tmp_path / "c"), {"model": "m", "timestamp": "t", "data_dir": "d"})
    assert spark.read.option("header", True).csv(str(tmp_path / "c/results.csv")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c/metrics.csv")).count() == 4
    assert {r.value for r in spark.read.text(str(tmp_path / "c/README.txt")).collect()} == {"fc_input: pearson_r=0.2500, n_test=10.0000", "cls: pearson_r=-0.5000, n_test=10.0000"}
    pairs = spark.createDataFrame([("a", [[1.0, 2.0, 4.0], [3.0, 1.0, 0.0]], [[1.0, 2.0, 4.0], [3.0, 1.0, 0.0]])], "subject string, original array<array<double>>, rebuilt array<array<double>>")
    flows.save_reconstruction(pairs, str(tmp_path / "r"), {"model": "m"})
    assert json.loads(spark.read.text(str(tmp_path / "r/metadata.json")).first().value)["n_subjects"] == 1
    assert float(spark.read.option("header", True).csv(str(tmp_path / "r/results.csv")).first().mse) == 0
