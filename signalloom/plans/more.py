"""Registered queries of readers and sinks (round trips through files), whole flows, and the smaller array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, stats
from ..functions.stats import rounded as r6
from ..operators import connectivity, encoders, factor, kernel, metrics, relational, signals
from ..sources import ledger, npy, readers, sinks
from ..sources.shared import new_folder
from ..streaming import ingest
from . import flows, queries, views
from .queries import query

SCORES = "participant_id long, acctbal double, n_orders double, avg_price double, sum_price double"


# ---- readers and sinks ----------------------------------------------------------------------------------------------


@query("select participant_id, round(acctbal, 6) + 0.0 as acctbal, n_orders, round(avg_price, 6) + 0.0 as avg_price from participants", "participants")
def source_participants(spark, sf_dir):
    path = new_folder(spark, "participants")
    views.participants(spark, sf_dir).write.option("sep", "\t").option("header", True).option("nullValue", "n/a").csv(path)
    got = readers.load_participants(spark, path, SCORES)
    return got.select("participant_id", r6("acctbal").alias("acctbal"), "n_orders", r6("avg_price").alias("avg_price"))


def _saved_scores(spark, sf_dir) -> str:
    folder = new_folder(spark, "scores")
    sinks.write_scores(queries._split(spark, sf_dir), folder)
    return folder


_SPLIT = ", t as (select *, case when participant_id % 5 = 0 then 'test' else 'train' end as split from participants)"


@query(_SPLIT + "\nselect participant_id, split, round(acctbal, 6) + 0.0 as score from t", "participants")
def split_union(spark, sf_dir):
    """Scores written for each split and loaded again as one table."""
    return readers.load_scores(spark, _saved_scores(spark, sf_dir), SCORES).select("participant_id", "split", r6("acctbal").alias("score"))


@query("select c_custkey as participant_id from customer")
def all_subject_ids(spark, sf_dir):
    return readers.all_subjects(readers.load_scores(spark, _saved_scores(spark, sf_dir), SCORES))


@query("select c_custkey::varchar as value from customer where c_custkey % 5 = 0")
def subject_list_file(spark, sf_dir):
    return spark.read.text(f"{_saved_scores(spark, sf_dir)}/test/subjects.txt")


def _saved_features(spark, sf_dir) -> str:
    path = new_folder(spark, "features")
    sinks.write_features(views.features(spark, sf_dir), path)
    return path


@query("select subject, split, round(x[1], 6) + 0.0 as first, round(x[64], 6) + 0.0 as last, len(x)::int as width from features", "features")
def source_features(spark, sf_dir):
    got = readers.load_features(spark, _saved_features(spark, sf_dir))
    return got.select("subject", "split", r6(F.col("features")[0]).alias("first"), r6(F.col("features")[63]).alias("last"), F.size("features").alias("width"))


@query(", " + views.SQL["features"] + "\nselect subject, round(x[1], 6) + 0.0 as first, round(acctbal, 6) + 0.0 as score from features join participants on participant_id = subject", "participants")
def source_features_scores(spark, sf_dir):
    features, scores = readers.load_features_and_scores(spark, _saved_features(spark, sf_dir), _saved_scores(spark, sf_dir))
    return features.join(scores.select(F.col("participant_id").cast("long").alias("subject"), "acctbal"), "subject").select("subject", r6(F.col("features")[0]).alias("first"), r6(F.col("acctbal").cast("double")).alias("score"))


def _saved_matrices(spark, sf_dir, turned: bool = True) -> str:
    """Matrices of odd subjects lie on their side."""
    path, m = new_folder(spark, "signals"), signals.matrices(views.series(spark, sf_dir))
    m.withColumn("m", F.when(F.lit(turned) & (F.col("subject") % 2 == 1), arrays.transpose(F.col("m"))).otherwise(F.col("m"))).write.parquet(path)
    return path


@query(queries._sql_cells("x[6:25]"), "series")
def source_signals(spark, sf_dir):
    got = readers.load_signals(spark, _saved_matrices(spark, sf_dir), 5, 20)
    return queries._cells(got.select("subject", F.posexplode("m").alias("parcel", "x")))


@query(f", f as (select a.subject, {queries._R} as r from signal a join signal b using (subject, t) where a.parcel = 1 and b.parcel = 0 group by a.subject)\nselect subject as participant_id, row_number() over (order by subject) as place, 10 as width, round(r, 6) + 0.0 as first from f join customer on c_custkey = subject", "signal")
def source_scores_with_signals(spark, sf_dir):
    """The score rows that have a signal, in the order of the score file."""
    folder = new_folder(spark, "scores")
    views.participants(spark, sf_dir).select("participant_id", "acctbal").orderBy("participant_id").coalesce(1).write.option("header", True).csv(folder)
    scores = spark.read.schema("participant_id long, acctbal double").option("header", True).csv(folder)
    got = readers.ordered_signals(scores, readers.load_signals(spark, _saved_matrices(spark, sf_dir), 5))
    place = relational.numbered(got.select("participant_id", "pos", "features"), ["pos"], "place")
    return place.select("participant_id", (F.col("place") + 1).alias("place"), F.size("features").alias("width"), r6(F.col("features")[0]).alias("first"))


def _saved_files(spark, sf_dir) -> str:
    """A small file for each nation, in a folder of its subject; every third one lacks its output."""
    folder = new_folder(spark, "files")
    for r in views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        name = f"sub-{r[0]:02d}"
        sinks.write_file(spark, f"{folder}/raw/{name}/{name}_bold.txt", r[1])
        if r[0] % 3:
            sinks.write_file(spark, f"{folder}/out/{name}_done.txt", r[1] * 2)
    return folder


_ENTITY = "'sub-' || lpad(n_nationkey::varchar, 2, '0')"


@query(f"select {_ENTITY} as entity, strlen(n_name)::bigint as length from nation order by 1 limit 10")
def source_files(spark, sf_dir):
    return readers.head_of(readers.files(spark, f"{_saved_files(spark, sf_dir)}/raw", "*_bold.txt", "_bold.txt"), 10).select("entity", "length")


@query(f"select {_ENTITY} as entity from nation where n_nationkey % 3 <> 0")
def source_processed(spark, sf_dir):
    return readers.processed(spark, _saved_files(spark, sf_dir), "_done.txt")


@query(f"select {_ENTITY} as subject from nation")
def source_subject_folders(spark, sf_dir):
    return readers.subjects_with(spark, _saved_files(spark, sf_dir), "*_bold.txt")


@query("select count(*) as n_files, round(sum(strlen(n_name)) / 1e6, 9) as megabytes from nation")
def source_storage(spark, sf_dir):
    return sinks.storage(readers.files(spark, f"{_saved_files(spark, sf_dir)}/raw")).withColumn("megabytes", r6("megabytes", 9))


@query("select round(c_acctbal, 6) + 0.0 as trans_x, case when c_custkey % 4 = 0 then 0.0 else c_custkey::double end as rot_z from customer")
def source_confounds(spark, sf_dir):
    path = new_folder(spark, "confounds")
    table = views.table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("trans_x"), F.lit("x").alias("other"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("double")).alias("rot_z"))
    table.write.option("sep", "\t").option("header", True).option("nullValue", "n/a").csv(path)
    return readers.confounds(spark, path).withColumn("trans_x", r6("trans_x"))


@query("select name from (select unnest(['age', 'IST_fluid', 'neo_n', 'sex', 'Memory_total', 'weight', 'IQ']) as name) where lower(name) like 'ist%' or lower(name) like 'neo%' or lower(name) like '%memory%' or lower(name) like '%iq%'")
def source_cognitive_columns(spark, sf_dir):
    frame = spark.createDataFrame([], ", ".join(f"{c} double" for c in ("age", "IST_fluid", "neo_n", "sex", "Memory_total", "weight", "IQ")))
    return spark.createDataFrame([(c,) for c in readers.cognitive_columns(frame)], "name string")


def _saved_runs(spark, sf_dir) -> str:
    """A run for each region: results for all but the last, metadata that lack something for some."""
    import json

    folder = new_folder(spark, "runs")
    for r in views.table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        run, k = f"{folder}/2026010{r[0]}_120000", r[0]
        if k < 4:
            sinks.write_file(spark, f"{run}/results.csv", "method,r\n")
        whole = {"timestamp": f"2026010{k}_120000", "model": r[1], "data_dir": "d", "n_subjects": 3, "seed": 42, "deterministic": True, "model_size": "s", "device": "cpu"}
        lacking = {1: ("model", "data_dir"), 2: ("n_subjects", "seed")}.get(k, ())
        if k != 3:
            text = "{" if k == 4 else json.dumps({n: v for n, v in whole.items() if n not in lacking})
            sinks.write_file(spark, f"{run}/metadata.json", text)
    return folder


_RUN = "'2026010' || r_regionkey || '_120000'"


@query(f"select {_RUN} as run, r_regionkey <> 3 as has_metadata, r_regionkey < 4 as has_results from region")
def source_runs(spark, sf_dir):
    found = readers.runs(spark, _saved_runs(spark, sf_dir))
    return found.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("run"), "has_metadata", "has_results")


@query(f"select max({_RUN}) as run from region where r_regionkey < 4")
def source_latest_run(spark, sf_dir):
    return readers.latest_run(readers.runs(spark, _saved_runs(spark, sf_dir))).select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("run"))


@query(f"select {_RUN} as run, case r_regionkey when 1 then 'Missing required fields: model, data_dir' when 2 then 'Missing subject count' when 3 then 'metadata.json not found' when 4 then 'Invalid JSON' else '' end as issues, case r_regionkey when 2 then 'seed' else '' end as advice from region")
def metadata_folders(spark, sf_dir):
    found = readers.metadata_issues(spark, _saved_runs(spark, sf_dir))
    return found.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("run"), F.array_join("issues", "; ").alias("issues"), F.array_join("advice", ", ").alias("advice"))


@query("select event_id, event_id % 3 = 0 as ok from events")
def timestamp_format(spark, sf_dir):
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMdd_HHmmss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("20261399_990000")
    return views.table(spark, sf_dir, "events").select("event_id", readers.is_timestamp(stamp).alias("ok"))


@query(queries.SQL["metric_aggregate"])
def sink_results(spark, sf_dir):
    """The summary written as CSV and read again."""
    path = new_folder(spark, "results")
    sinks.write_results(queries.metric_aggregate(spark, sf_dir), path)
    return spark.read.option("header", True).schema("metric string, mean double, std double, min double, max double, median double").csv(path)


@query("select 42 as seed, 'model' as model, count(*) as n_subjects from customer")
def sink_metadata(spark, sf_dir):
    path = new_folder(spark, "metadata")
    sinks.write_metadata(spark, {"run": {"seed": 42, "model": "model"}, "n_subjects": views.table(spark, sf_dir, "customer").count()}, path)
    got = F.from_json("value", "run struct<seed: int, model: string>, n_subjects long")
    return spark.read.text(path).select(got.alias("j")).select("j.run.seed", "j.run.model", "j.n_subjects")


@query("select 'Group ' || status || ': r=' || printf('%.4f', r) as value from (select status, covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)) as r from predictions group by status)", "predictions")
def sink_report(spark, sf_dir):
    got, out = metrics.prediction_metrics(views.predictions(spark, sf_dir), ["status"]), None
    for status in ("F", "O", "P"):
        one = sinks.report(got.where(F.col("status") == status).withColumnRenamed("pearson_r", "r"), f"Group {status}", "r")
        out = one if out is None else out.unionByName(one)
    return out


@query(queries._POPULATION + "\nselect parcel, round(med::float::double, 5) + 0.0 as med, round(iqr::float::double, 5) + 0.0 as iqr from stats", "signal")
def sink_statistics(spark, sf_dir):
    path = new_folder(spark, "statistics")
    sinks.write_statistics(signals.population_statistics(views.series(spark, sf_dir)), path)
    return spark.read.parquet(path).select("parcel", *[r6(F.col(c).cast("double"), 5).alias(c) for c in ("med", "iqr")])


@query(queries.SQL["factor_transform"])
def sink_factor(spark, sf_dir):
    """The fitted factor and the raw table saved, loaded again, and applied to the loaded table."""
    own, folder = queries._split(spark, sf_dir), new_folder(spark, "factor")
    sinks.write_factor(factor.fit(own.where("split = 'train'"), views.VARIABLES), spark, own, folder)
    raw = spark.read.option("header", True).schema(SCORES + ", split string").csv(f"{folder}/raw.csv")
    return factor.transform(raw, readers.load_factor(spark, folder)).select("participant_id", "split", r6("cognition_factor", 5).alias("cognition_factor"))


@query(queries.SQL["reconstruction_summary"])
def sink_reconstruction(spark, sf_dir):
    folder = new_folder(spark, "reconstruction")
    flows.save_reconstruction(queries._pairs(spark, sf_dir), folder, {"seed": 42})
    got = spark.read.option("header", True).schema("metric string, mean double, std double, min double, max double, median double").csv(f"{folder}/summary.csv")
    return got.select("metric", *[r6(F.col(c) + 1e-5, 4).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query(queries._BY + "\nselect method, 'pearson_r' as metric, round(r, 6) + 0.0 as value from m union all select method, 'delta', round(r - (select r from m where method = 'F'), 6) + 0.0 from m", "predictions")
def sink_comparison(spark, sf_dir):
    """A comparison saved (results, long form, metadata, report); its long form read again."""
    folder = new_folder(spark, "comparison")
    flows.save_comparison(queries.baseline_delta(spark, sf_dir), folder, {"seed": 42})
    return spark.read.option("header", True).schema("method string, metric string, value double").csv(f"{folder}/metrics.csv").withColumn("value", r6("value"))


@query(queries.SQL["incremental_ingest"])
def ingest_resumed(spark, sf_dir):
    """A stream of files stopped half way and taken up again from its checkpoint."""
    folder, events = new_folder(spark, "ingest"), views.table(spark, sf_dir, "events")
    for part in (0, 1):
        events.where(F.col("user_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        ingest.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", events.schema, files_per_batch=2)
    done = spark.read.parquet(f"{folder}/out")
    return done.groupBy(F.col("user_id").alias("subject"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


# ---- windows, shapes and arrays -------------------------------------------------------------------------------------


def _matrix_cells(frame: DataFrame) -> DataFrame:
    return queries._cells(frame.select("subject", F.posexplode("m").alias("parcel", "x")))


@query(queries.SQL["window_pad_right"])
def encoder_window_right(spark, sf_dir):
    return _matrix_cells(encoders.prepared(signals.matrices(views.series(spark, sf_dir)), 41, rows=5, pad="right"))


@query(queries.SQL["window_pad_both"])
def encoder_window_both(spark, sf_dir):
    return _matrix_cells(encoders.prepared(signals.matrices(views.series(spark, sf_dir)), 41, pad="both"))


@query(", c as (select subject, parcel, 20 as n, x[6:25] as y from series union all select subject, parcel, 41, x from series)\nselect n, subject, parcel, (i - 1)::int as pos, round(y[i], 6) + 0.0 as v from (select *, unnest(range(1, len(y) + 1)) as i from c)", "series")
def window_crop_only(spark, sf_dir):
    """The middle of long series; short ones stay."""
    own, out = views.series(spark, sf_dir), None
    for n in (20, 41):
        one = queries._cells(own.withColumn("x", arrays.cropped(F.col("x"), n))).withColumn("n", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("select subject, parcel, t as pos, round(v, 6) + 0.0 as v from signal where parcel < 3 and t < 20", "signal")
def shape_reconcile(spark, sf_dir):
    """The first of three channels, cropped to another matrix's shape."""
    m = signals.matrices(views.series(spark, sf_dir)).withColumn("like", F.transform(F.slice("m", 1, 3), lambda x: F.slice(x, 1, 20)))
    first = m.withColumn("m", arrays.first_channel(arrays.replicated(F.col("m"), 3)))
    return _matrix_cells(first.withColumn("m", arrays.reconciled(F.col("m"), F.col("like"))))


@query("select distinct user_id as subject, true as same from events")
def shape_equal(spark, sf_dir):
    own = queries._pairs(spark, sf_dir)
    return own.select("subject", arrays.same_shape(F.col("original"), F.col("rebuilt")).alias("same"))


@query("select event_id, case when event_id % 4 = 0 then 2.0 when value <= 0 or value > 10 then 2.0 else value end as tr from events")
def repetition_time(spark, sf_dir):
    given = F.when(F.col("event_id") % 4 != 0, F.col("value").cast("double"))
    return views.table(spark, sf_dir, "events").select("event_id", arrays.repetition_time(given).alias("tr"))


@query(", m as (select *, avg(v) over w as mv, stddev_pop(v) over w as sv, avg(z) over w as mz, stddev_pop(z) over w as sz from paired window w as (partition by subject, parcel))\nselect subject, parcel, t as pos, round((z - mz) / (sz + 1e-8) * sv + mv, 6) + 0.0 as v from m", "paired")
def display_rescale(spark, sf_dir):
    own = views.paired(spark, sf_dir)
    return queries._cells(own.withColumn("x", arrays.display_rescaled(F.col("z"), F.col("x"))))


@query("select subject, c::int as channel, round(sum(v), 4) + 0.0 as total from signal, range(3) r(c) group by subject, c", "signal")
def channel_replicate(spark, sf_dir):
    m = signals.matrices(views.series(spark, sf_dir)).select("subject", F.posexplode(arrays.replicated(F.col("m"), 3)).alias("channel", "m"))
    return m.select("subject", "channel", r6(F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("select subject, 0 as patch, (i - 1)::int as dim, round(x[i], 6) + 0.0 as v from (select *, unnest(range(1, 65)) as i from features)", "features")
def one_patch(spark, sf_dir):
    m = views.features(spark, sf_dir).select("subject", F.posexplode(arrays.one_patch(F.col("features"))).alias("patch", "x"))
    return m.select("subject", "patch", F.posexplode("x").alias("dim", "v")).withColumn("v", r6("v"))


@query(queries._sql_cells("list_concat([-1.0::double, -1.0, -1.0, -1.0, -1.0], x, [-1.0::double, -1.0, -1.0, -1.0, -1.0, -1.0])"), "series")
def constant_pad(spark, sf_dir):
    return queries._cells(views.series(spark, sf_dir).withColumn("x", arrays.constant_padded(F.col("x"), 41, -1.0)))


@query("""select n_nationkey as place, d::int as dim, round(case when d % 4 < 2 then sin(p / pow(10000, 2 * (d % 2) / 4.0::double)) else cos(p / pow(10000, 2 * (d % 2) / 4.0::double)) end, 6) + 0.0 as v
from (select n_nationkey, d, case when d < 4 then n_nationkey % 5 else n_nationkey // 5 end as p from nation, range(8) r(d))""")
def sincos_2d(spark, sf_dir):
    """Places of a 5 x 5 grid."""
    code = arrays.sincos_encoding_2d(F.floor(F.col("n_nationkey") / 5).cast("double"), (F.col("n_nationkey") % 5).cast("double"), 8)
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.posexplode(code).alias("dim", "v")).withColumn("v", r6("v"))


@query("""select k::int as token, d::int as dim, round(case when k = 0 then 0.0 when d % 4 < 2 then sin(p / pow(10000, 2 * (d % 2) / 4.0::double)) else cos(p / pow(10000, 2 * (d % 2) / 4.0::double)) end, 6) + 0.0 as v
from (select k, d, case when d < 4 then (k - 1) % 4 else (k - 1) // 4 end as p from range(13) s(k), range(8) r(d))""")
def sincos_grid(spark, sf_dir):
    """A grid of 3 x 4 places behind a class token."""
    whole = views.table(spark, sf_dir, "region").limit(1).select(F.posexplode(arrays.sincos_grid(3, 4, 8, True)).alias("token", "x"))
    return whole.select("token", F.posexplode("x").alias("dim", "v")).withColumn("v", r6("v"))


@query("select subject, round(x[1], 6) + 0.0 as first from features order by subject limit 25", "features")
def features_ordered(spark, sf_dir):
    return encoders.ordered(views.features(spark, sf_dir)).limit(25).select("subject", r6(F.col("features")[0]).alias("first"))


# ---- preprocessing --------------------------------------------------------------------------------------------------


@query(", f as (select subject, parcel, regr_slope(v, t) as s, regr_intercept(v, t) as b from signal group by subject, parcel), e as (select subject, parcel, t, v - b - s * t as e from signal join f using (subject, parcel)), n as (select subject, parcel, stddev_samp(e) as d from e group by subject, parcel)\nselect subject, parcel, t as pos, round(e / d, 6) + 0.0 as v from e join n using (subject, parcel) where d > 1e-6", "signal")
def denoise(spark, sf_dir):
    own = views.series(spark, sf_dir).where(arrays.deviation(arrays.detrended(F.col("x"))) > 1e-6)
    return queries._cells(signals.denoised(own))


_LABELS = "(select subject, t, v, case parcel when 0 then 0 when 1 then 1 when 2 then 1 else 2 end as one, case parcel when 0 then 1 when 4 then 0 else 2 end as two from signal)"


@query(f"select subject, parcel, t, round(avg(v), 6) + 0.0 as v from (select subject, one as parcel, t, v from {_LABELS} where one > 0 union all select subject, two + 400, t, v from {_LABELS} where two > 0) group by all", "signal")
def parcellate_two(spark, sf_dir):
    voxels = signals.long(views.series(spark, sf_dir)).withColumnRenamed("parcel", "voxel")
    one, two = (spark.createDataFrame(rows, "voxel int, label int") for rows in ([(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)], [(0, 1), (1, 2), (2, 2), (3, 2), (4, 0)]))
    return signals.parcellate_two(voxels, one, two, 400).withColumn("v", r6("v"))


_DETRENDED = ", f as (select subject, parcel, regr_slope(v, t) as s, regr_intercept(v, t) as b from signal group by subject, parcel), e as (select subject, parcel, t, v - b - s * t as v from signal join f using (subject, parcel))"


@query(_DETRENDED + queries._POPULATION + ", y as (select subject, parcel, t, (e.v - med) / (iqr + 1e-8) as v from e join stats using (parcel) where iqr > 0)\nselect subject, parcel, p::int as pos, round(v, 4) + 0.0 as v from y join range(41) r(p) on y.t = least(p, 29)", "signal")
def preprocess_single(spark, sf_dir):
    """Detrended, scaled by the population's statistics, padded on the right to 41 values."""
    own = views.series(spark, sf_dir)
    known = signals.population_statistics(own).where("iqr > 0")
    got = signals.preprocessed(own.join(known.select("parcel"), "parcel", "left_semi"), 41, known, detrend=True, fallback=False)
    return got.select("subject", "parcel", F.posexplode("x").alias("pos", "v")).withColumn("v", r6("v", 4))


_MEANS = "(select subject, label as parcel, t, avg(v) as v from (select subject, t, v, case parcel when 0 then 0 when 1 then 1 when 2 then 1 else 2 end as label from signal) where label > 0 group by subject, label, t)"


@query(queries._RESIDUAL.replace("from signal", f"from {_MEANS}") + "select subject, (parcel - 1)::int as parcel, (t - 5)::int as pos, round((ev - b * ew - 0.5) / (2 + 1e-8), 6) + 0.0 as v from e join g using (subject, parcel) where t between 5 and 24", "signal")
def subject_prepared(spark, sf_dir):
    """From voxels to an encoder's input: parcel means, confounds removed, scaled, the middle 20 values."""
    voxels = signals.long(views.series(spark, sf_dir)).withColumnRenamed("parcel", "voxel")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)], "voxel int, label int")
    known = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 2.0)], "parcel int, med double, iqr double")
    regressors = F.transform(F.sequence(F.lit(0), F.lit(views.DAYS - 1)), lambda t: F.array(t.cast("double"), F.when(t % 7 >= 5, 1.0).otherwise(0.0)))
    confounds = voxels.select("subject").distinct().withColumn("confounds", regressors)
    return _matrix_cells(signals.subjects_prepared(voxels, labels, views.DAYS, 20, confounds, known))


# ---- features, strategies and reports -------------------------------------------------------------------------------


@query(queries.SQL["fc_features"])
def fc_features_wide(spark, sf_dir):
    """The path of wide matrices."""
    return queries._triangle(connectivity.fc_features(signals.matrices(views.series(spark, sf_dir))), 5)


@query(f"select 'cosine' as kind, * from ({{}}) union all select 'temporal', * from ({{}})".format(*(f"with {views.SQL['features']}" + queries.SQL[n].removeprefix(f"with {views.SQL['features']}") for n in ("cosine_triangle", "roi_temporal_corr"))))
def similarity_dispatch(spark, sf_dir):
    """Cosines of patches without a layout, correlations of regions over time with one."""
    cosine = queries._triangle(connectivity.similarity_features(views.patches(spark, sf_dir), None), 8).withColumn("kind", F.lit("cosine"))
    small = views.features(spark, sf_dir).select("subject", arrays.reshape(F.col("features"), 4).alias("m"))
    return cosine.unionByName(queries._triangle(connectivity.similarity_features(small, (4, 4)), 4).withColumn("kind", F.lit("temporal")))


_CASES = ((700, 179, 500, 3_456_000, 20e9), (700, 179, 500, 3_456_000, 40e9), (50, 20, 500, 768, 1e9), (3, 1, 10, 10, 100.0), (200, 50, 100, 500_000, 1e9))


@query("with c as (select * from (values " + ", ".join(f"({a}, {b}, {k}, {d}, {cap}::double)" for a, b, k, d, cap in _CASES) + ") v(a, b, k, d, cap)), m as (select *, 4 * d::double * (a + b) + 12 * least(k, greatest(1, a - 1)) * d::double as bytes from c)\nselect a, b, bytes::bigint as bytes, case when bytes <= cap then 'pca' else 'blocks' end as strategy, (case when bytes <= cap then 0 else least(20, greatest(2, floor(greatest(0.3::double * cap, cap - 4 * d::double * (a + b)) / (8 * d)))) end)::int as block from m")
def memory_strategy(spark, sf_dir):
    rows = [(a, b, kernel.memory_bytes(a, b, k, d), *kernel.strategy(a, b, k, d, cap)) for a, b, k, d, cap in _CASES]
    return spark.createDataFrame(rows, "a int, b int, bytes long, strategy string, block int")


@query(queries._UNPIVOT + ", c as (select metric, avg(value) as mean, stddev_pop(value) / avg(value) as cv, max(value) as top from u group by metric)\nselect metric, round(mean + 1e-9::double, 6) + 0.0 as mean, round(cv, 6) + 0.0 as cv, row_number() over (order by cv, metric)::int as place, (select count(*) from metric_rows) as n_binned from c", "metric_rows")
def metric_report(spark, sf_dir):
    """Tables of the whole report, one row for each metric."""
    names = queries._NAMES
    tables = flows.analyse(views.metric_rows(spark, sf_dir).withColumn("subject", F.col("subject").cast("string")), names)
    binned = None
    for n in names:
        one = tables[f"histogram_{n}"].agg(F.sum("n").alias("n_binned")).withColumn("metric", F.lit(n))
        binned = one if binned is None else binned.unionByName(one)
    got = tables["summary"].select("metric", queries._off_ties("mean").alias("mean")).join(tables["ranking"].withColumn("cv", r6("cv")), "metric")
    return got.join(binned, "metric")


@query("select split, count(*) as n, max(len(x))::int as width from features group by split", "features")
def split_counts(spark, sf_dir):
    return metrics.cohort_sizes(views.features(spark, sf_dir))


@query(f", r as (select rank() over (order by mse) + (count(*) over (partition by mse) - 1) / 2 as a, rank() over (order by peak) + (count(*) over (partition by peak) - 1) / 2 as b from metric_rows), c as (select count(*) as n, corr(a, b) as r from r)\nselect n, round(r, 6) + 0.0 as spearman_r, round({queries._p_sql('r', 'n')}, 9) + 0.0 as p_value from c", "metric_rows")
def spearman_p(spark, sf_dir):
    got = metrics.spearman_global(views.metric_rows(spark, sf_dir).select(F.col("mse").alias("y_true"), F.col("peak").alias("y_pred")))
    return got.select("n", r6("spearman_r").alias("spearman_r"), r6(stats.p_value(F.col("spearman_r"), F.col("n")), 9).alias("p_value"))


# ---- npy files and runs in batches ----------------------------------------------------------------------------------


@query(queries._sql_cells("x[6:25]"), "series")
def source_npy(spark, sf_dir):
    """Matrices written as npy files by Spark and read back, cropped to the middle 20 columns."""
    folder = new_folder(spark, "npy")
    npy.write(readers.load_signals(spark, _saved_matrices(spark, sf_dir), 5), folder)
    got = readers.oriented_signals(npy.signals(spark, folder), 5, 20)
    return queries._cells(got.select(F.col("subject").cast("long").alias("subject"), F.posexplode("m").alias("parcel", "x")))


@query(", s as (select distinct subject from series)\nselect subject, 5::bigint as n_rows, 30::bigint as n_columns from s", "series")
def source_npy_shapes(spark, sf_dir):
    """Shapes of a folder of npy files, from their headers alone."""
    folder = new_folder(spark, "npy")
    npy.write(readers.load_signals(spark, _saved_matrices(spark, sf_dir), 5), folder)
    return npy.read(spark, folder, values=False).select(F.col("subject").cast("long").alias("subject"), F.col("shape")[0].alias("n_rows"), F.col("shape")[1].alias("n_columns"))


@query("select vec_id as subject, round(list_avg(embedding::double[]), 6) + 0.0 as mean, vec_id % 100 = 3 as failed from embeddings where vec_id % 100 <> 3 union all select vec_id, null, true from embeddings where vec_id % 100 = 3")
def batch_resumed(spark, sf_dir):
    """A run in batches that is killed half-way and resumed: every entity has its result once, failed ones their error."""
    folder, started = new_folder(spark, "run"), []

    def compute(values):
        if any(v[0] is None for v in values):
            raise ValueError("no first value")
        return [[sum(v) / len(v)] for v in values]

    def one(part, killed=3):
        started.append(1)
        if len(started) == killed:
            raise KeyboardInterrupt
        return encoders.applied(part, compute, "features", "array<double>")

    frame = views.features(spark, sf_dir).select("subject", F.when(F.col("subject") % 100 == 3, F.transform("features", lambda v: F.lit(None).cast("double"))).otherwise(F.col("features")).alias("features"))
    try:
        ledger.run(frame, "subject", one, folder, batches=5)
    except KeyboardInterrupt:
        pass
    done = ledger.run(frame, "subject", one, folder)
    return done.select("subject", queries.r6(F.col("result")[0]).alias("mean"), F.col("error").isNotNull().alias("failed"))


# ---- ingestion with retries, data of plots, voxels, observed strategies ----------------------------------------------


@query("select 'sub-' || lpad(n_nationkey::varchar, 2, '0') as entity, case when n_nationkey % 10 = 4 then 'parked' else 'done' end as state, case when n_nationkey % 10 <> 4 then round(length(n_name) * 1.5, 6) end as value, case when n_nationkey % 10 = 4 then 3 else 0 end as attempts from nation")
def ingest_retried(spark, sf_dir):
    """Files ingested as a stream over two runs: poisoned ones are tried three times and parked, the others are done once."""
    folder = new_folder(spark, "retry")
    rows = views.table(spark, sf_dir, "nation").select(F.format_string("sub-%02d", F.col("n_nationkey").cast("int")).alias("entity"), F.when(F.col("n_nationkey") % 10 == 4, "?").otherwise(F.length("n_name").cast("string")).alias("value"))
    files = rows.repartition(5, "entity").select("value", "entity")

    def parse(content: bytes) -> list:
        return [float(content.strip()) * 1.5]

    for even in (0, 1):  # a second run finds the rest
        part = files.where(F.pmod(F.xxhash64("entity"), F.lit(2)) == even)
        part.write.mode("append").partitionBy("entity").text(f"{folder}/in")
        done, parked = ingest.ingest_files(spark, f"{folder}/in/entity=*", f"{folder}/out", f"{folder}/state", parse, attempts=3, files_per_batch=4)
    entity = F.regexp_extract("path", "entity=([^/]+)", 1).alias("entity")
    one = done.select(entity, F.lit("done").alias("state"), r6(F.col("result")[0]).alias("value"), F.lit(0).alias("attempts"))
    return one.unionByName(parked.select(entity, F.lit("parked").alias("state"), F.lit(None).cast("double").alias("value"), "attempts"))


@query("""with p as (select l_quantity::double as x, l_discount::double as y from lineitem), e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
b as (select least(11, floor((x - x0) / (x1 - x0) * 12))::int as x_bin, least(11, floor((y - y0) / (y1 - y0) * 12))::int as y_bin, x0, x1, y0, y1 from p, e)
select x_bin, y_bin, count(*) as n, round(min(x0 + x_bin * (x1 - x0) / 12), 6) as x_low, round(min(y0 + y_bin * (y1 - y0) / 12), 6) as y_low from b group by all""")
def plot_bins(spark, sf_dir):
    """Counts on a grid, for a scatter plot of any number of points."""
    got = metrics.bins_2d(views.table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 12)
    return got.select("x_bin", "y_bin", "n", r6("x_low").alias("x_low"), r6("y_low").alias("y_low"))


@query("""with p as (select event_type, epoch(ts)::double as t, value::double as v from events where value is not null), e as (select event_type, min(t) as a, max(t) as b from p group by event_type),
c as (select event_type, t, v, least(7, floor((t - a) / (b - a) * 8))::int as bucket from p join e using (event_type)),
r as (select *, row_number() over (partition by event_type, bucket order by v, t) as l, row_number() over (partition by event_type, bucket order by v desc, t) as h from c)
select event_type, bucket, max(t) filter (l = 1) as t_low, max(v) filter (l = 1) as low, max(t) filter (h = 1) as t_high, max(v) filter (h = 1) as high from r group by all""")
def plot_extremes(spark, sf_dir):
    """Least and largest values of stretches of time, for a line plot that keeps its peaks."""
    events = views.table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.min_max(events, ["event_type"], "t", "value", 8)


_AFFINE = [[0.7, 0.0, 0.1, 0.25], [0.0, 0.5, 0.0, 0.0], [0.1, 0.0, 0.8, -0.5]]


def _neighbours_sql() -> str:
    place = ", ".join(f"{a} * i + {b} * j + {c} * k + {d} as {n}" for n, (a, b, c, d) in zip("xyz", _AFFINE, strict=True))
    weight = " * ".join(f"(case when {e} = 1 then {n} - floor({n}) else 1 - ({n} - floor({n})) end)" for n, e in zip("xyz", "abc", strict=True))
    return f"""with v as (select user_id % 3 as s, (user_id % 5)::int as i, (day(ts) % 6)::int as j, (hour(ts) % 4)::int as k, sum(value)::double as v from events group by all),
g as (select i, j, k, {place} from (select i::double as i, j::double as j, k::double as k from range(6) a(i), range(8) b(j), range(5) c(k))),
n as (select i, j, k, floor(x) + a as x, floor(y) + b as y, floor(z) + c as z, {weight} as w from g, range(2) p(a), range(2) q(b), range(2) r(c))
select s as subject, n.i::int as i, n.j::int as j, n.k::int as k, round(sum(v.v * w) + 1e-9::double, 6) as v from v join n on v.i = n.x and v.j = n.y and v.k = n.z where w > 0 group by all"""


@query(_neighbours_sql())
def resample_voxels(spark, sf_dir):
    """A grid of events resampled by an affine map and trilinear weights."""
    voxels = views.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("subject"), (F.col("user_id") % 5).cast("int").alias("i"), (F.dayofmonth("ts") % 6).alias("j"), (F.hour("ts") % 4).alias("k")).agg(F.sum("value").cast("double").alias("v"))
    return signals.resampled(voxels, _AFFINE, (6, 8, 5), ["subject"]).withColumn("v", queries._off_ties("v"))


@query("""with f as (select count(*) filter (vec_id % 5 <> 0) as a, count(*) filter (vec_id % 5 = 0) as b, max(len(embedding)) as d from embeddings),
c as (select *, 4 * d::double * (a + b) + 12 * least(50, greatest(1, a - 1)) * d::double as bytes, unnest([1e9, 1000]) as cap from f)
select cap::double as cap, a::bigint as n_train, b::bigint as n_test, d::bigint as width, case when bytes <= cap then 'pca' else 'blocks' end as strategy, (case when bytes <= cap then 0 else least(20, greatest(2, floor(greatest(0.3 * cap, cap - 4 * d::double * (a + b)) / (8 * d)))) end)::int as block, true as predicted from c""")
def strategy_observed(spark, sf_dir):
    """Rows and width as observed on the table decide between components and blocks; each cap's comparison is run by its branch."""
    base, out = views.features(spark, sf_dir), None
    facts = base.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), F.max(F.size("features")).cast("long").alias("width"))
    own = facts.first()
    for cap in (1e9, 1000.0):
        name, block = kernel.strategy(own.n_train, own.n_test, 50, own.width, cap)
        got = flows.extended(base.select(F.lit("fc_input").alias("method"), "subject", "split", "features", "y"), views.patches(spark, sf_dir), base.select("subject", "split", "y"), cap=cap, components=50)
        done = got.agg((F.count_if((F.col("method") == "flat_patches") & F.col("pearson_r").isNotNull()) == 1).alias("predicted"))
        one = facts.select(F.lit(cap).alias("cap"), "n_train", "n_test", "width", F.lit(name).alias("strategy"), F.lit(block).alias("block")).join(F.broadcast(done))
        out = one if out is None else out.unionByName(one)
    return out


@query("select l_returnflag as flag, q, count(*) as n, true as within from lineitem, (values (0.25::double), (0.5::double), (0.75::double)) v(q) group by all")
def sketched_statistics(spark, sf_dir):
    """Quantiles of all batches from sketches that were kept for each, and whether their exact ranks are within the stated bound."""
    folder, rows = new_folder(spark, "sketches"), views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("batch"), F.col("l_extendedprice").alias("v"))
    signals.quantile_sketches(rows, ["flag", "batch"]).write.partitionBy("batch").parquet(folder)
    found = signals.merged_statistics(spark.read.parquet(folder), ["flag"])
    each = found.select("flag", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("estimate")) for q, c in ((0.25, "q25"), (0.5, "med"), (0.75, "q75"))])))
    ranks = rows.join(F.broadcast(each), "flag").groupBy("flag", "q").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("estimate")).alias("below"), F.count_if(F.col("v") <= F.col("estimate")).alias("upto"))
    off = signals.RANK_ERROR * F.col("n") + 1
    return ranks.select("flag", "q", "n", ((F.col("below") <= F.col("q") * F.col("n") + off) & (F.col("upto") >= F.col("q") * F.col("n") - off)).alias("within"))
