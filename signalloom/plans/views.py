"""The engine's views over the test tables: events as signals, embeddings as features, customers as participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import signals

DAYS, START = 30, "2024-01-01"
#: The variables of a participant, the last one being the total that gives a factor its sign.
VARIABLES = ["acctbal", "n_orders", "avg_price", "sum_price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, parcel, x): a user's daily sums of each event type, the types numbered in order."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().withColumn("parcel", F.row_number().over(Window.orderBy("event_type")) - 1)
    cells = events.join(kinds, "event_type").select(F.col("user_id").alias("subject"), "parcel", F.datediff("ts", F.lit(START).cast("date")).alias("t"), F.col("value").alias("v"))
    return signals.dense_series(cells, DAYS, kinds)


def rebuilt(own: DataFrame) -> DataFrame:
    """A stand-in for reconstructed series: centred three-day means."""
    return own.withColumn("x", arrays.moving_average(F.col("x"), 1))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, parcel, x, z): a series and its reconstruction in one row."""
    return series(spark, sf_dir).withColumn("z", arrays.moving_average(F.col("x"), 1))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, split, features, y) of the embeddings; every fifth id is a test row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), arrays.doubles("embedding").alias("features"), F.col("label").cast("double").alias("y"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, m): an embedding as 8 patches of 8 values."""
    return features(spark, sf_dir).select("subject", arrays.reshape(F.col("features"), 8).alias("m"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(participant_id, acctbal, n_orders, avg_price, sum_price); customers without orders have nulls."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"), F.sum("o_totalprice").alias("sum_price"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_acctbal").alias("acctbal"))
    return customers.join(orders, customers.participant_id == orders.o_custkey, "left").drop("o_custkey")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, status, y_true, y_pred): an order's price, and the sum of its lines' prices."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("y_true"))
    return orders.join(lines, orders.key == lines.l_orderkey).drop("l_orderkey")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, mse, mae, peak): errors of the reconstruction and the largest value of a user's series."""
    cells = paired(spark, sf_dir).select("subject", F.explode(F.arrays_zip("x", "z")).alias("c"))
    d = F.col("c.x") - F.col("c.z")
    return cells.groupBy("subject").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max("c.x").alias("peak"))


# ---- the same views as SQL ------------------------------------------------------------------------------------------

_KINDS = "kinds as (select event_type, (row_number() over (order by event_type) - 1)::int as parcel from (select distinct event_type from events))"
_SIGNAL = f"""{_KINDS},
sums as (select user_id as subject, parcel, datediff('day', date '{START}', ts::date)::int as t, sum(value) as v from events join kinds using (event_type) group by all),
signal as (select g.subject, g.parcel, g.t, coalesce(s.v, 0)::double as v from
  (select subject, parcel, t from (select distinct user_id as subject from events) cross join (select parcel from kinds) cross join (select unnest(range({DAYS}))::int as t)) g
  left join sums s using (subject, parcel, t))"""
SQL = {
    "signal": _SIGNAL,
    "series": _SIGNAL + ",\nseries as (select subject, parcel, list(v order by t) as x from signal group by subject, parcel)",
    "paired": _SIGNAL + ",\npaired as (select *, avg(v) over (partition by subject, parcel order by t rows between 1 preceding and 1 following) as z from signal)",
    "features": "features as (select vec_id as subject, case when vec_id % 5 = 0 then 'test' else 'train' end as split, embedding::double[] as x, label::double as y from embeddings)",
    "participants": """participants as (select c_custkey as participant_id, c_acctbal as acctbal, n_orders, avg_price, sum_price from customer
  left join (select o_custkey, count(*)::double as n_orders, avg(o_totalprice) as avg_price, sum(o_totalprice) as sum_price from orders group by o_custkey) on o_custkey = c_custkey)""",
    "predictions": """predictions as (select o_orderkey as key, o_orderstatus as status, o_totalprice as y_true, y_pred from orders
  join (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as y_pred from lineitem group by l_orderkey) on l_orderkey = o_orderkey)""",
}
SQL["metric_rows"] = SQL["paired"] + ",\nmetric_rows as (select subject, avg((v - z) * (v - z)) as mse, avg(abs(v - z)) as mae, max(v) as peak from paired group by subject)"
