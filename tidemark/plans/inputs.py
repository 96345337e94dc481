"""The shared tables as product-analytics inputs, in Spark and as DuckDB CTEs of the same names.

users are the customers that have events, subscriptions are orders as state periods of a customer,
sessions are runs of events with gaps of at most 30 minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_MINUTES = 30


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("event_name"), k.alias("k"), "value")


def users(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("signup_ts"))
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return people.join(seen, F.col("c_custkey") == F.col("user_id")).select("user_id", "signup_ts", F.col("c_mktsegment").alias("persona"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("user_id") % 2 == 0).alias("is_team"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessionized(events(spark, sf)).groupBy("user_id", "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("event_count"))


def sessionized(rows: DataFrame, minutes: int = GAP_MINUTES) -> DataFrame:
    """Events with the number of their session within the user; a gap of more than ``minutes`` starts one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts"))
    return rows.withColumn("session", F.sum(F.when(F.coalesce(gap > minutes * 60, F.lit(True)), 1).otherwise(0)).over(order))


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").withColumn("end_ts", F.lead("o_orderdate").over(order))
    return rows.select(F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("plan"), F.col("o_orderdate").alias("start_ts"), "end_ts", F.col("o_totalprice").alias("mrr"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Feature usage per user, feature (the bucket k) and day."""
    rows = events(spark, sf).withColumn("day", F.to_date("ts"))
    return rows.groupBy("user_id", F.col("k").alias("feature"), "day").agg(
        F.count("*").alias("usage_count"), (2 * F.count("*")).alias("active_minutes"), F.count_if(F.col("event_name") == "purchase").alias("successes"), F.count_if(F.col("event_name") == "error").alias("errors")
    )


CTES = {
    "e": "SELECT event_id, user_id, ts, event_type AS event_name, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS k, value FROM events",
    "u": "SELECT user_id, signup_ts, c_mktsegment AS persona, n_name AS country, r_name AS region, user_id % 2 = 0 AS is_team FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT user_id, min(ts) AS signup_ts FROM events GROUP BY user_id) ON c_custkey = user_id",
    "x": f"SELECT *, sum(CASE WHEN g IS NULL OR g > {GAP_MINUTES * 60} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS g FROM e)",
    "s": "SELECT user_id, session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count FROM x GROUP BY user_id, session",
    "b": "SELECT o_orderkey AS subscription_id, o_custkey AS user_id, CAST(substring(o_orderpriority, 1, 1) AS INT) AS plan, o_orderdate AS start_ts, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_ts, o_totalprice AS mrr FROM orders",
    "g": "SELECT user_id, k AS feature, CAST(ts AS DATE) AS day, count(*) AS usage_count, 2 * count(*) AS active_minutes, count(*) FILTER (event_name = 'purchase') AS successes, count(*) FILTER (event_name = 'error') AS errors FROM e GROUP BY ALL",
}


def sql(body: str, *names: str, **more: str) -> str:
    """A statement over some of the CTEs above and further ones, in order."""
    need = list(dict.fromkeys(y for x in names for y in {"x": ("e", "x"), "s": ("e", "x", "s"), "g": ("e", "g")}.get(x, (x,))))
    ctes = [f"{x} AS ({CTES[x]})" for x in need] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
