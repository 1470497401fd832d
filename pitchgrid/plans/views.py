"""Tracking-shaped views of the driver's tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRK = """trk AS (
  SELECT user_id AS object_id, user_id % 3 AS match_id, event_id AS src_row, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS frame,
         CASE WHEN event_type <> 'error' THEN value END AS x,
         CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::DOUBLE END AS y,
         (user_id % 2)::INT AS team, user_id % 25 = 0 AS is_ball
  FROM events)"""

MOM = """mom0 AS (
  SELECT dense_rank() OVER (ORDER BY date_trunc('hour', ts))::INT AS frame, user_id AS object_id, event_id, value,
         (user_id % 2)::INT AS team
  FROM events),
mom AS (SELECT frame, object_id, min(event_id) AS event_id, arg_min(value, event_id) AS value, min(team) AS team
        FROM mom0 GROUP BY frame, object_id)"""

BOX = """box AS (
  SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice)::INT AS det_id,
         l_quantity * 10 AS x1, l_linenumber * 40.0::DOUBLE AS y1,
         l_quantity * 10 + (30 + 1000 * l_discount) AS x2, l_linenumber * 40.0::DOUBLE + (80 + 1000 * l_tax) AS y2,
         l_extendedprice AS confidence, (l_suppkey % 4)::INT AS class_id, (l_partkey % 2)::INT AS team_id
  FROM lineitem)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").alias("object_id"),
        (F.col("user_id") % 3).alias("match_id"),
        F.col("event_id").alias("src_row"),
        "ts",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("frame"),
        F.when(ok, F.col("value")).alias("x"),
        F.when(ok, F.get_json_object("props", "$.k").cast("double")).alias("y"),
        (F.col("user_id") % 2).cast("int").alias("team"),
        (F.col("user_id") % 25 == 0).alias("is_ball"),
    )


def moment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event; the frame is the rank of its hour. Hours are few, so ranking them alone needs no large sort."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    e = e.withColumn("hour", F.date_trunc("hour", "ts"))
    hours = e.select("hour").distinct().withColumn("frame", F.row_number().over(Window.orderBy("hour")))
    return e.join(hours, "hour").select("frame", F.col("user_id").alias("object_id"), "event_id", "value", (F.col("user_id") % 2).cast("int").alias("team"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return li.select(
        c("l_orderkey").alias("frame"),
        F.row_number().over(order).alias("det_id"),
        (c("l_quantity") * 10).alias("x1"),
        (c("l_linenumber") * F.lit(40.0)).alias("y1"),
        (c("l_quantity") * 10 + (30 + 1000 * c("l_discount"))).alias("x2"),
        (c("l_linenumber") * F.lit(40.0) + (80 + 1000 * c("l_tax"))).alias("y2"),
        c("l_extendedprice").alias("confidence"),
        (c("l_suppkey") % 4).cast("int").alias("class_id"),
        (c("l_partkey") % 2).cast("int").alias("team_id"),
    )


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
