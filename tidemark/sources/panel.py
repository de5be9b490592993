"""Panels and points from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_panel(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """date, ticker, sector, close: mean extended price by nation (ticker), region (sector) and period of shipping.

    The dimension tables are of fixed size (nation, region) or joined by key; the mean is taken in two stages, partial
    sums first, so only one row per period and ticker and task is shuffled.
    """
    t = lambda n: table(spark, sf_dir, n)
    nation = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    o = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    l = t("lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice").join(o.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = l.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.to_date(F.date_trunc(grain, "l_shipdate")).alias("date"), F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    return g.agg(F.avg("l_extendedprice").alias("close"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker (event type), sector (parity of the user), close: daily means of events."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker")).agg(F.avg("value").alias("close")).withColumn("sector", F.lit("events"))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (all dimensions as doubles), label."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label"))
