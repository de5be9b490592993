"""Extremes, top-k, scaling, search and layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import min_max


def key_snapshots(metrics: DataFrame, want: int = 4) -> DataFrame:
    """pick, window_ord: most volatile, most and least correlated, then the latest windows until ``want`` are found.

    Ties go to the smallest ordinal; each window is picked once, and the list ends when the windows do.
    """
    one = metrics.agg(
        F.min_by("window_ord", F.struct(-F.col("market_volatility"), "window_ord")).alias("a"),
        F.min_by("window_ord", F.struct(-F.col("mean_correlation"), "window_ord")).alias("b"),
        F.min_by("window_ord", F.struct(F.col("mean_correlation"), F.col("window_ord"))).alias("c"),
    )
    picks = one.select(F.posexplode(F.array("a", "b", "c")).alias("pick", "window_ord"))
    late = metrics.select("window_ord").orderBy(F.col("window_ord").desc()).limit(want + 3).select((F.row_number().over(W.orderBy(F.col("window_ord").desc())) + 2).alias("pick"), "window_ord")
    every = picks.unionByName(late).groupBy("window_ord").agg(F.min("pick").alias("pick"))
    return every.orderBy("pick").limit(want).select(F.row_number().over(W.orderBy("pick")).alias("pick"), "window_ord")


def top_by(df: DataFrame, score: Column, most: int, *ties: str) -> DataFrame:
    """The rows of the highest scores, ties by the given columns."""
    return df.withColumn("score", score).orderBy(F.col("score").desc(), *ties).limit(most)


def signal(ret: str = "return_1y", momentum: str = "momentum_6m") -> Column:
    return F.abs(ret) + F.abs(momentum)


def importance(ret: str = "return_1y", momentum: str = "momentum_6m") -> Column:
    return F.greatest(F.abs(ret), F.abs(momentum))


def near_edges(points: DataFrame, k: int = 2) -> DataFrame:
    """t1 < t2: edges to the ``k`` nearest points of the same cluster. points: ticker, cluster, x, y."""
    a = points.select("cluster", F.col("ticker").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = points.select("cluster", F.col("ticker").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    d = a.join(b, "cluster").where("a <> b").withColumn("d", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    near = d.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.round("d", 9), "b"))).where(F.col("_r") <= k)
    return near.select(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2")).distinct()


def search(df: DataFrame, query: str, key: str = "ticker") -> DataFrame:
    """The exact match, else the first that contains the query."""
    q = query.strip().upper()
    return df.where(F.contains(key, F.lit(q))).orderBy(F.col(key) != q, key).limit(1)


def substring_filter(df: DataFrame, query: str, key: str = "ticker") -> DataFrame:
    return df.where(F.contains(key, F.lit(query.strip().upper())))


def axis_limits(df: DataFrame, column: str, pad: float = 0.1, least: float = 0.05) -> DataFrame:
    """low, high: the range with a margin of ``pad`` of it, at least ``least``."""
    g = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    m = F.greatest((F.col("hi") - F.col("lo")) * pad, F.lit(least))
    return g.select((F.col("lo") - m).alias("low"), (F.col("hi") + m).alias("high"))


def size_scale(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """size: the column from its 5% to its 95% percentile, clipped, on [low, high]."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    s = min_max(F.greatest(F.least(F.col(column), F.col("_q")[1]), F.col("_q")[0]), F.col("_q")[0], F.col("_q")[1])
    return df.crossJoin(F.broadcast(q)).withColumn("size", low + s * (high - low)).drop("_q")  # one row


def range_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each column on [low, high] by its range; a constant goes to the middle."""
    g = df.agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))))
    out = df.crossJoin(F.broadcast(g))  # one row
    for i, c in enumerate(columns):
        out = out.withColumn(c, low + min_max(F.col(c), F.col(f"_a{i}"), F.col(f"_z{i}")) * (high - low))
    return out.drop(*(f"_{n}{i}" for i in range(len(columns)) for n in "az"))


def ring_layout(df: DataFrame, cluster: str = "cluster", radius: float = 1.0) -> DataFrame:
    """cx, cy: the clusters in order around a ring."""
    c = df.select(cluster).distinct()
    c = c.withColumn("_no", F.row_number().over(W.orderBy(cluster)) - 1).withColumn("_n", F.count("*").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))  # clusters only
    angle = F.lit(2 * math.pi) * F.col("_no") / F.col("_n")
    return df.join(F.broadcast(c.select(cluster, (radius * F.cos(angle)).alias("cx"), (radius * F.sin(angle)).alias("cy"))), cluster)


def summary_cards(df: DataFrame) -> DataFrame:
    """One row: count, mean return, mean volatility, lowest drawdown."""
    return df.agg(F.count("*").alias("n"), F.avg("return_1y").alias("mean_return"), F.avg("volatility_1y").alias("mean_volatility"), F.min("max_drawdown_1y").alias("worst_drawdown"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _two_decimals(c: Column) -> Column:
    """As C's printf: the binary value itself is rounded, ties to the even digit. Java's formatter rounds the shortest
    decimal that stands for it, half up, so that 1.005, which is a little less, would become 1.01."""
    return F.udf(lambda x: "%.2f" % x, "string")(F.coalesce(c.cast("double"), F.lit(0.0)))


def dollars(c: Column) -> Column:
    """$0.00; anything not finite is a dash."""
    return F.when(_finite(c), F.concat(F.lit("$"), _two_decimals(c))).otherwise("—")


def percent(c: Column) -> Column:
    return F.when(_finite(c), F.concat(_two_decimals(c * 100), F.lit("%"))).otherwise("—")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, sd, min, max of each column."""
    long = df.select(*columns).unpivot([], columns, "metric", "v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
