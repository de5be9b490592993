"""Returns and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import clip

def _by_date():
    return W.partitionBy("ticker").orderBy("date")


def log_returns(panel: DataFrame) -> DataFrame:
    """ret = ln p_t - ln p_(t-1), without each ticker's first day."""
    return panel.withColumn("ret", F.log("close") - F.lag(F.log("close")).over(_by_date())).where("ret is not null")


def simple_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", F.col("close") / F.lag("close").over(_by_date()) - 1).where("ret is not null")


def winsorize(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Clip each column to its exact percentiles over all rows."""
    q = df.agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(q))  # one row
    for c in columns:
        out = out.withColumn(c, clip(F.col(c), F.col(f"_{c}")[0], F.col(f"_{c}")[1]))
    return out.drop(*(f"_{c}" for c in columns))


def with_ord(returns: DataFrame) -> DataFrame:
    """Adds ord: the ordinal of the date from 0. Only dates go through one task."""
    days = returns.select("date").distinct().withColumn("ord", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))
    return returns.join(days, "date")


def max_drawdown(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Lowest value / running peak - 1 per key, at most 0."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_peak", F.max(value).over(w))
    return d.groupBy(*keys).agg(F.least(F.min(F.col(value) / F.col("_peak") - 1), F.lit(0.0)).alias("max_drawdown"))


def cumulative(df: DataFrame, keys: list[str], order: str, ret: str = "ret") -> DataFrame:
    """level: product of 1 + ret up to each row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("level", F.exp(F.sum(F.log1p(ret)).over(w)))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores over all rows; a constant column is only centred."""
    a = df.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(a))  # one row
    for i, c in enumerate(columns):
        sd = F.coalesce(F.nullif(F.col(f"_s{i}"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m{i}")) / sd)
    return out.drop(*(f"_{k}{i}" for i in range(len(columns)) for k in "ms"))


def asset_features(panel: DataFrame, year: int = 52, half: int = 26) -> DataFrame:
    """latest_price, return_1y, volatility_1y, momentum_6m, max_drawdown_1y of each ticker, over the last periods."""
    back = W.partitionBy("ticker").orderBy(F.col("date").desc())
    d = simple_returns(panel).withColumn("back", F.row_number().over(back))
    last = d.where(F.col("back") <= year)
    g = last.groupBy("ticker").agg(
        F.min_by("close", "back").alias("latest_price"),
        (F.min_by("close", "back") / F.max_by("close", "back") - 1).alias("return_1y"),
        (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(year)))).alias("volatility_1y"),
        (F.min_by("close", "back") / F.max_by(F.when(F.col("back") <= half, F.col("close")), F.when(F.col("back") <= half, F.col("back"))) - 1).alias("momentum_6m"),
    )
    return g.join(max_drawdown(last, ["ticker"], "date", "close").withColumnRenamed("max_drawdown", "max_drawdown_1y"), "ticker")
