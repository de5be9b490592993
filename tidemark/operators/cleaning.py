"""Panel cleaning: filters, keep-last, spine, bounded forward fill, coverage, common days, reports.

A panel has the columns date, ticker, sector, close. Null is missing; NaN never leaves the ingest filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio


def positive_prices(df: DataFrame, price: str = "close") -> DataFrame:
    """Numeric, not missing and above 0."""
    v = F.expr(f"try_cast({price} as double)")
    return df.withColumn(price, v).where((F.col(price) > 0) & ~F.isnan(price))


def finite_prices(df: DataFrame, price: str = "close") -> DataFrame:
    """Above 0 and finite."""
    return positive_prices(df, price).where(F.col(price) < float("inf"))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key, the one that comes last in ``order`` (a total input order)."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_rank = 1").drop("_rank")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows share their key with another."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def in_universe(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(universe.select(key), key, "left_semi")


def look_back(df: DataFrame, years: int) -> DataFrame:
    """Rows from the later of the first date and ``years`` before the last date on."""
    ends = df.agg(F.greatest(F.min("date"), F.add_months(F.max("date"), -12 * years)).alias("_from"))
    return df.crossJoin(F.broadcast(ends)).where("date >= _from").drop("_from")  # the other side is one row


def trading_days(df: DataFrame) -> DataFrame:
    """Distinct dates with an ordinal from 0; only the dates go through one task."""
    return df.select("date").distinct().withColumn("ord", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))


def reindex(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Every ticker on every day, missing closes null."""
    days = days if days is not None else df.select("date").distinct()
    names = df.select("ticker", "sector").distinct()
    # the spine is the result's own size: every ticker on every day
    spine = names.crossJoin(days.select("date"))
    return spine.join(df.select("date", "ticker", "close"), ["date", "ticker"], "left")


def forward_fill(df: DataFrame, limit: int = 2) -> DataFrame:
    """Fill at most ``limit`` missing closes in a row with the last one; never backwards."""
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(-limit, 0)
    return df.withColumn("raw_close", F.col("close")).withColumn("close", F.coalesce("close", F.last("close", ignorenulls=True).over(w)))


def coverage(filled: DataFrame) -> DataFrame:
    """Per ticker: expected and valid days, before and after filling."""
    g = filled.groupBy("ticker", "sector").agg(
        F.count("*").alias("expected_days"),
        F.count("raw_close").alias("raw_valid_days"),
        F.count("close").alias("valid_days"),
        F.min(F.when(F.col("raw_close").isNotNull(), F.col("date"))).alias("first_date"),
        F.max(F.when(F.col("raw_close").isNotNull(), F.col("date"))).alias("last_date"),
    )
    return g.withColumn("coverage_before", ratio(F.col("raw_valid_days"), F.col("expected_days"))).withColumn("coverage_after", ratio(F.col("valid_days"), F.col("expected_days")))


def keep_by_coverage(cover: DataFrame, least: float = 0.90, after_fill: bool = True) -> DataFrame:
    """Adds kept and reason."""
    c = F.col("coverage_after" if after_fill else "coverage_before")
    return cover.withColumn("kept", c >= least).withColumn("reason", F.when(c >= least, "kept").when(F.col("raw_valid_days") == 0, "download_failed").otherwise("coverage_below_threshold"))


def common_days(df: DataFrame) -> DataFrame:
    """Rows of the days on which every ticker has a close."""
    have = df.where("close is not null")
    n = have.agg(F.countDistinct("ticker").alias("_n"))
    full = have.groupBy("date").agg(F.count("*").alias("_c")).crossJoin(F.broadcast(n)).where("_c = _n").select("date")
    return have.join(full, "date", "left_semi")


def clean_panel(panel: DataFrame, limit: int = 2, least: float = 0.90, after_fill: bool = True) -> DataFrame:
    """Reindex, fill, drop tickers of low coverage, keep common days."""
    filled = forward_fill(reindex(panel), limit)
    kept = keep_by_coverage(coverage(filled), least, after_fill).where("kept").select("ticker")
    return common_days(filled.join(kept, "ticker", "left_semi")).select("date", "ticker", "sector", "close")


def quality_report(panel: DataFrame, limit: int = 2, least: float = 0.90, jump: float = 0.5, after_fill: bool = True) -> DataFrame:
    """One row per ticker: dates, days, coverages, filled days, duplicates, invalid prices, jumps, decision."""
    good = finite_prices(panel)
    counts = panel.groupBy("ticker").agg(F.count("*").alias("input_rows"), F.countDistinct("date").alias("dates")).select("ticker", (F.col("input_rows") - F.col("dates")).alias("duplicate_count"))
    bad = panel.groupBy("ticker").agg(F.count_if(~F.coalesce((F.expr("try_cast(close as double)") > 0) & (F.expr("try_cast(close as double)") < float("inf")), F.lit(False))).alias("invalid_price_count"))
    filled = forward_fill(reindex(good), limit)
    jumps = anomalies(filled, jump).groupBy("ticker").agg(F.count("*").alias("anomaly_count"))
    c = keep_by_coverage(coverage(filled), least, after_fill)
    c = c.join(counts, "ticker", "left").join(bad, "ticker", "left").join(jumps, "ticker", "left")
    return c.withColumn("filled_days", F.col("valid_days") - F.col("raw_valid_days")).withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0).cast("bigint")))


def anomalies(df: DataFrame, jump: float = 0.5) -> DataFrame:
    """Rows whose log return exceeds ``jump`` in size."""
    r = F.log("close") - F.lag(F.log("close")).over(W.partitionBy("ticker").orderBy("date"))
    return df.withColumn("log_return", r).where(F.abs("log_return") > jump)


def with_lookup(df: DataFrame, pairs: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """Left join on a lookup; missing gives ``default``."""
    return df.join(pairs.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def business_days(spark, first: str, last: str) -> DataFrame:
    """Weekdays of a closed range."""
    d = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as date")
    return d.where("weekday(date) < 5")


def regime_for(df: DataFrame, events: DataFrame, default: str) -> DataFrame:
    """name: that of the first interval (by no) that holds the date. events: no, name, start_date, end_date, a few rows."""
    e = events.select("no", F.col("name").alias("_name"), "start_date", "end_date")
    j = df.join(F.broadcast(e), (df["date"] >= e["start_date"]) & (df["date"] <= e["end_date"]), "left")
    return j.groupBy(*df.columns).agg(F.coalesce(F.min_by("_name", "no"), F.lit(default)).alias("regime"))
