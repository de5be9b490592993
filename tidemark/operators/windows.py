"""Count-based rolling windows and the relational structure inside them.

Returns carry ord, the ordinal of their date. Window w covers ord in [w * step, w * step + size); a partial last window
is dropped. The windows covering a row are computed from its ordinal, so expansion is one explode with a known factor
and no join with a table of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import guarded_corr, ratio, safe_stddev


def check(size: int, step: int) -> None:
    if size <= 1:
        raise ValueError("a window needs more than one row")
    if step <= 0:
        raise ValueError("the step must be positive")


def expand(returns: DataFrame, size: int, step: int) -> DataFrame:
    """One row per window that covers a row: adds window_ord."""
    check(size, step)
    n = returns.agg((F.max("ord") + 1).alias("_n"))
    r = returns.crossJoin(F.broadcast(n))  # one row
    low = F.greatest(F.lit(0), F.ceil((F.col("ord") - size + 1) / F.lit(step)).cast("int"))
    high = F.least(F.floor(F.col("ord") / F.lit(step)).cast("int"), F.floor((F.col("_n") - size) / F.lit(step)).cast("int"))
    return r.where((low <= high) & (F.col("_n") >= size)).withColumn("window_ord", F.explode(F.sequence(low, high))).drop("_n")


def window_table(returns: DataFrame, size: int, step: int) -> DataFrame:
    """window_ord, lo, hi, start_date, end_date."""
    d = expand(returns.select("ord", "date").distinct(), size, step)
    return d.groupBy("window_ord").agg(F.min("ord").alias("lo"), (F.max("ord") + 1).alias("hi"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def pair_correlations(expanded: DataFrame) -> DataFrame:
    """window_ord, t1 < t2, corr: all pairs, 0 where a side is constant."""
    a = expanded.select("window_ord", "ord", F.col("ticker").alias("t1"), F.col("ret").alias("a"))
    b = expanded.select("window_ord", "ord", F.col("ticker").alias("t2"), F.col("ret").alias("b"))
    return a.join(b, ["window_ord", "ord"]).where("t1 < t2").groupBy("window_ord", "t1", "t2").agg(guarded_corr(F.col("a"), F.col("b")).alias("corr"))


def pair_correlations_by_blocks(returns: DataFrame, size: int, step: int) -> DataFrame:
    """The same from sums over blocks of ``step`` days (``size`` a multiple of it): pairs meet once per day.

    The pair join is smaller by size / step than after expansion; windows add up their blocks in a frame. Returns are
    centred by ticker first, so the sums of squares do not cancel.
    """
    check(size, step)
    if size % step:
        raise ValueError("the window must be a multiple of the step")
    k = size // step
    r = returns.withColumn("x", F.col("ret") - F.avg("ret").over(W.partitionBy("ticker"))).select("ord", "ticker", "x")
    a = r.select("ord", F.col("ticker").alias("t1"), F.col("x").alias("a"))
    b = r.select("ord", F.col("ticker").alias("t2"), F.col("x").alias("b"))
    p = a.join(b, "ord").where("t1 < t2").withColumn("block", F.floor(F.col("ord") / F.lit(step)).cast("int"))
    sums = p.groupBy("t1", "t2", "block").agg(
        F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab")
    )
    w = W.partitionBy("t1", "t2").orderBy("block").rowsBetween(0, k - 1)
    s = sums.select("t1", "t2", F.col("block").alias("window_ord"), *(F.sum(c).over(w).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))).where(F.col("n") == size)
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    tiny = F.lit(1e-18)
    root = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    return s.select("window_ord", "t1", "t2", F.when((va > tiny) & (vb > tiny), (F.col("sab") - F.col("sa") * F.col("sb") / n) / root).otherwise(F.lit(0.0)).alias("corr"))


def with_distance(pairs: DataFrame) -> DataFrame:
    """dist = sqrt(max(0, 2 (1 - corr)))."""
    c = F.greatest(F.least("corr", F.lit(1.0)), F.lit(-1.0))
    return pairs.withColumn("dist", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - c))))


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """Mean and median correlation and mean distance of each window."""
    return with_distance(pairs).groupBy("window_ord").agg(F.avg("corr").alias("mean_correlation"), F.percentile("corr", F.lit(0.5)).alias("median_correlation"), F.avg("dist").alias("mean_distance"))


def market_volatility(expanded: DataFrame, periods: float = 252.0) -> DataFrame:
    """Annualised deviation of the equal-weight return of each window."""
    day = expanded.groupBy("window_ord", "ord").agg(F.avg("ret").alias("m"))
    return day.groupBy("window_ord").agg((safe_stddev(F.col("m")) * F.sqrt(F.lit(periods))).alias("market_volatility"))


def dispersion(expanded: DataFrame) -> DataFrame:
    """Mean over days of the deviation across tickers."""
    day = expanded.groupBy("window_ord", "ord").agg(safe_stddev(F.col("ret")).alias("s"))
    return day.groupBy("window_ord").agg(F.avg("s").alias("dispersion"))


def day_summary(expanded: DataFrame, periods: float = 252.0) -> DataFrame:
    """market_volatility and dispersion from one grouping by day."""
    day = expanded.groupBy("window_ord", "ord").agg(F.avg("ret").alias("m"), safe_stddev(F.col("ret")).alias("s"))
    return day.groupBy("window_ord").agg((safe_stddev(F.col("m")) * F.sqrt(F.lit(periods))).alias("market_volatility"), F.avg("s").alias("dispersion"))


def ticker_volatility(expanded: DataFrame, periods: float = 252.0) -> DataFrame:
    return expanded.groupBy("window_ord", "ticker").agg((safe_stddev(F.col("ret")) * F.sqrt(F.lit(periods))).alias("stock_volatility"))


def standardized(expanded: DataFrame) -> DataFrame:
    """z: standard score of each return within its window and ticker; constants give 0."""
    w = W.partitionBy("window_ord", "ticker")
    return expanded.withColumn("z", ratio(F.col("ret") - F.avg("ret").over(w), F.stddev_samp("ret").over(w)))


def graph_metrics(pairs: DataFrame, nodes: DataFrame, threshold: float = 0.55) -> DataFrame:
    """avg_degree, network_density, clustering_coefficient of the graph corr >= threshold. nodes: window_ord, ticker."""
    e = pairs.where(F.col("corr") >= threshold).select("window_ord", "t1", "t2")
    both = e.unionByName(e.select("window_ord", F.col("t2").alias("t1"), F.col("t1").alias("t2")))
    degree = both.groupBy("window_ord", F.col("t1").alias("ticker")).agg(F.count("*").alias("k"))
    # triangles at each corner: two neighbours of it that are linked
    left, right = both.select("window_ord", F.col("t1").alias("c"), F.col("t2").alias("x")), both.select("window_ord", F.col("t1").alias("c"), F.col("t2").alias("y"))
    wedge = left.join(right, ["window_ord", "c"]).where("x < y")
    tri = wedge.join(e.select("window_ord", F.col("t1").alias("x"), F.col("t2").alias("y")), ["window_ord", "x", "y"]).groupBy("window_ord", F.col("c").alias("ticker")).agg(F.count("*").alias("tri"))
    n = nodes.join(degree, ["window_ord", "ticker"], "left").join(tri, ["window_ord", "ticker"], "left")
    k = F.coalesce("k", F.lit(0))
    local = F.when(k < 2, F.lit(0.0)).otherwise(F.lit(2.0) * F.coalesce("tri", F.lit(0)) / (k * (k - 1)))
    g = n.groupBy("window_ord").agg(F.avg(k.cast("double")).alias("avg_degree"), ratio(F.sum(k).cast("double"), (F.count("*") * (F.count("*") - 1)).cast("double")).alias("network_density"), F.avg(local).alias("clustering_coefficient"))
    return g


def structure(returns: DataFrame, size: int, step: int, periods: float = 252.0) -> DataFrame:
    """The flagship: correlation, volatility and dispersion of every rolling window."""
    x = expand(returns, size, step)
    pairs = pair_correlations_by_blocks(returns, size, step) if size % step == 0 else pair_correlations(x)
    out = window_table(returns, size, step).join(correlation_summary(pairs), "window_ord").join(day_summary(x, periods), "window_ord")
    return out.select("window_ord", "start_date", "end_date", "mean_correlation", "median_correlation", "mean_distance", "market_volatility", "dispersion")


def snapshots(panel: DataFrame, size: int, step: int, focus: str, periods: float = 252.0, threshold: float = 0.55, hold=lambda df: df) -> DataFrame:
    """One row of 16 features per market window: ``size`` + 1 prices, ``size`` simple returns, ``range(0, n - size, step)``.

    hold: called on what several features read (the expanded prices, returns and pairs); pass ``DataFrame.cache`` or a
    function that writes a table, so that each is computed once.
    """
    days = panel.select("date").distinct().withColumn("ord", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))
    p = panel.join(days, "date")
    x = hold(expand(p, size + 1, step))
    w = W.partitionBy("window_ord", "ticker").orderBy("ord")
    r = hold(x.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret is not null"))
    total = hold(x.groupBy("window_ord", "ticker", "sector").agg((F.max_by("close", "ord") / F.min_by("close", "ord") - 1).alias("total")))
    t = total.groupBy("window_ord").agg(F.avg("total").alias("mean_return"), F.percentile("total", F.lit(0.5)).alias("median_return"), safe_stddev(F.col("total")).alias("return_std"))
    day = hold(r.groupBy("window_ord", "ord").agg(F.avg("ret").alias("ret"), safe_stddev(F.col("ret")).alias("s")))
    d = day.groupBy("window_ord").agg((safe_stddev(F.col("ret")) * F.sqrt(F.lit(periods))).alias("market_volatility"), F.avg("s").alias("return_dispersion"))
    up = W.partitionBy("window_ord").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    path = day.withColumn("level", F.exp(F.sum(F.log1p("ret")).over(up))).withColumn("peak", F.max("level").over(up))
    dd = path.groupBy("window_ord").agg(F.least(F.min(F.col("level") / F.col("peak") - 1), F.lit(0.0)).alias("market_max_drawdown"))
    vol = ticker_volatility(r, periods).groupBy("window_ord").agg(safe_stddev(F.col("stock_volatility")).alias("volatility_dispersion"))
    pairs = hold(pair_correlations(r))
    c = pairs.groupBy("window_ord").agg(F.avg("corr").alias("mean_correlation"), safe_stddev(F.col("corr")).alias("correlation_std"))
    g = graph_metrics(pairs, total.select("window_ord", "ticker"), threshold)
    sec = total.groupBy("window_ord", "sector").agg(F.avg("total").alias("m"))
    s = sec.withColumn("a", F.sum(F.abs("m")).over(W.partitionBy("window_ord")))
    share = F.abs("m") / F.when(F.col("a") == 0, F.lit(1.0)).otherwise(F.col("a"))
    s = s.groupBy("window_ord").agg(
        F.sum(share * share).alias("sector_concentration"),
        safe_stddev(F.col("m")).alias("sector_return_std"),
        (F.max("m") - F.min("m")).alias("sector_return_spread"),
        F.coalesce(F.max(F.when(F.col("sector") == focus, F.col("m"))), F.lit(0.0)).alias("_focus"),
    )
    ends = x.groupBy("window_ord").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    out = ends
    for part in (t, d, dd, vol, c, g, s):
        out = out.join(part, "window_ord")
    out = out.withColumn("technology_minus_market", F.col("_focus") - F.col("mean_return")).withColumn("window_id", F.date_format("end_date", "yyyy-MM"))
    return out.select("window_ord", "window_id", "start_date", "end_date", *SNAPSHOT_FEATURES)


#: The features of a market window, in order.
SNAPSHOT_FEATURES = [
    "mean_return",
    "median_return",
    "return_std",
    "market_volatility",
    "market_max_drawdown",
    "return_dispersion",
    "volatility_dispersion",
    "mean_correlation",
    "correlation_std",
    "avg_degree",
    "network_density",
    "clustering_coefficient",
    "sector_concentration",
    "sector_return_std",
    "sector_return_spread",
    "technology_minus_market",
]
