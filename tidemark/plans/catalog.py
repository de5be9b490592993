"""Registered queries of the panel operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats, tickers
from ..functions.stats import rounded
from ..operators import cleaning, cluster, embed, evaluate, labels, predict, ranking, returns, windows
from ..session import tabled
from ..sources import archive, simulate
from ..sources.panel import labelled_points, price_panel, table
from .base_sql import SIZE, STEP, six, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FOCUS, EDGE = "AFRICA", 0.3
WINDOW_METRICS = ["mean_correlation", "median_correlation", "mean_distance", "market_volatility", "dispersion"]
ASSET_FEATURES = ["return_1y", "volatility_1y", "momentum_6m", "max_drawdown_1y"]
#: Events in the time of the test tables.
EVENTS = [("first", "1993-02-01", "1993-04-30"), ("second", "1994-05-01", "1994-12-31"), ("third", "1996-01-01", "1996-06-30"), ("late", "1998-06-01", "1998-12-31")]


def query(oracle: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(rounded(c).alias(c) if c in columns else F.col(c) for c in df.columns))


# ---------------------------------------------------------------- shared stages, lazily composed


def _panel(s, d):
    """The one stage that reads the large tables; everything after it is of the size of the panel."""
    return tabled(price_panel(s, d), "panel")


def _clean(s, d):
    return tabled(cleaning.clean_panel(_panel(s, d)), "clean")


def _returns(s, d):
    """ord, date, ticker, sector, ret: winsorised log returns of the cleaned panel; small, and used several times."""
    r = returns.winsorize(returns.log_returns(_clean(s, d)), ["ret"], 0.005, 0.995)
    return tabled(returns.with_ord(r).select("ord", "date", "ticker", "sector", "ret"), "returns")


def _expanded(s, d):
    return windows.expand(_returns(s, d), SIZE, STEP)


def _pairs(s, d):
    return windows.pair_correlations_by_blocks(_returns(s, d), SIZE, STEP)


def _metrics(s, d):
    return tabled(windows.structure(_returns(s, d), SIZE, STEP), "metrics")


def _snapshots(s, d):
    return windows.snapshots(_clean(s, d), SIZE, STEP, FOCUS, threshold=EDGE, hold=tabled)


def _labelled(s, d):
    return tabled(_snapshots(s, d).withColumn("label", F.quarter("end_date")), "labelled")


def _assets(s, d):
    return tabled(returns.asset_features(_clean(s, d)), "assets")


def _profile(s, d):
    clean = _clean(s, d)
    a = returns.asset_features(clean).join(clean.select("ticker", F.col("sector").alias("label")).distinct(), "ticker")
    return a.withColumn("ord", F.row_number().over(W.orderBy("ticker")))


def _events(s, d):
    v = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, -F.col("value")).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", F.to_date("ts").alias("date"), F.col("event_type").alias("ticker"), "user_id", v.alias("close"))


def _event_table(s):
    return s.createDataFrame([(i, *e) for i, e in enumerate(EVENTS)], "no int, name string, a string, b string").select("no", "name", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"))


_EVENT_CTE = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, (n, a, b) in enumerate(EVENTS)) + ") t(no, name, start_date, end_date)"


# ---------------------------------------------------------------- A: sources


@query("""SELECT page_id, CASE t WHEN 'BRK-B' THEN 'BRK.B' WHEN 'BRKB' THEN 'BRK.B' WHEN 'BF-B' THEN 'BF.B' WHEN 'BFB' THEN 'BF.B' ELSE t END AS ticker
FROM (SELECT page_id, replace(regexp_replace(upper(trim(regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', ''))), '\\.US$', ''), '_', '-') AS t FROM pages)""")
def a2_ticker_from_member(s, d):
    return table(s, d, "pages").select("page_id", tickers.ticker_from_member(F.col("url")).alias("ticker"))


@query("""SELECT lower(regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]+)$', 1)) AS extension, count(*) AS n FROM pages GROUP BY 1""")
def a5_extension_histogram(s, d):
    return archive.extension_histogram(table(s, d, "pages"), "url")


@query("SELECT CAST(len(string_split(url, '/')) AS BIGINT) AS depth, count(*) AS n FROM pages GROUP BY 1")
def a5_depth_histogram(s, d):
    return archive.depth_histogram(table(s, d, "pages"), "url")


@query("""SELECT directory, count(*) AS n FROM (
  SELECT unnest([array_to_string(p[1:k], '/') for k in range(1, least(len(p) - 1, 3) + 1)]) AS directory FROM (SELECT string_split(url, '/') AS p FROM pages))
GROUP BY directory ORDER BY n DESC, directory LIMIT 30""")
def a5_directory_histogram(s, d):
    return archive.directory_histogram(table(s, d, "pages"), "url")


_MEMBERS = "SELECT concat('data/', CASE WHEN p_size % 3 = 0 THEN 'stocks' ELSE 'etfs' END, '/', lower(replace(p_brand, '#', '_')), '/', p_size, '.us.', CASE WHEN p_partkey % 5 = 0 THEN 'md' ELSE 'txt' END) AS source_member, p_size, p_partkey FROM part"


def _members(s, d):
    p = table(s, d, "part")
    name = F.concat(F.lit("data/"), F.when(F.col("p_size") % 3 == 0, "stocks").otherwise("etfs"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.col("p_size").cast("string"), F.lit(".us."), F.when(F.col("p_partkey") % 5 == 0, "md").otherwise("txt"))
    return p.select(name.alias("source_member"), F.col("p_size").cast("long").alias("member_size"))


@query(sql("SELECT source_member, count(*) AS n, CAST(p_size AS VARCHAR) AS filename_ticker FROM members WHERE source_member LIKE '%.txt' GROUP BY ALL", members=_MEMBERS))
def a7_member_index(s, d):
    return archive.member_index(_members(s, d)).groupBy("source_member", "filename_ticker").agg(F.count("*").alias("n"))


@query(sql("SELECT count(*) AS members, CAST(sum(p_size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE source_member LIKE '%.txt') AS text_members, CAST(max(len(string_split(source_member, '/'))) AS BIGINT) AS max_depth FROM members", members=_MEMBERS))
def a5_inspection(s, d):
    return archive.inspect(_members(s, d))


@query(sql("""SELECT project_ticker, source_member, source_member IS NOT NULL AS matched, CASE WHEN source_member IS NULL THEN 'no_member' ELSE 'matched' END AS reason FROM (
  SELECT r.project_ticker, m.source_member, row_number() OVER (PARTITION BY r.project_ticker ORDER BY m.source_member IS NULL, NOT contains(lower(m.source_member), 'stocks'), m.source_member) AS k
  FROM requested r LEFT JOIN (SELECT DISTINCT source_member, p_size FROM members WHERE source_member LIKE '%.txt') m ON CAST(m.p_size AS VARCHAR) = r.alias) WHERE k = 1""",
    members=_MEMBERS, requested="SELECT CAST(n AS VARCHAR) AS project_ticker, CAST(n AS VARCHAR) AS alias FROM range(1, 61) t(n) UNION ALL SELECT CAST(n AS VARCHAR), CAST(n + 30 AS VARCHAR) FROM range(1, 61) t(n)"))
def a8_match_members(s, d):
    wanted = s.range(1, 61).select(F.col("id").cast("string").alias("ticker"), F.array(F.col("id").cast("string"), F.concat((F.col("id") + 30).cast("string"), F.lit(".us"))).alias("aliases"))
    return archive.match_members(wanted, archive.member_index(_members(s, d)).select("source_member", "filename_ticker").distinct())


_LINES = """SELECT concat('m', l_suppkey % 20) AS member, l_orderkey * 10 + l_linenumber AS line_no,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
  CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN -1.0 ELSE l_quantity END AS close FROM lineitem"""


def _lines(s, d):
    l = table(s, d, "lineitem")
    day = F.when(F.col("l_linenumber") == 7, "2020-13-45").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    price = F.when(F.col("l_quantity") < 3, "n/a").when(F.col("l_quantity") < 5, "-1").otherwise(F.col("l_quantity").cast("string"))
    return l.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 20).cast("string")).alias("member"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat_ws(",", F.lit("aapl.us"), F.lit("D"), day, F.lit("000000"), F.lit("1"), F.lit("2"), F.lit("1"), price, F.lit("100"), F.lit("0")).alias("value"))


@query(sql("""SELECT member, 'AAPL' AS ticker, date, close, line_no FROM (SELECT *, row_number() OVER (PARTITION BY member, date ORDER BY line_no DESC) AS k FROM lines WHERE date IS NOT NULL AND close > 0) WHERE k = 1""", lines=_LINES))
def a9_parse_members(s, d):
    return archive.parse_members(_lines(s, d))[0].select("member", "ticker", "date", "close", "line_no")


@query(sql("""SELECT member, count(*) FILTER (WHERE date IS NULL) AS invalid_date_count, count(*) FILTER (WHERE date IS NOT NULL AND coalesce(close, -1) <= 0) AS invalid_price_count,
  count(*) FILTER (WHERE date IS NOT NULL AND close > 0) - count(DISTINCT date) FILTER (WHERE date IS NOT NULL AND close > 0) AS duplicate_count FROM lines GROUP BY member""", lines=_LINES))
def a9_parse_statistics(s, d):
    return archive.parse_members(_lines(s, d))[1]


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS date, 'A' AS ticker, o_totalprice AS close, CAST(o_custkey AS DOUBLE) AS volume FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'B', o_totalprice * 2, CAST(o_custkey + 1 AS DOUBLE) FROM orders""")
def a10_normalize_vendor(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("date"), F.col("o_totalprice").alias("Close_A"), (F.col("o_totalprice") * 2).alias("Close_B"), F.col("o_custkey").cast("double").alias("Volume_A"), (F.col("o_custkey") + 1).cast("double").alias("Volume_B"))
    return archive.normalize_vendor(o, {"Close": ["Close_A", "Close_B"], "Volume": ["Volume_A", "Volume_B"]})


@query(sql("SELECT ticker, count(*) AS n, round(sum(ln(close)), 6) AS log_sum FROM panel WHERE ticker IN (SELECT ticker FROM panel GROUP BY ticker HAVING count(*) = (SELECT count(DISTINCT date) FROM panel)) GROUP BY ticker"))
def a12_complete_series(s, d):
    return archive.complete_series(_panel(s, d)).groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum(F.log("close")), 6).alias("log_sum"))


@query()
def a13_simulated_panel(s, d):
    return simulate.panel(s)


@query("""WITH v AS (SELECT upper(trim(p_brand)) AS ticker, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, p_partkey FROM part WHERE p_size % 7 <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p_partkey) AS k FROM v) WHERE k = 1),
q AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b, quantile_cont(size, 0.01) AS c, quantile_cont(size, 0.99) AS e FROM f)
SELECT ticker, round(greatest(least(price, b), a), 4) AS price, round(greatest(least(size, e), c), 4) AS size FROM f CROSS JOIN q""")
def a14_first_valid_features(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("ticker"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_size").cast("double")).alias("size"), "p_partkey")
    f = returns.winsorize(archive.first_valid(p, "ticker", ["price", "size"], "p_partkey"), ["price", "size"], 0.01, 0.99)
    return f.select("ticker", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"))


# ---------------------------------------------------------------- B: cleaning


@query(sql("SELECT event_id, date, ticker, close FROM ev WHERE close > 0"))
def b1_positive_prices(s, d):
    return cleaning.positive_prices(_events(s, d)).select("event_id", "date", "ticker", "close")


@query(sql("SELECT ticker, count(*) FILTER (WHERE NOT coalesce(close > 0, FALSE)) AS rejected, count(*) FILTER (WHERE close > 0) AS kept FROM ev GROUP BY ticker"))
def b2_finite_mask(s, d):
    ok = F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    return _events(s, d).groupBy("ticker").agg(F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("kept"))


@query(sql("SELECT event_id, date, ticker, close FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY event_id DESC) AS k FROM ev WHERE close > 0) WHERE k = 1"))
def b3_keep_last(s, d):
    return cleaning.keep_last(cleaning.positive_prices(_events(s, d)), ["date", "ticker"], "event_id").select("event_id", "date", "ticker", "close")


@query(sql("SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM ev GROUP BY date, ticker, user_id)"))
def b4_duplicate_rows(s, d):
    return cleaning.duplicate_rows(_events(s, d), ["date", "ticker", "user_id"])


@query("""SELECT p_partkey, CASE t WHEN 'BRK-B' THEN 'BRK.B' WHEN 'BRKB' THEN 'BRK.B' WHEN 'BF-B' THEN 'BF.B' WHEN 'BFB' THEN 'BF.B' ELSE t END AS ticker FROM (
SELECT p_partkey, replace(regexp_replace(upper(trim(n)), '\\.US$', ''), '_', '-') AS t FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' brk_b.us' WHEN 1 THEN 'bfb' ELSE concat(p_brand, '.us ') END AS n FROM part))""")
def b5_normalize_ticker(s, d):
    raw = F.when(F.col("p_size") % 4 == 0, " brk_b.us").when(F.col("p_size") % 4 == 1, "bfb").otherwise(F.concat("p_brand", F.lit(".us ")))
    return table(s, d, "part").select("p_partkey", tickers.normalize_ticker(raw).alias("ticker"))


@query("SELECT p_partkey, replace(upper(concat(p_brand, '.b')), '.', '-') AS ticker FROM part")
def b6_vendor_ticker(s, d):
    return table(s, d, "part").select("p_partkey", tickers.vendor_ticker(F.concat("p_brand", F.lit(".b"))).alias("ticker"))


@query(sql("SELECT event_id, ticker FROM ev WHERE ticker IN (SELECT min(ticker) FROM ev UNION SELECT max(ticker) FROM ev)"))
def b7_universe(s, d):
    e = _events(s, d)
    u = e.agg(F.min("ticker").alias("a"), F.max("ticker").alias("b")).select(F.explode(F.array("a", "b")).alias("ticker")).distinct()
    return cleaning.in_universe(e, u).select("event_id", "ticker")


@query(sql("SELECT date, ticker, round(ln(close), 6) AS log_close FROM panel WHERE date >= (SELECT greatest(min(date), max(date) - INTERVAL 2 YEAR) FROM panel)"))
def b8_look_back(s, d):
    return cleaning.look_back(_panel(s, d), 2).select("date", "ticker", F.round(F.log("close"), 6).alias("log_close"))


@query(sql("SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS ord FROM days"))
def b9_trading_days(s, d):
    return cleaning.trading_days(_panel(s, d))


@query(sql("SELECT ticker, date, raw_close IS NULL AS missing FROM spine"))
def b10_reindex(s, d):
    return cleaning.reindex(_panel(s, d)).select("ticker", "date", F.col("close").isNull().alias("missing"))


@query(sql("SELECT ticker, date, round(ln(close), 6) AS log_close, raw_close IS NULL AND close IS NOT NULL AS was_filled FROM filled"))
def b11_forward_fill(s, d):
    f = cleaning.forward_fill(cleaning.reindex(_panel(s, d)))
    return f.select("ticker", "date", F.round(F.log("close"), 6).alias("log_close"), (F.col("raw_close").isNull() & F.col("close").isNotNull()).alias("was_filled"))


@query(sql("SELECT ticker, round(coverage_before, 6) AS coverage_before, round(coverage_after, 6) AS coverage_after, CASE WHEN coverage_after >= 0.9 THEN TRUE ELSE FALSE END AS kept, CASE WHEN coverage_after >= 0.9 THEN 'kept' WHEN raw_valid_days = 0 THEN 'download_failed' ELSE 'coverage_below_threshold' END AS reason FROM cover"))
def b12_b13_coverage(s, d):
    c = cleaning.keep_by_coverage(cleaning.coverage(cleaning.forward_fill(cleaning.reindex(_panel(s, d)))))
    return _six(c.select("ticker", "coverage_before", "coverage_after", "kept", "reason"), "coverage_before", "coverage_after")


_QUALITY = """SELECT c.ticker, sector, expected_days, raw_valid_days, valid_days, valid_days - raw_valid_days AS filled_days, first_date, last_date,
  round(coverage_before, 6) AS coverage_before, round(coverage_after, 6) AS coverage_after, coalesce(a.n, 0) AS anomaly_count,
  CAST(0 AS BIGINT) AS duplicate_count, CAST(0 AS BIGINT) AS invalid_price_count, {c} >= {least} AS kept,
  CASE WHEN {c} >= {least} THEN 'kept' WHEN raw_valid_days = 0 THEN 'download_failed' ELSE 'coverage_below_threshold' END AS reason
FROM cover c LEFT JOIN (SELECT ticker, count(*) AS n FROM (SELECT ticker, abs(ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM filled) WHERE r > 0.5 GROUP BY ticker) a ON a.ticker = c.ticker"""


def _quality(s, d, least, after):
    q = cleaning.quality_report(_panel(s, d), least=least, after_fill=after)
    return _six(q.select("ticker", "sector", "expected_days", "raw_valid_days", "valid_days", "filled_days", "first_date", "last_date", "coverage_before", "coverage_after", "anomaly_count", "duplicate_count", "invalid_price_count", "kept", "reason"), "coverage_before", "coverage_after")


@query(sql(_QUALITY.format(c="coverage_after", least=0.9)))
def b14_quality_report(s, d):
    return _quality(s, d, 0.9, True)


@query(sql(_QUALITY.format(c="coverage_before", least=0.95)))
def b15_vendor_quality_report(s, d):
    return _quality(s, d, 0.95, False)


@query(sql("SELECT date, ticker, sector, round(ln(close), 6) AS log_close FROM cleaned"))
def b16_common_days(s, d):
    return _clean(s, d).select("date", "ticker", "sector", F.round(F.log("close"), 6).alias("log_close"))


@query(sql("SELECT date, ticker, round(r, 6) + 0.0 AS log_return FROM (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS r FROM cleaned) WHERE abs(r) > 0.3"))
def b17_anomalies(s, d):
    return cleaning.anomalies(_clean(s, d), 0.3).select("date", "ticker", rounded("log_return").alias("log_return"))


@query(sql("SELECT date, round(ln(max(close) FILTER (WHERE ticker = 'NATION_3')), 6) AS NATION_3, round(ln(max(close) FILTER (WHERE ticker = 'NATION_8')), 6) AS NATION_8 FROM cleaned GROUP BY date"))
def b18_pivot(s, d):
    p = _clean(s, d).groupBy("date").pivot("ticker", ["NATION_3", "NATION_8"]).agg(F.first("close"))
    return p.select("date", *(F.round(F.log(c), 6).alias(c) for c in ("NATION_3", "NATION_8")))


@query(sql("SELECT e.event_id, coalesce(l.sector, 'Unknown') AS sector FROM ev e LEFT JOIN (SELECT DISTINCT ticker, upper(ticker) AS sector FROM ev WHERE ticker < 'm') l ON l.ticker = e.ticker"))
def b19_lookup(s, d):
    e = _events(s, d)
    pairs = e.where("ticker < 'm'").select("ticker", F.upper("ticker").alias("sector")).distinct()
    return cleaning.with_lookup(e, pairs, "ticker", "sector").select("event_id", "sector")


@query(sql("SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, count(*) AS n, min(date) AS first_date, max(date) AS last_date, (SELECT count(*) FROM days) - count(DISTINCT date) AS dropped_dates FROM cleaned"))
def b20_summary(s, d):
    days = _panel(s, d).agg(F.countDistinct("date").alias("all_dates"))
    g = _clean(s, d).agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return g.crossJoin(F.broadcast(days)).withColumn("dropped_dates", F.col("all_dates") - F.col("dates")).drop("all_dates")


@query("SELECT CAST(x AS DATE) AS date FROM range(DATE '2020-01-01', DATE '2020-12-31' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5")
def b21_business_days(s, d):
    return cleaning.business_days(s, "2020-01-01", "2020-12-31")


@query(sql("SELECT d.date, coalesce((SELECT min_by(name, no) FROM named n WHERE d.date BETWEEN n.start_date AND n.end_date), 'none') AS regime FROM days d", named=_EVENT_CTE))
def b22_regime_for(s, d):
    return cleaning.regime_for(_panel(s, d).select("date").distinct(), _event_table(s), "none")


@query(sql("SELECT ticker, CAST(max(date) + INTERVAL 1 DAY AS DATE) AS end_exclusive FROM panel GROUP BY ticker"))
def b23_end_exclusive(s, d):
    return _panel(s, d).groupBy("ticker").agg(F.date_add(F.max("date"), 1).alias("end_exclusive"))


# ---------------------------------------------------------------- C: returns


@query(sql("SELECT date, ticker, round(ret, 6) + 0.0 AS ret FROM logret"))
def c1_log_return(s, d):
    return returns.log_returns(_clean(s, d)).select("date", "ticker", rounded("ret").alias("ret"))


@query(sql("SELECT date, ticker, round(ret, 6) + 0.0 AS ret FROM simret"))
def c2_simple_return(s, d):
    return returns.simple_returns(_clean(s, d)).select("date", "ticker", rounded("ret").alias("ret"))


@query(sql("SELECT ord, ticker, round(ret, 6) + 0.0 AS ret FROM ret"))
def c3_winsorized_returns(s, d):
    return _returns(s, d).select("ord", "ticker", rounded("ret").alias("ret"))


@query(sql("SELECT ticker, round(least(min(close / peak - 1), 0), 6) + 0.0 AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM cleaned) GROUP BY ticker"))
def c4_max_drawdown(s, d):
    return _six(returns.max_drawdown(_clean(s, d), ["ticker"], "date", "close"), "max_drawdown")


@query(sql("SELECT ticker, date, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)), 6) AS level FROM simret"))
def c5_cumulative(s, d):
    return returns.cumulative(returns.simple_returns(_clean(s, d)), ["ticker"], "date").select("ticker", "date", F.round("level", 6).alias("level"))


@query(sql("SELECT ticker, round(coalesce(stddev_samp(ret), 0), 6) AS sd, count(*) AS n FROM simret WHERE ticker < 'NATION_2' OR date = (SELECT max(date) FROM simret) GROUP BY ticker"))
def c6_safe_stdev(s, d):
    r = returns.simple_returns(_clean(s, d))
    last = r.agg(F.max("date").alias("m"))
    r = r.crossJoin(F.broadcast(last)).where("ticker < 'NATION_2' or date = m")
    return r.groupBy("ticker").agg(F.round(stats.safe_stddev(F.col("ret")), 6).alias("sd"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(coalesce(quantile_cont(l_extendedprice, 0.1), 0), 3) AS p10, round(coalesce(quantile_cont(l_extendedprice, 0.95), 0), 3) AS p95 FROM lineitem GROUP BY l_returnflag")
def c7_percentile(s, d):
    p = lambda q: F.round(F.coalesce(F.percentile("l_extendedprice", F.lit(q)), F.lit(0.0)), 3)
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(p(0.1).alias("p10"), p(0.95).alias("p95"))


_CLIPPED = "SELECT ticker, " + ", ".join(f"greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM assets)), (SELECT quantile_cont({c}, 0.01) FROM assets)) AS {c}" for c in ASSET_FEATURES) + " FROM assets"


@query(sql(f"SELECT ticker, {six(*ASSET_FEATURES)} FROM clipped", clipped=_CLIPPED))
def c8_column_winsorize(s, d):
    return _six(returns.winsorize(_assets(s, d), ASSET_FEATURES, 0.01, 0.99).select("ticker", *ASSET_FEATURES), *ASSET_FEATURES)


@query(sql("SELECT ticker, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM assets)) / coalesce(nullif((SELECT stddev_samp({c}) FROM assets), 0), 1), 6) + 0.0 AS {c}" for c in ASSET_FEATURES) + " FROM assets"))
def c9_standardize(s, d):
    return _six(returns.standardize(_assets(s, d), ASSET_FEATURES).select("ticker", *ASSET_FEATURES), *ASSET_FEATURES)


@query(sql("SELECT window_ord, ord, ticker, round(coalesce((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 0), 5) + 0.0 AS z FROM win WINDOW w AS (PARTITION BY window_ord, ticker)"))
def c10_window_standardize(s, d):
    return windows.standardized(_expanded(s, d)).select("window_ord", "ord", "ticker", rounded("z", 5).alias("z"))


@query("SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)), 6) AS s_acctbal FROM supplier")
def c11_min_max(s, d):
    return _six(ranking.range_scale(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]), "s_acctbal")


@query("SELECT s_suppkey, 10.0 AS same, round(20 + 60 * (s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)), 6) AS y FROM supplier")
def c12_range_scale(s, d):
    p = table(s, d, "supplier").select("s_suppkey", F.lit(3.0).alias("same"), F.col("s_acctbal").alias("y"))
    return _six(ranking.range_scale(ranking.range_scale(p, ["y"], 20.0, 80.0), ["same"], 0.0, 20.0), "y")


# ---------------------------------------------------------------- D: rolling structure


@query(sql("SELECT window_ord, lo, hi, start_date, end_date FROM wtab"))
def d1_windows(s, d):
    return windows.window_table(_returns(s, d), SIZE, STEP)


@query(sql("SELECT window_ord, ord, ticker, round(ret, 6) + 0.0 AS ret FROM win"))
def d2_expansion(s, d):
    return _expanded(s, d).select("window_ord", "ord", "ticker", rounded("ret").alias("ret"))


@query(sql("SELECT window_ord, t1, t2, round(corr, 5) + 0.0 AS corr FROM pairs"))
def d3_pair_correlation(s, d):
    return _pairs(s, d).select("window_ord", "t1", "t2", rounded("corr", 5).alias("corr"))


@query(sql("SELECT window_ord, t1, t2, round(corr, 5) + 0.0 AS corr FROM pairs"))
def d3_pair_correlation_expanded(s, d):
    return windows.pair_correlations(_expanded(s, d)).select("window_ord", "t1", "t2", rounded("corr", 5).alias("corr"))


@query(sql("SELECT window_ord, t1, t2, round(dist, 5) + 0.0 AS dist FROM dist"))
def d4_correlation_distance(s, d):
    return windows.with_distance(_pairs(s, d)).select("window_ord", "t1", "t2", rounded("dist", 5).alias("dist"))


@query(sql(f"SELECT window_ord, {six('mean_correlation', 'median_correlation', 'mean_distance')} FROM corrs"))
def d5_d6_correlation_summary(s, d):
    return _six(windows.correlation_summary(_pairs(s, d)), "mean_correlation", "median_correlation", "mean_distance")


@query(sql(f"SELECT window_ord, {six('market_volatility')} FROM wvol"))
def d7_market_volatility(s, d):
    return _six(windows.market_volatility(_expanded(s, d)), "market_volatility")


@query(sql(f"SELECT window_ord, {six('dispersion')} FROM wvol"))
def d8_dispersion(s, d):
    return _six(windows.dispersion(_expanded(s, d)), "dispersion")


@query()
def d9_pca_ratio(s, d):
    return embed.pca_ratio(_expanded(s, d))


_XY = "SELECT window_ord, ticker, avg(ret) AS x, coalesce(stddev_samp(ret), 0) AS y FROM win GROUP BY ALL"


@query(sql("SELECT a.window_ord, round(avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 6) AS mean_pairwise_distance FROM xy a JOIN xy b ON a.window_ord = b.window_ord AND a.ticker < b.ticker GROUP BY ALL", xy=_XY))
def d10_mean_pairwise_distance(s, d):
    xy = _expanded(s, d).groupBy("window_ord", "ticker").agg(F.avg("ret").alias("x"), stats.safe_stddev(F.col("ret")).alias("y"))
    return _six(embed.mean_pairwise_distance(xy), "mean_pairwise_distance")


@query(sql("SELECT window_ord, ticker, round(coalesce(stddev_samp(ret), 0) * sqrt(252), 6) AS stock_volatility FROM win GROUP BY ALL"))
def d11_stock_volatility(s, d):
    return _six(windows.ticker_volatility(_expanded(s, d)), "stock_volatility")


@query()
def d12_mds(s, d):
    return embed.mds(windows.with_distance(_pairs(s, d)))


@query()
def d13_d17_asset_pca(s, d):
    return embed.asset_pca(_expanded(s, d))


@query()
def d14_alignment(s, d):
    return embed.align(embed.mds(windows.with_distance(_pairs(s, d))))


@query(sql("SELECT window_ord, 1.0 AS norm_ratio, 1.0 AS distance_ratio FROM wtab"))
def d15_alignment_diagnostics(s, d):
    a = embed.alignment_diagnostics(tabled(embed.align(embed.mds(windows.with_distance(_pairs(s, d)))), "aligned"))
    return a.select("window_ord", F.round("norm_ratio", 6).alias("norm_ratio"), F.round("distance_ratio", 6).alias("distance_ratio"))


@query()
def d16_linkage_labels(s, d):
    return cluster.window_labels(windows.with_distance(_pairs(s, d)), 6)


@query(sql("""SELECT round(avg(CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) + 0.0 AS silhouette FROM (
  SELECT i, max(m) FILTER (WHERE li = lj) AS a, min(m) FILTER (WHERE li <> lj) AS b FROM (SELECT i, li, lj, avg(d) AS m FROM prs GROUP BY ALL) GROUP BY i)""",
    sym="SELECT t1 AS i, t2 AS j, dist AS d FROM dist WHERE window_ord = 0 UNION ALL SELECT t2, t1, dist FROM dist WHERE window_ord = 0",
    prs="SELECT i, a.sector AS li, j, b.sector AS lj, d FROM sym JOIN names a ON a.ticker = i JOIN names b ON b.ticker = j"))
def d18_safe_silhouette(s, d):
    r = _returns(s, d)
    x = windows.with_distance(windows.pair_correlations_by_blocks(r, SIZE, STEP)).where("window_ord = 0")
    both = x.select(F.col("t1").alias("i"), F.col("t2").alias("j"), F.col("dist").alias("d")).unionByName(x.select(F.col("t2").alias("i"), F.col("t1").alias("j"), F.col("dist").alias("d")))
    names = F.broadcast(r.select("ticker", "sector").distinct())  # of the size of a window's columns
    p = both.join(names.select(F.col("ticker").alias("i"), F.col("sector").alias("li")), "i").join(names.select(F.col("ticker").alias("j"), F.col("sector").alias("lj")), "j")
    return evaluate.silhouettes(p, singleton=0.0).agg(rounded(F.avg("silhouette")).alias("silhouette"))


_ARI = """SELECT round(coalesce((s - e) / nullif((sa + sb) / 2 - e, 0), 1), 6) + 0.0 AS ari FROM (SELECT s, sa, sb, sa * sb / (t * (t - 1) / 2) AS e FROM
  (SELECT sum(n * (n - 1) / 2.0) AS s FROM c), (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)), (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c))"""


@query("WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL) " + _ARI)
def d19_adjusted_rand(s, d):
    return _six(evaluate.adjusted_rand(table(s, d, "labels"), "quality", "toxic"), "ari")


_NMI = """SELECT round(coalesce(mi / nullif((ha + hb) / 2, 0), CASE WHEN ha + hb = 0 THEN 1 ELSE 0 END), 6) + 0.0 AS nmi FROM
  (SELECT sum(c.n / t.t * ln(c.n * t.t / (x.n * y.n))) AS mi FROM c JOIN ca x ON x.a = c.a JOIN cb y ON y.b = c.b, t),
  (SELECT -sum(n / t.t * ln(n / t.t)) AS ha FROM ca, t), (SELECT -sum(n / t.t * ln(n / t.t)) AS hb FROM cb, t)"""
_NMI_CTE = "ca AS (SELECT a, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY a), cb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c) "


@query("WITH c AS (SELECT quality AS a, toxic AS b, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY ALL), " + _NMI_CTE + _NMI)
def d20_mutual_information(s, d):
    return _six(evaluate.normalized_mutual_information(table(s, d, "labels"), "quality", "toxic"), "nmi")


_SIGN = "SELECT window_ord, ticker, CASE WHEN sum(ret) > 0 THEN 1 ELSE 0 END AS lab FROM win GROUP BY ALL"


@query(sql("""SELECT window_ord, round(coalesce((s - sa * sb / p) / nullif((sa + sb) / 2 - sa * sb / p, 0), 1), 6) + 0.0 AS ari FROM (
  SELECT window_ord, sum(n * (n - 1) / 2.0) AS s, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM c x WHERE x.window_ord = c.window_ord GROUP BY a)) AS sa,
  (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM c x WHERE x.window_ord = c.window_ord GROUP BY b)) AS sb, sum(n) * (sum(n) - 1) / 2.0 AS p FROM c GROUP BY window_ord)""",
    lab=_SIGN, c="SELECT x.window_ord, x.lab AS a, y.lab AS b, count(*) AS n FROM lab x JOIN lab y ON y.window_ord + 1 = x.window_ord AND x.ticker = y.ticker GROUP BY ALL"))
def d21_adjacent_rand(s, d):
    x = _expanded(s, d).groupBy("window_ord", "ticker").agg((F.sum("ret") > 0).cast("int").alias("lab"))
    prev = x.select((F.col("window_ord") + 1).alias("window_ord"), "ticker", F.col("lab").alias("before"))
    return _six(evaluate.adjusted_rand(x.join(prev, ["window_ord", "ticker"]), "lab", "before", ("window_ord",)), "ari")


@query(sql("SELECT x.window_ord, y.lab AS prev_label, x.lab AS label, count(*) AS n FROM lab x JOIN lab y ON y.window_ord + 1 = x.window_ord AND x.ticker = y.ticker GROUP BY ALL", lab=_SIGN))
def d23_label_overlaps(s, d):
    x = _expanded(s, d).groupBy("window_ord", "ticker").agg((F.sum("ret") > 0).cast("int").alias("cluster"))
    return embed.overlaps(x)


@query()
def d23_matched_labels(s, d):
    return embed.match_labels(cluster.window_labels(windows.with_distance(_pairs(s, d)), 6))


@query()
def d24_daily_analysis(s, d):
    r = _returns(s, d)
    return embed.align(embed.mds(windows.with_distance(windows.pair_correlations_by_blocks(r, SIZE, 1))))


@query(sql(f"SELECT window_ord, start_date, end_date, {six(*WINDOW_METRICS)} FROM metrics"))
def d25_window_metrics(s, d):
    return _six(_metrics(s, d), *WINDOW_METRICS)


LABEL_SCORES = ["silhouette_score", "adjacent_window_ari", "sector_cluster_ari", "sector_cluster_nmi"]
_PER_WINDOW = """SELECT window_ord, coalesce((s - sa * sb / p) / nullif((sa + sb) / 2 - sa * sb / p, 0), 1) AS ari,
  CASE WHEN ha + hb = 0 THEN 1 ELSE coalesce(mi / nullif((ha + hb) / 2, 0), 0) END AS nmi FROM (
    SELECT window_ord, sum(n * (n - 1) / 2.0) AS s, sum(n / t * ln(n * t / (na * nb))) AS mi, max(t * (t - 1) / 2.0) AS p FROM {c} GROUP BY window_ord)
  JOIN (SELECT window_ord, sum(na * (na - 1) / 2.0) AS sa, -sum(na / t * ln(na / t)) AS ha FROM (SELECT DISTINCT window_ord, a, na, t FROM {c}) GROUP BY window_ord) USING (window_ord)
  JOIN (SELECT window_ord, sum(nb * (nb - 1) / 2.0) AS sb, -sum(nb / t * ln(nb / t)) AS hb FROM (SELECT DISTINCT window_ord, b, nb, t FROM {c}) GROUP BY window_ord) USING (window_ord)"""
_COUNTED = "SELECT *, CAST(sum(n) OVER (PARTITION BY window_ord, a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY window_ord, b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY window_ord) AS DOUBLE) AS t FROM ({}) q"


@query(sql("SELECT w.window_ord, cluster_count, round(sil, 6) + 0.0 AS silhouette_score, round(n.ari, 6) + 0.0 AS adjacent_window_ari, round(x.ari, 6) + 0.0 AS sector_cluster_ari, round(x.nmi, 6) + 0.0 AS sector_cluster_nmi"
    " FROM (SELECT window_ord, count(DISTINCT lab) AS cluster_count FROM lab GROUP BY window_ord) w JOIN sils USING (window_ord) JOIN bysector x USING (window_ord) LEFT JOIN byprev n USING (window_ord)",
    lab="SELECT window_ord, ticker, CASE WHEN sum(ret) > 0 THEN 1 ELSE 0 END AS lab FROM win GROUP BY ALL",
    sym="SELECT window_ord, t1 AS i, t2 AS j, dist AS d FROM dist UNION ALL SELECT window_ord, t2, t1, dist FROM dist",
    sils="""SELECT window_ord, avg(CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS sil FROM (
  SELECT window_ord, i, max(m) FILTER (WHERE li = lj) AS a, min(m) FILTER (WHERE li <> lj) AS b FROM (
    SELECT s.window_ord, i, x.lab AS li, y.lab AS lj, avg(d) AS m FROM sym s JOIN lab x ON x.window_ord = s.window_ord AND x.ticker = i JOIN lab y ON y.window_ord = s.window_ord AND y.ticker = j GROUP BY ALL) GROUP BY ALL) GROUP BY window_ord""",
    csector=_COUNTED.format("SELECT window_ord, n.sector AS a, lab AS b, CAST(count(*) AS DOUBLE) AS n FROM lab JOIN names n USING (ticker) GROUP BY ALL"), bysector=_PER_WINDOW.format(c="csector"),
    cprev=_COUNTED.format("SELECT x.window_ord, x.lab AS a, y.lab AS b, CAST(count(*) AS DOUBLE) AS n FROM lab x JOIN lab y ON y.window_ord + 1 = x.window_ord AND x.ticker = y.ticker GROUP BY ALL"), byprev=_PER_WINDOW.format(c="cprev")))
def d25_label_scores(s, d):
    r = _returns(s, d)
    lab = tabled(windows.expand(r, SIZE, STEP).groupBy("window_ord", "ticker").agg((F.sum("ret") > 0).cast("int").alias("cluster")), "labels")
    far = tabled(windows.with_distance(windows.pair_correlations_by_blocks(r, SIZE, STEP)), "distances")
    return _six(cluster.label_scores(far, lab, r.select("ticker", "sector").distinct()), *LABEL_SCORES)


def _full_metrics(s, d):
    """All sixteen columns: structure, coordinates, clusters and their scores of every window."""
    r = _returns(s, d)
    win = windows.expand(r, SIZE, STEP)
    far = tabled(windows.with_distance(windows.pair_correlations_by_blocks(r, SIZE, STEP)), "distances")
    lab = tabled(cluster.window_labels(far, 6), "labels")
    # alignment is an isometry: distances of raw and aligned coordinates are the same
    out = windows.structure(r, SIZE, STEP).join(embed.pca_ratio(win).withColumnRenamed("pc1_ratio", "pca_first_component_ratio"), "window_ord")
    out = out.join(embed.mean_pairwise_distance(embed.mds(far), "x_raw", "y_raw"), "window_ord")
    projected = embed.asset_pca(win).groupBy("window_ord").agg(F.first("ratio").alias("pca_stock_projection_pc1_ratio"))
    return out.join(cluster.label_scores(far, lab, r.select("ticker", "sector").distinct()), "window_ord").join(projected, "window_ord")


@query()
def d25_full_window_metrics(s, d):
    return _full_metrics(s, d)


# ---------------------------------------------------------------- E: ordering


_PICKS = """SELECT CAST(row_number() OVER (ORDER BY pick) AS INTEGER) AS pick, window_ord FROM (SELECT window_ord, min(pick) AS pick FROM (
  SELECT 0 AS pick, (SELECT window_ord FROM metrics ORDER BY market_volatility DESC, window_ord LIMIT 1) AS window_ord
  UNION ALL SELECT 1, (SELECT window_ord FROM metrics ORDER BY mean_correlation DESC, window_ord LIMIT 1)
  UNION ALL SELECT 2, (SELECT window_ord FROM metrics ORDER BY mean_correlation, window_ord LIMIT 1)
  UNION ALL SELECT row_number() OVER (ORDER BY window_ord DESC) + 2, window_ord FROM metrics) GROUP BY window_ord) ORDER BY pick LIMIT 4"""


@query(sql(_PICKS))
def e1_key_snapshots(s, d):
    return ranking.key_snapshots(_metrics(s, d))


@query(sql("SELECT ticker, round(abs(return_1y) + abs(momentum_6m), 6) AS score FROM assets ORDER BY abs(return_1y) + abs(momentum_6m) DESC, ticker LIMIT 18"))
def e2_signal_labels(s, d):
    return ranking.top_by(_assets(s, d), ranking.signal(), 18, "ticker").select("ticker", F.round("score", 6).alias("score"))


@query(sql("SELECT ticker, round(greatest(abs(return_1y), abs(momentum_6m)), 6) AS score FROM assets ORDER BY greatest(abs(return_1y), abs(momentum_6m)) DESC, ticker LIMIT 15"))
def e3_importance(s, d):
    return ranking.top_by(_assets(s, d), ranking.importance(), 15, "ticker").select("ticker", F.round("score", 6).alias("score"))


@query(sql("""SELECT DISTINCT least(a, b) AS t1, greatest(a, b) AS t2 FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(dd, 9), b) AS k FROM (
  SELECT x.ticker AS a, y.ticker AS b, sqrt(power(x.volatility_1y - y.volatility_1y, 2) + power(x.return_1y - y.return_1y, 2)) AS dd FROM profile x JOIN profile y ON x.label = y.label AND x.ticker <> y.ticker)) WHERE k <= 2"""))
def e5_near_edges(s, d):
    return ranking.near_edges(_profile(s, d).select("ticker", F.col("label").alias("cluster"), F.col("volatility_1y").alias("x"), F.col("return_1y").alias("y")))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def e6_table_sort(s, d):
    return table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey")


@query("SELECT n_name AS ticker FROM nation WHERE contains(n_name, 'ION_1') ORDER BY n_name <> 'ION_1', n_name LIMIT 1")
def e7_search(s, d):
    return ranking.search(table(s, d, "nation").select(F.col("n_name").alias("ticker")), " ion_1 ")


@query("SELECT n_name AS ticker FROM nation WHERE contains(n_name, 'N_2')")
def e7_substring_filter(s, d):
    return ranking.substring_filter(table(s, d, "nation").select(F.col("n_name").alias("ticker")), "n_2")


@query("SELECT round(lo - m, 4) AS low, round(hi + m, 4) AS high FROM (SELECT lo, hi, greatest((hi - lo) * 0.1, 0.05) AS m FROM (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier))")
def e8_axis_limits(s, d):
    return ranking.axis_limits(table(s, d, "supplier"), "s_acctbal").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""SELECT s_suppkey, round(20 + 80 * (greatest(least(s_acctbal, z), a) - a) / (z - a), 6) AS size FROM supplier CROSS JOIN (SELECT quantile_cont(s_acctbal, 0.05) AS a, quantile_cont(s_acctbal, 0.95) AS z FROM supplier)""")
def e8_size_scale(s, d):
    return ranking.size_scale(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 20.0, 100.0).select("s_suppkey", F.round("size", 6).alias("size"))


@query(sql("SELECT ticker, round(coverage_after, 6) AS coverage_after FROM cover ORDER BY coverage_after, ticker"))
def e9_coverage_sort(s, d):
    c = cleaning.coverage(cleaning.forward_fill(cleaning.reindex(_panel(s, d))))
    return c.select("ticker", F.round("coverage_after", 6).alias("coverage_after")).orderBy("coverage_after", "ticker")


# ---------------------------------------------------------------- F: prediction


_FRAME = "SELECT *, row_number() OVER (ORDER BY window_ord) AS row FROM (SELECT window_ord, " + ", ".join(f"lag({c}) OVER (ORDER BY window_ord) AS lag_{c}" for c in WINDOW_METRICS) + ", lead(market_volatility) OVER (ORDER BY window_ord) AS target FROM metrics) WHERE lag_dispersion IS NOT NULL AND target IS NOT NULL"
_LAGS = [f"lag_{c}" for c in WINDOW_METRICS]


def _frame(s, d):
    return predict.split(predict.lag_frame(_metrics(s, d), WINDOW_METRICS, "market_volatility"))


@query(sql(f"SELECT window_ord, row, {six(*_LAGS, 'target')}, row <= greatest(1, floor(0.7 * (SELECT count(*) FROM frame) + 1e-9)) AS train FROM frame", frame=_FRAME))
def f1_f2_lag_frame(s, d):
    return _six(_frame(s, d), *_LAGS, "target").withColumn("row", F.col("row").cast("long")).select("window_ord", "row", *_LAGS, "target", "train")


_NAIVE = "SELECT *, (SELECT max_by(target, row) FROM frame WHERE row <= greatest(1, floor(0.7 * (SELECT count(*) FROM frame) + 1e-9))) AS prediction FROM frame WHERE row > greatest(1, floor(0.7 * (SELECT count(*) FROM frame) + 1e-9))"


@query(sql("SELECT round(avg(abs(target - prediction)), 5) AS mae, round(sqrt(avg(power(target - prediction, 2))), 5) AS rmse, round(1 - sum(power(target - prediction, 2)) / (var_pop(target) * count(*)), 4) AS r2 FROM test", frame=_FRAME, test=_NAIVE))
def f3_f6_naive_scores(s, d):
    return predict.scores(predict.naive(_frame(s, d).cache())).select(F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r2", 4).alias("r2"))


@query()
def f4_f5_models(s, d):
    return predict.compare(_metrics(s, d), WINDOW_METRICS, "market_volatility")


@query(sql("SELECT metric, round(delta, 6) + 0.0 AS delta, CASE WHEN delta > 0 THEN 'rising' WHEN delta < 0 THEN 'falling' ELSE 'flat' END AS direction FROM (UNPIVOT (SELECT " + ", ".join(f"max_by({c}, window_ord) - min_by({c}, window_ord) AS {c}" for c in WINDOW_METRICS) + " FROM metrics) ON " + ", ".join(WINDOW_METRICS) + " INTO NAME metric VALUE delta)"))
def f7_interpretation(s, d):
    return _six(predict.interpretation(_metrics(s, d), WINDOW_METRICS), "delta")


@query()
def f7_structural_label(s, d):
    return predict.structural_label(_full_metrics(s, d))


# ---------------------------------------------------------------- G: market windows


@query(sql(f"SELECT window_ord, window_id, start_date, end_date, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in windows.SNAPSHOT_FEATURES)} FROM snaps"))
def g1_snapshots(s, d):
    x = _snapshots(s, d)
    return x.select("window_ord", "window_id", "start_date", "end_date", *(rounded(c, 5).alias(c) for c in windows.SNAPSHOT_FEATURES))


@query(sql("SELECT window_ord, ticker, round(total, 6) + 0.0 AS total FROM ptotal"))
def g2_window_total_return(s, d):
    p = _clean(s, d)
    days = p.select("date").distinct().withColumn("ord", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))
    x = windows.expand(p.join(days, "date"), SIZE + 1, STEP)
    return x.groupBy("window_ord", "ticker").agg(rounded(F.max_by("close", "ord") / F.min_by("close", "ord") - 1).alias("total"))


@query(sql(f"SELECT window_ord, {six('avg_degree', 'network_density', 'clustering_coefficient')} FROM graph"))
def g9_g11_network(s, d):
    x = _snapshots(s, d)
    return _six(x.select("window_ord", "avg_degree", "network_density", "clustering_coefficient"), "avg_degree", "network_density", "clustering_coefficient")


@query()
def g15_kmeans(s, d):
    return cluster.lloyd(_window_points(s, d), 4).select("id", "label")


@query(sql("SELECT round(avg(sil), 6) + 0.0 AS silhouette FROM (SELECT CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN 1 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS sil FROM (SELECT i, max(m) FILTER (WHERE li = lj) AS a, min(m) FILTER (WHERE li <> lj) AS b FROM (SELECT i, li, lj, avg(d) AS m FROM prs GROUP BY ALL) GROUP BY i))",
    prs="SELECT a.ticker AS i, a.label AS li, b.ticker AS j, b.label AS lj, sqrt(power(a.return_1y - b.return_1y, 2) + power(a.volatility_1y - b.volatility_1y, 2) + power(a.momentum_6m - b.momentum_6m, 2) + power(a.max_drawdown_1y - b.max_drawdown_1y, 2)) AS d FROM profile a JOIN profile b ON a.ticker <> b.ticker"))
def g18_silhouette(s, d):
    p = _profile(s, d).select(F.col("ticker").alias("id"), F.array(*ASSET_FEATURES).alias("x"), "label")
    return _six(evaluate.silhouette(p), "silhouette")


@query(sql("SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((sa.s + sb.s) / CASE WHEN g = 0 THEN 1e-9 ELSE g END) AS r FROM gap a JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = a.other GROUP BY a.label)",
    gap="SELECT x.label, y.label AS other, sqrt(sum(power(x.c - y.c, 2))) AS g FROM cent x JOIN cent y ON x.pos = y.pos AND x.label <> y.label GROUP BY ALL"))
def g19_davies_bouldin(s, d):
    return _six(evaluate.davies_bouldin(labelled_points(s, d)), "davies_bouldin")


@query(sql("SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM (SELECT sum(d2) AS w, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT label) AS DOUBLE) AS k FROM sqd), (SELECT sum(size * power(c - m, 2)) AS b FROM cent JOIN (SELECT pos, avg(v) AS m FROM flat GROUP BY pos) USING (pos))"))
def g20_calinski_harabasz(s, d):
    return _six(evaluate.calinski_harabasz(labelled_points(s, d)), "calinski_harabasz")


@query(sql("SELECT round(sum(d2), 4) AS inertia FROM sqd"))
def g21_inertia(s, d):
    return evaluate.inertia(labelled_points(s, d)).select(F.round("inertia", 4).alias("inertia"))


def _window_points(s, d):
    x = returns.standardize(_snapshots(s, d), windows.SNAPSHOT_FEATURES)
    return tabled(x.select(F.col("window_ord").alias("id"), F.array(*windows.SNAPSHOT_FEATURES).alias("x")), "points")


@query()
def g16_g17_g22_model_grid(s, d):
    return cluster.model_grid(_window_points(s, d), range(2, 7)).drop("labels")


_GRID = "SELECT CAST(p_partkey AS INTEGER) AS grid_ord, CAST(p_size % 6 + 2 AS INTEGER) AS k, round(p_retailprice / 7000, 3) AS silhouette, p_retailprice / 900 AS davies_bouldin, p_retailprice AS calinski_harabasz FROM part"


@query(sql("SELECT grid_ord, k FROM g WHERE k >= least(4, (SELECT max(k) FROM g)) ORDER BY round(silhouette, 6) DESC, round(davies_bouldin, 6), round(calinski_harabasz, 6) DESC, grid_ord LIMIT 1", g=_GRID))
def g23_best_model(s, d):
    g = table(s, d, "part").select(F.col("p_partkey").cast("int").alias("grid_ord"), (F.col("p_size") % 6 + 2).cast("int").alias("k"), F.round(F.col("p_retailprice") / 7000, 3).alias("silhouette"), (F.col("p_retailprice") / 900).alias("davies_bouldin"), F.col("p_retailprice").alias("calinski_harabasz"))
    return cluster.best_model(g).select("grid_ord", "k")


@query()
def g24_components(s, d):
    return embed.two_components(_window_points(s, d))


@query()
def g25_neighbour_layout(s, d):
    return embed.neighbour_layout(_window_points(s, d))


_NAMED = "SELECT label, " + ", ".join(f"avg({c}) AS {c}" for c in windows.SNAPSHOT_FEATURES) + " FROM labelled GROUP BY label"
_REGIME = """SELECT label, concat('Regime ', chr(CAST(64 + row_number() OVER (ORDER BY label) AS INTEGER)), '：', nm, CASE WHEN nth > 1 THEN concat(' ', nth) ELSE '' END) AS regime_name
FROM (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY label) AS nth FROM (SELECT *,
  CASE WHEN market_max_drawdown < -0.14 OR (market_max_drawdown < -0.10 AND market_volatility > 0.32) THEN '危机共振状态'
       WHEN market_volatility > 0.18 AND mean_return < 0 THEN '高波动调整期'
       WHEN technology_minus_market > 0.03 AND mean_return > 0 THEN CASE WHEN market_volatility < 0.18 THEN '低波动科技牛市' ELSE '科技成长驱动阶段' END
       WHEN mean_return > 0.10 THEN '强复苏扩张阶段'
       WHEN mean_return > 0 THEN CASE WHEN mean_correlation < 0.58 AND market_volatility < 0.17 THEN '低波动牛市' ELSE '复苏扩张阶段' END
       ELSE '防御震荡阶段' END AS nm FROM means))"""


@query(sql(_REGIME, means=_NAMED))
def g26_regime_names(s, d):
    return labels.name_regimes(_labelled(s, d), windows.SNAPSHOT_FEATURES)


@query(sql("SELECT l.window_ord, l.end_date, l.label, r.regime_name FROM labelled l JOIN regimes r USING (label)", means=_NAMED, regimes=_REGIME))
def g27_assignments(s, d):
    x = _labelled(s, d)
    return x.join(F.broadcast(labels.name_regimes(x, windows.SNAPSHOT_FEATURES)), "label").select("window_ord", "end_date", "label", "regime_name")


@query(sql("SELECT *, from_label <> to_label AS changed FROM trans"))
def g28_transitions(s, d):
    return labels.transitions(_labelled(s, d))


@query(sql("SELECT from_label, to_label, count(*) AS n FROM trans GROUP BY ALL"))
def g29_transition_counts(s, d):
    return labels.transition_counts(labels.transitions(_labelled(s, d)))


@query(sql("""SELECT name, count(window_ord) AS windows, count(*) FILTER (WHERE before IS NOT NULL AND before <> label) AS changes, coalesce(string_agg(DISTINCT CAST(label AS VARCHAR), ';' ORDER BY CAST(label AS VARCHAR)), '') AS labels
FROM named e LEFT JOIN (SELECT *, lag(label) OVER (ORDER BY window_ord) AS before FROM labelled) w ON abs(date_diff('day', e.start_date, w.end_date)) <= 45 OR w.end_date BETWEEN e.start_date AND e.end_date GROUP BY name""",
    named=_EVENT_CTE))
def g30_event_neighbourhoods(s, d):
    return labels.event_neighbourhoods(_labelled(s, d), _event_table(s))


@query(sql("SELECT t1, t2, round(corr, 5) + 0.0 AS corr FROM (SELECT a.ticker AS t1, b.ticker AS t2, coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0) AS corr FROM lr a JOIN lr b ON a.date = b.date AND a.ticker < b.ticker GROUP BY ALL) WHERE corr > 0.2",
    lastd="SELECT DISTINCT date FROM cleaned ORDER BY date DESC LIMIT 21",
    lr="SELECT * FROM (SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM cleaned WHERE date IN (SELECT date FROM lastd)) WHERE ret IS NOT NULL"))
def g31_latest_network(s, d):
    return labels.latest_network(_clean(s, d), SIZE, above=0.2).select("t1", "t2", rounded("corr", 5).alias("corr"))


@query(sql("SELECT label, count(*) AS n, " + ", ".join(f"round(avg({c}), 5) + 0.0 AS {c}" for c in windows.SNAPSHOT_FEATURES) + " FROM labelled GROUP BY label"))
def g32_profiles(s, d):
    p = labels.profiles(_labelled(s, d), windows.SNAPSHOT_FEATURES)
    return p.select("label", "n", *(rounded(c, 5).alias(c) for c in windows.SNAPSHOT_FEATURES))


# ---------------------------------------------------------------- H: assets


@query(sql("SELECT a.ticker, b.ticker AS other, round(sqrt(power(a.return_1y - b.return_1y, 2) + power(a.volatility_1y - b.volatility_1y, 2)), 6) AS d FROM assets a JOIN assets b ON a.ticker < b.ticker"))
def h1_distances(s, d):
    a = _assets(s, d).select("ticker", F.array("return_1y", "volatility_1y").alias("x"))
    b = a.select(F.col("ticker").alias("other"), F.col("x").alias("y"))
    return a.crossJoin(F.broadcast(b)).where("ticker < other").select("ticker", "other", F.round(stats.distance(F.col("x"), F.col("y")), 6).alias("d"))  # assets only


def _asset_points(s, d):
    a = returns.standardize(returns.winsorize(_assets(s, d), ASSET_FEATURES, 0.01, 0.99), ASSET_FEATURES)
    return tabled(a.select((F.row_number().over(W.orderBy("ticker")) - 1).alias("id"), F.array(*ASSET_FEATURES).alias("x")), "points")


@query()
def h2_h12_asset_clusters(s, d):
    return cluster.lloyd(_asset_points(s, d), 6).select("id", "label")


@query(sql("SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((sa.s + sb.s) / CASE WHEN g = 0 THEN 1e-12 ELSE g END) AS r FROM gap a JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = a.other GROUP BY a.label)",
    gap="SELECT x.label, y.label AS other, sqrt(sum(power(x.c - y.c, 2))) AS g FROM cent x JOIN cent y ON x.pos = y.pos AND x.label <> y.label GROUP BY ALL"))
def h4_davies_bouldin(s, d):
    return _six(evaluate.davies_bouldin(labelled_points(s, d), eps=1e-12), "davies_bouldin")


@query()
def h6_k_values(s, d):
    return cluster.model_grid(_asset_points(s, d), range(2, 13), ("kmeans",), eps=1e-12).drop("labels")


@query(sql("SELECT label, n, " + ", ".join(f"round(avg_{c}, 6) + 0.0 AS avg_{c}" for c in ASSET_FEATURES) + """, representatives,
  CASE WHEN avg_momentum_6m > 0.15 AND avg_return_1y > 0.35 THEN CASE WHEN avg_volatility_1y > 0.28 THEN '高收益高波动动量型' ELSE '高收益稳健动量型' END
       WHEN avg_max_drawdown_1y > -0.14 AND avg_volatility_1y < 0.17 THEN '低波动稳健型'
       WHEN avg_max_drawdown_1y < -0.28 AND avg_volatility_1y > 0.31 THEN CASE WHEN avg_momentum_6m > 0 THEN '高波动修复型' ELSE '高风险下行型' END
       WHEN avg_momentum_6m > 0 AND avg_return_1y < 0 THEN '防御修复型'
       WHEN avg_momentum_6m < 0 AND avg_return_1y < 0.08 AND avg_volatility_1y < 0.18 THEN '低波动承压型'
       WHEN avg_momentum_6m < 0 AND avg_return_1y < 0.05 THEN '弱动量承压型'
       WHEN avg_volatility_1y > 0.24 AND avg_return_1y > 0.18 THEN '成长波动型'
       WHEN avg_max_drawdown_1y < -0.25 AND avg_return_1y < 0 THEN '深度价值反弹型'
       ELSE '均衡核心型' END AS profile_name FROM prof""",
    prof="SELECT label, count(*) AS n, " + ", ".join(f"avg({c}) AS avg_{c}" for c in ASSET_FEATURES) + ", array_to_string(list(ticker ORDER BY ord)[1:8], ', ') AS representatives FROM profile GROUP BY label"))
def h7_h8_profiles(s, d):
    return _six(labels.asset_profiles(_profile(s, d), ASSET_FEATURES), *(f"avg_{c}" for c in ASSET_FEATURES))


@query(sql("SELECT CAST(a.pos - 1 AS INTEGER) AS i, CAST(b.pos - 1 AS INTEGER) AS j, round(sum(a.v * b.v) / (count(*) - 1), 6) + 0.0 AS cov FROM flat a JOIN flat b ON a.id = b.id GROUP BY a.pos, b.pos"))
def h9_covariance(s, d):
    return _six(embed.covariance(labelled_points(s, d)), "cov")


@query()
def h10_h11_asset_components(s, d):
    return embed.two_components(_asset_points(s, d), embed.ASSET_STARTS)


# ---------------------------------------------------------------- J: dashboard


@query(sql("SELECT count(*) AS n, round(avg(return_1y), 6) + 0.0 AS mean_return, round(avg(volatility_1y), 6) AS mean_volatility, round(min(max_drawdown_1y), 6) + 0.0 AS worst_drawdown FROM assets"))
def j1_summary_cards(s, d):
    return _six(ranking.summary_cards(_assets(s, d)), "mean_return", "mean_volatility", "worst_drawdown")


@query()
def j2_dashboard_kmeans(s, d):
    a = ranking.range_scale(_assets(s, d), ASSET_FEATURES)
    p = a.select((F.row_number().over(W.orderBy("ticker")) - 1).alias("id"), F.array(*ASSET_FEATURES).alias("x"))
    return cluster.lloyd(p, 8, rounds=18, first_rows=True, fixed_rounds=True).select("id", "label")


@query(sql("SELECT p.ticker, round(2 * cos(2 * pi() * no / n), 6) + 0.0 AS cx, round(2 * sin(2 * pi() * no / n), 6) + 0.0 AS cy FROM profile p JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM profile)) c USING (label)"))
def j3_ring_layout(s, d):
    return _six(ranking.ring_layout(_profile(s, d), "label", 2.0).select("ticker", "cx", "cy"), "cx", "cy")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '—' ELSE printf('$%.2f', s_acctbal) END AS money, CASE WHEN s_suppkey % 9 = 0 THEN '—' ELSE printf('%.2f%%', s_acctbal / 7000 * 100) END AS share FROM supplier")
def j4_formatters(s, d):
    v = F.when(F.col("s_suppkey") % 9 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    return table(s, d, "supplier").select("s_suppkey", ranking.dollars(v).alias("money"), ranking.percent(v / 7000).alias("share"))


# ---------------------------------------------------------------- L: published statistics


@query(sql("SELECT metric, round(avg(v), 6) + 0.0 AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM (UNPIVOT metrics ON " + ", ".join(WINDOW_METRICS) + " INTO NAME metric VALUE v) GROUP BY metric"))
def l1_describe(s, d):
    m = _metrics(s, d)
    return _six(ranking.describe(m, WINDOW_METRICS), "mean", "sd", "min", "max")


@query(sql("SELECT round(corr(mean_correlation, median_correlation), 5) AS mean_median, round(corr(mean_correlation, mean_distance), 5) AS mean_dist, round(corr(market_volatility, dispersion), 5) AS vol_dispersion FROM metrics"))
def l2_metric_correlations(s, d):
    c = lambda a, b: F.round(stats.guarded_corr(F.col(a), F.col(b)), 5)
    return _metrics(s, d).agg(c("mean_correlation", "median_correlation").alias("mean_median"), c("mean_correlation", "mean_distance").alias("mean_dist"), c("market_volatility", "dispersion").alias("vol_dispersion"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on a small table: monthly panel, short windows, low coverage threshold."""
    p = cleaning.clean_panel(tabled(price_panel(spark, sf_dir, "month"), "panel"), limit=2, least=0.5)
    r = tabled(returns.with_ord(returns.winsorize(returns.log_returns(p), ["ret"], 0.005, 0.995)))
    return _six(windows.structure(r, 6, 2, periods=12.0), *WINDOW_METRICS)
