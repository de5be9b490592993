"""Named subqueries that the oracle statements share; an engine only runs those a statement refers to."""

from __future__ import annotations

SIZE, STEP = 20, 5

CTES = {
    "panel": """
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS ticker, r_name AS sector, avg(l_extendedprice) AS close
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "ev": """
  SELECT event_id, CAST(ts AS DATE) AS date, event_type AS ticker, user_id,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value END AS close FROM events""",
    "days": "SELECT DISTINCT date FROM panel",
    "names": "SELECT DISTINCT ticker, sector FROM panel",
    "spine": "SELECT n.ticker, n.sector, d.date, p.close AS raw_close FROM names n CROSS JOIN days d LEFT JOIN panel p ON p.ticker = n.ticker AND p.date = d.date",
    "filled": """
  SELECT *, coalesce(raw_close, last_value(raw_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS close FROM spine""",
    "cover": """
  SELECT ticker, sector, count(*) AS expected_days, count(raw_close) AS raw_valid_days, count(close) AS valid_days,
         min(date) FILTER (WHERE raw_close IS NOT NULL) AS first_date, max(date) FILTER (WHERE raw_close IS NOT NULL) AS last_date,
         count(raw_close) / CAST(count(*) AS DOUBLE) AS coverage_before, count(close) / CAST(count(*) AS DOUBLE) AS coverage_after
  FROM filled GROUP BY ticker, sector""",
    "kept": "SELECT f.* FROM filled f JOIN cover c ON f.ticker = c.ticker WHERE c.coverage_after >= 0.9 AND f.close IS NOT NULL",
    "cleaned": """
  SELECT date, ticker, sector, close FROM kept
  WHERE date IN (SELECT date FROM kept GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM kept))""",
    "logret": "SELECT * FROM (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM cleaned) WHERE ret IS NOT NULL",
    "simret": "SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM cleaned) WHERE ret IS NOT NULL",
    "bounds": "SELECT quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM logret",
    "dayno": "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT date FROM logret)",
    "ret": "SELECT d.ord, r.date, r.ticker, r.sector, greatest(least(r.ret, b.hi), b.lo) AS ret FROM logret r CROSS JOIN bounds b JOIN dayno d ON d.date = r.date",
    "wins": f"SELECT CAST(unnest(range(0, (SELECT (max(ord) + 1 - {SIZE}) // {STEP} + 1 FROM ret))) AS INTEGER) AS window_ord",
    "win": f"SELECT w.window_ord, r.* FROM ret r JOIN wins w ON r.ord >= w.window_ord * {STEP} AND r.ord < w.window_ord * {STEP} + {SIZE}",
    "wtab": "SELECT window_ord, min(ord) AS lo, max(ord) + 1 AS hi, min(date) AS start_date, max(date) AS end_date FROM win GROUP BY window_ord",
    "pairs": """
  SELECT a.window_ord, a.ticker AS t1, b.ticker AS t2, coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0) AS corr
  FROM win a JOIN win b ON a.window_ord = b.window_ord AND a.ord = b.ord WHERE a.ticker < b.ticker GROUP BY ALL""",
    "dist": "SELECT *, sqrt(greatest(0, 2 * (1 - greatest(least(corr, 1), -1)))) AS dist FROM pairs",
    "corrs": "SELECT window_ord, avg(corr) AS mean_correlation, quantile_cont(corr, 0.5) AS median_correlation, avg(dist) AS mean_distance FROM dist GROUP BY window_ord",
    "wday": "SELECT window_ord, ord, avg(ret) AS m, coalesce(stddev_samp(ret), 0) AS s FROM win GROUP BY window_ord, ord",
    "wvol": "SELECT window_ord, coalesce(stddev_samp(m), 0) * sqrt(252) AS market_volatility, avg(s) AS dispersion FROM wday GROUP BY window_ord",
    "metrics": "SELECT w.window_ord, start_date, end_date, mean_correlation, median_correlation, mean_distance, market_volatility, dispersion FROM wtab w JOIN corrs USING (window_ord) JOIN wvol USING (window_ord)",
    # market windows over prices
    "pday": "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT date FROM cleaned)",
    "pwins": f"SELECT CAST(unnest(range(0, (SELECT (max(ord) + 1 - {SIZE + 1}) // {STEP} + 1 FROM pday))) AS INTEGER) AS window_ord",
    "pwin": f"SELECT w.window_ord, d.ord, c.* FROM cleaned c JOIN pday d ON d.date = c.date JOIN pwins w ON d.ord >= w.window_ord * {STEP} AND d.ord < w.window_ord * {STEP} + {SIZE + 1}",
    "pret": "SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY window_ord, ticker ORDER BY ord) - 1 AS ret FROM pwin) WHERE ret IS NOT NULL",
    "ptotal": "SELECT window_ord, ticker, sector, max_by(close, ord) / min_by(close, ord) - 1 AS total FROM pwin GROUP BY ALL",
    "ptot": "SELECT window_ord, avg(total) AS mean_return, quantile_cont(total, 0.5) AS median_return, coalesce(stddev_samp(total), 0) AS return_std FROM ptotal GROUP BY window_ord",
    "pdayret": "SELECT window_ord, ord, avg(ret) AS ret, coalesce(stddev_samp(ret), 0) AS s FROM pret GROUP BY ALL",
    "pvol": "SELECT window_ord, coalesce(stddev_samp(ret), 0) * sqrt(252) AS market_volatility, avg(s) AS return_dispersion FROM pdayret GROUP BY window_ord",
    "ppath": "SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY window_ord ORDER BY ord)) AS level FROM pdayret",
    "ppeak": "SELECT *, max(level) OVER (PARTITION BY window_ord ORDER BY ord) AS peak FROM ppath",
    "pdd": "SELECT window_ord, least(min(level / peak - 1), 0) AS market_max_drawdown FROM ppeak GROUP BY window_ord",
    "pstock": "SELECT window_ord, ticker, coalesce(stddev_samp(ret), 0) * sqrt(252) AS v FROM pret GROUP BY ALL",
    "pvd": "SELECT window_ord, coalesce(stddev_samp(v), 0) AS volatility_dispersion FROM pstock GROUP BY window_ord",
    "ppairs": """
  SELECT a.window_ord, a.ticker AS t1, b.ticker AS t2, coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0) AS corr
  FROM pret a JOIN pret b ON a.window_ord = b.window_ord AND a.ord = b.ord WHERE a.ticker < b.ticker GROUP BY ALL""",
    "pcorr": "SELECT window_ord, avg(corr) AS mean_correlation, coalesce(stddev_samp(corr), 0) AS correlation_std FROM ppairs GROUP BY window_ord",
    "edges": "SELECT window_ord, t1, t2 FROM ppairs WHERE corr >= 0.3",
    "adj": "SELECT window_ord, t1 AS a, t2 AS b FROM edges UNION ALL SELECT window_ord, t2, t1 FROM edges",
    "degree": "SELECT window_ord, a AS ticker, count(*) AS k FROM adj GROUP BY ALL",
    "tri": "SELECT x.window_ord, x.a AS ticker, count(*) AS tri FROM adj x JOIN adj y ON x.window_ord = y.window_ord AND x.a = y.a AND x.b < y.b JOIN edges e ON e.window_ord = x.window_ord AND e.t1 = x.b AND e.t2 = y.b GROUP BY ALL",
    "node": "SELECT t.window_ord, t.ticker, coalesce(k, 0) AS k, coalesce(tri, 0) AS tri FROM ptotal t LEFT JOIN degree d ON d.window_ord = t.window_ord AND d.ticker = t.ticker LEFT JOIN tri r ON r.window_ord = t.window_ord AND r.ticker = t.ticker",
    "graph": """
  SELECT window_ord, avg(k) AS avg_degree, sum(k) / CAST(count(*) * (count(*) - 1) AS DOUBLE) AS network_density,
         avg(CASE WHEN k < 2 THEN 0 ELSE 2.0 * tri / (k * (k - 1)) END) AS clustering_coefficient FROM node GROUP BY window_ord""",
    "sec": "SELECT window_ord, sector, avg(total) AS m FROM ptotal GROUP BY ALL",
    "secsum": "SELECT window_ord, sum(abs(m)) AS a FROM sec GROUP BY ALL",
    "sector": """
  SELECT window_ord, sum(power(abs(m) / CASE WHEN a = 0 THEN 1 ELSE a END, 2)) AS sector_concentration, coalesce(stddev_samp(m), 0) AS sector_return_std,
         max(m) - min(m) AS sector_return_spread, coalesce(max(CASE WHEN sector = 'AFRICA' THEN m END), 0) AS focus
  FROM sec JOIN secsum USING (window_ord) GROUP BY window_ord""",
    "pends": "SELECT window_ord, min(date) AS start_date, max(date) AS end_date FROM pwin GROUP BY ALL",
    "snaps": """
  SELECT e.window_ord, strftime(end_date, '%Y-%m') AS window_id, start_date, end_date, mean_return, median_return, return_std, market_volatility, market_max_drawdown,
         return_dispersion, volatility_dispersion, mean_correlation, correlation_std, avg_degree, network_density, clustering_coefficient,
         sector_concentration, sector_return_std, sector_return_spread, focus - mean_return AS technology_minus_market
  FROM pends e JOIN ptot USING (window_ord) JOIN pvol USING (window_ord) JOIN pdd USING (window_ord) JOIN pvd USING (window_ord)
  JOIN pcorr USING (window_ord) JOIN graph USING (window_ord) JOIN sector USING (window_ord)""",
    # a labelling that SQL can state: the quarter of the year of a window's end
    "labelled": "SELECT *, CAST(quarter(end_date) AS INTEGER) AS label FROM snaps",
    "trans": """
  SELECT * FROM (SELECT window_ord AS from_window, lead(window_ord) OVER (ORDER BY window_ord) AS to_window, label AS from_label,
         lead(label) OVER (ORDER BY window_ord) AS to_label FROM labelled) WHERE to_window IS NOT NULL""",
    # assets
    "aback": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM simret",
    "ayear": "SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM aback WHERE back <= 52",
    "assets": """
  SELECT ticker, min_by(close, back) AS latest_price, min_by(close, back) / max_by(close, back) - 1 AS return_1y,
         coalesce(stddev_samp(ret), 0) * sqrt(52) AS volatility_1y,
         min_by(close, back) / max_by(close, back) FILTER (WHERE back <= 26) - 1 AS momentum_6m,
         least(min(close / peak - 1), 0) AS max_drawdown_1y FROM ayear GROUP BY ticker""",
    "profile": "SELECT a.*, n.sector AS label, row_number() OVER (ORDER BY a.ticker) AS ord FROM assets a JOIN names n USING (ticker)",
    # points with given labels
    "pts": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings WHERE embedding IS NOT NULL",
    "flat": "SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts",
    "cent": "SELECT label, pos, avg(v) AS c, count(*) AS size FROM flat GROUP BY ALL",
    "sqd": "SELECT f.id, f.label, sum((v - c) * (v - c)) AS d2 FROM flat f JOIN cent c ON f.label = c.label AND f.pos = c.pos GROUP BY ALL",
    "spread": "SELECT label, avg(sqrt(d2)) AS s FROM sqd GROUP BY label",
}

_WITH = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items())


def sql(statement: str, **more: str) -> str:
    """A statement over the shared subqueries and more of its own."""
    own = "".join(f",\n{k} AS ({v})" for k, v in more.items())
    return f"{_WITH}{own}\n{statement}"


def six(*columns: str) -> str:
    """Columns rounded to six digits."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
