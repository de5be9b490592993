"""Unit cases of the panel operators on literal tables."""

import os
import shutil
import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import guarded_corr, safe_stddev
from tidemark.functions.tickers import normalize_ticker, vendor_ticker
from tidemark.operators import cleaning, cluster, embed, evaluate, labels, predict, ranking, returns, windows
from tidemark.sources import archive, simulate

D0 = date(2020, 1, 1)


def panel(spark, rows):
    return spark.createDataFrame([(D0 + timedelta(days=d), t, "s", c) for d, t, c in rows], "date date, ticker string, sector string, close double")


def one(df, column):
    return [r[column] for r in df.collect()]


def test_tickers(spark):
    df = spark.createDataFrame([("aapl.us",), ("BRK-B.US",), ("brkb",), (" bf_b ",), (None,)], "t string")
    assert one(df.select(normalize_ticker(F.col("t")).alias("t")), "t") == ["AAPL", "BRK.B", "BRK.B", "BF.B", None]
    df = spark.createDataFrame([("BRK.B",), ("aapl",)], "t string")
    assert one(df.select(vendor_ticker(F.col("t")).alias("t")), "t") == ["BRK-B", "AAPL"]


def test_positive_and_finite(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),), (5.0,)], "close double")
    assert one(cleaning.positive_prices(df), "close") == [10.0, float("inf"), 5.0]
    assert one(cleaning.finite_prices(df), "close") == [10.0, 5.0]


def test_keep_last_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 5.0)], "k string, line_no int, close double")
    assert sorted(one(cleaning.keep_last(df, ["k"], "line_no"), "close")) == [2.0, 5.0]
    assert one(cleaning.duplicate_rows(df, ["k"]), "duplicate_rows") == [2]
    assert one(cleaning.duplicate_rows(df.limit(0), ["k"]), "duplicate_rows") == [0]


@pytest.mark.parametrize("given, want", [([1.0, None, None, None], [1.0, 1.0, 1.0, None]), ([None, 2.0, None], [None, 2.0, 2.0])])
def test_forward_fill(spark, given, want):
    df = panel(spark, [(i, "A", c) for i, c in enumerate(given)])
    assert one(cleaning.forward_fill(df, 2).orderBy("date"), "close") == want


def test_clean_panel(spark):
    rows = [(i, t, 10.0 + i) for i in range(20) for t in "AB"] + [(i, "C", 1.0) for i in range(10)]
    rows.remove((5, "A", 15.0))
    df = panel(spark, rows)
    q = {r["ticker"]: r for r in cleaning.quality_report(df).collect()}
    assert (q["A"]["filled_days"], q["A"]["kept"], q["C"]["kept"], q["C"]["reason"]) == (1, True, False, "coverage_below_threshold")
    c = cleaning.clean_panel(df)
    assert sorted(one(c.select("ticker").distinct(), "ticker")) == ["A", "B"]
    assert {r["count"] for r in c.groupBy("ticker").count().collect()} == {20}


def test_look_back_and_days(spark):
    df = panel(spark, [(0, "A", 1.0), (800, "A", 2.0), (900, "A", 3.0)])
    assert cleaning.look_back(df, 1).count() == 2
    assert one(cleaning.trading_days(df).orderBy("date"), "ord") == [0, 1, 2]


def test_business_days_and_regimes(spark):
    b = cleaning.business_days(spark, "2020-01-01", "2020-01-07")
    assert b.count() == 5
    got = cleaning.regime_for(b.where("date = date'2020-01-02'"), simulate.events_table(spark), simulate.DEFAULT_REGIME)
    assert one(got, "regime") == [simulate.DEFAULT_REGIME]


def test_window_count_and_errors(spark):
    r = panel(spark, [(i, "A", float(i)) for i in range(100)]).withColumn("ret", F.col("close"))
    assert windows.window_table(returns.with_ord(r), 20, 10).count() == 9
    with pytest.raises(ValueError):
        windows.expand(r, 1, 1)
    with pytest.raises(ValueError):
        windows.expand(r, 5, 0)


def test_correlations_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    x[:, 3] = 0.5  # constant
    df = spark.createDataFrame([(i, D0 + timedelta(days=i), t, float(x[i, j])) for i in range(40) for j, t in enumerate("ABCD")], "ord int, date date, ticker string, ret double")
    a = {(r.window_ord, r.t1, r.t2): r["corr"] for r in windows.pair_correlations(windows.expand(df, 20, 5)).collect()}
    b = {(r.window_ord, r.t1, r.t2): r["corr"] for r in windows.pair_correlations_by_blocks(df, 20, 5).collect()}
    assert a.keys() == b.keys() and len(a) == 5 * 6
    for (w, s, t), v in a.items():
        i, j = "ABCD".index(s), "ABCD".index(t)
        want = 0.0 if "D" in (s, t) else np.corrcoef(x[w * 5 : w * 5 + 20, i], x[w * 5 : w * 5 + 20, j])[0, 1]
        assert v == pytest.approx(want, abs=1e-12) and b[w, s, t] == pytest.approx(want, abs=1e-9)


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    r = df.agg(guarded_corr(F.col("a"), F.col("b")).alias("c"), safe_stddev(F.col("a")).alias("s")).first()
    assert (r["c"], r["s"]) == (0.0, 0.0)


def test_distance_of_half(spark):
    df = spark.createDataFrame([(0, "A", "B", 0.5), (0, "A", "C", 1.0)], "window_ord int, t1 string, t2 string, corr double")
    assert sorted(one(windows.with_distance(df), "dist")) == [0.0, pytest.approx(1.0)]


def test_graph(spark):
    pairs = spark.createDataFrame([(0, "A", "B", 0.9), (0, "A", "C", 0.9), (0, "B", "C", 0.9), (0, "A", "D", 0.1), (0, "B", "D", 0.9), (0, "C", "D", 0.0)], "window_ord int, t1 string, t2 string, corr double")
    nodes = spark.createDataFrame([(0, t) for t in "ABCDE"], "window_ord int, ticker string")
    g = windows.graph_metrics(pairs, nodes, 0.55).first()
    assert g["avg_degree"] == pytest.approx(8 / 5) and g["network_density"] == pytest.approx(8 / 20)
    assert g["clustering_coefficient"] == pytest.approx((1 + 1 / 3 + 1) / 5)


def test_alignment_preserves_shape(spark):
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(6, 2)), []
    for w in range(30):
        a = 0.3 * w
        q = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ np.diag([1, -1 if w % 2 else 1])
        p = base @ q + w
        rows += [(w, f"T{i}", float(p[i, 0]), float(p[i, 1])) for i in range(6)]
    c = spark.createDataFrame(rows, "window_ord int, ticker string, x_raw double, y_raw double")
    out = embed.align(c).toPandas()
    first = out[out.window_ord == 0].sort_values("ticker")[["x", "y"]].to_numpy()
    for w in range(30):
        got = out[out.window_ord == w].sort_values("ticker")[["x", "y"]].to_numpy()
        assert np.allclose(got, first, atol=1e-9)
    d = embed.alignment_diagnostics(embed.align(c)).toPandas()
    assert np.allclose(d.distance_ratio, 1, atol=1e-9)


def test_smacof_recovers_plane():
    x = np.random.default_rng(2).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    y, stress = embed.smacof(d)
    e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    assert stress < 1e-8 and np.allclose(d, e, atol=1e-4)


def test_scores_agree_with_matrix(spark):
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(30, 3)), rng.integers(0, 3, 30)
    lab[0] = 7  # alone
    p = spark.createDataFrame([(i, [float(v) for v in x[i]], int(lab[i])) for i in range(30)], "id int, x array<double>, label int")
    want = cluster.scores(x, lab)
    assert evaluate.silhouette(p).first()[0] == pytest.approx(want["silhouette"])
    assert evaluate.davies_bouldin(p).first()[0] == pytest.approx(want["davies_bouldin"])
    assert evaluate.calinski_harabasz(p).first()[0] == pytest.approx(want["calinski_harabasz"])
    assert evaluate.inertia(p).first()[0] == pytest.approx(want["inertia"])


def test_agreement(spark):
    same = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert evaluate.adjusted_rand(same, "a", "b").first()[0] == pytest.approx(1.0)
    assert evaluate.normalized_mutual_information(same, "a", "b").first()[0] == pytest.approx(1.0)
    flat = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluate.adjusted_rand(flat, "a", "b").first()[0] == 1.0


def test_lloyd_matches_kernel(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    p = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "id int, x array<double>")
    got = [r["label"] for r in cluster.lloyd(p, 4).orderBy("id").collect()]
    assert got == cluster.kmeans(x, 4)[0].tolist()


def test_assignment_and_matching(spark):
    assert embed.best_assignment(np.array([[1.0, 5, 0], [2, 6, 0]])) == [0, 1] or embed.best_assignment(np.array([[1.0, 5, 0], [2, 6, 0]])) == [1, 0]
    lab = spark.createDataFrame([(0, "A", 0), (0, "B", 0), (0, "C", 1), (1, "A", 1), (1, "B", 1), (1, "C", 0)], "window_ord int, ticker string, cluster int")
    m = {(r.window_ord, r.cluster): r.matched for r in embed.match_labels(lab).collect()}
    assert m == {(0, 0): 0, (0, 1): 1, (1, 1): 0, (1, 0): 1}


def test_simulated_market(spark):
    """The synthetic market's windows and the published scores of its best model."""
    rows = list(simulate.rows())
    assert len(rows) == 1434 * 104
    names = sorted({r[1] for r in rows})
    sector = {r[1]: r[2] for r in rows}
    days = sorted({r[0] for r in rows})
    at = {d: i for i, d in enumerate(days)}
    price = np.zeros((len(days), len(names)))
    for d, t, _, c in rows:
        price[at[d], names.index(t)] = c
    feats = []
    for lo in range(0, len(days) - 60, 20):
        p = price[lo : lo + 61]
        r = p[1:] / p[:-1] - 1
        tot = p[-1] / p[0] - 1
        m = r.mean(axis=1)
        path = np.cumprod(1 + m)
        cc = np.corrcoef(r.T)
        iu = np.triu_indices(len(names), 1)
        adj = (cc >= 0.55) & ~np.eye(len(names), dtype=bool)
        k = adj.sum(axis=1)
        tri = np.diag(adj.astype(int) @ adj @ adj) / 2
        local = np.where(k < 2, 0, 2 * tri / np.maximum(k * (k - 1), 1))
        by = {s: np.mean([tot[i] for i, t in enumerate(names) if sector[t] == s]) for s in simulate.UNIVERSE}
        v = np.array(list(by.values()))
        sd = lambda z: z.std(ddof=1)
        feats.append([tot.mean(), np.median(tot), sd(tot), sd(m) * 252**0.5, min((path / np.maximum.accumulate(path) - 1).min(), 0), np.mean([sd(z) for z in r]), sd(r.std(axis=0, ddof=1) * 252**0.5), cc[iu].mean(), sd(cc[iu]), k.mean(), k.sum() / len(k) / (len(k) - 1), local.mean(), ((np.abs(v) / np.abs(v).sum()) ** 2).sum(), sd(v), v.max() - v.min(), by["Information Technology"] - tot.mean()])
    x = np.array(feats)
    assert x.shape == (69, 16)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    labels_, _ = cluster.kmeans(z, 4)
    s = cluster.scores(z, labels_)
    assert s["silhouette"] == pytest.approx(0.298818, abs=1e-5) and s["inertia"] == pytest.approx(422.396689, abs=1e-3)
    assert sorted(np.bincount(labels_)) == [13, 17, 19, 20]
    two = cluster.scores(z, cluster.ALGORITHMS["agglomerative"](z, 2))
    assert two["silhouette"] == pytest.approx(0.402066, abs=1e-5)
    # the relational form gives the same features on a few windows
    some = [r for r in rows if r[0] <= days[105]]
    df = spark.createDataFrame(some, "date date, ticker string, sector string, close double")
    got = windows.snapshots(df, 60, 20, "Information Technology").orderBy("window_ord").toPandas()
    assert np.allclose(got[windows.SNAPSHOT_FEATURES].to_numpy()[:2], x[:2], atol=1e-9)


def test_prediction(spark):
    rows = [(i, float(np.sin(i)), float(np.cos(i / 3) + 2)) for i in range(40)]
    m = spark.createDataFrame(rows, "window_ord int, a double, b double")
    got = {r.model: r for r in predict.compare(m, ["a", "b"], "b").collect()}
    assert set(got) == {"naive", "linear", "forest"} and got["linear"].rmse < got["naive"].rmse
    assert predict.compare(m.limit(8), ["a", "b"], "b").count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([("AB", 1.0), ("B", 2.0), ("XB", 2.0)], "ticker string, v double")
    assert one(ranking.search(df, " b "), "ticker") == ["B"]
    assert one(ranking.search(df, "x"), "ticker") == ["XB"]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert one(ranking.range_scale(same, ["v"]), "v") == [0.5, 0.5]
    m = spark.createDataFrame([(i, 1.0, 1.0) for i in range(3)], "window_ord int, market_volatility double, mean_correlation double")
    assert sorted(one(ranking.key_snapshots(m), "window_ord")) == [0, 1, 2]


def test_formatters_round_the_binary_value(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalog

    v = [1.005, 0.125, 0.375, -0.125, 528.15, 9208.15, -0.001, 0.0, 1e23, 123456789012345678.0, 4503599627370497.5]
    rows = [(9 * k + 1, x) for k, x in enumerate(v)] + [(9, 1.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["j4_formatters"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalog.ORACLE["j4_formatters"]).fetchall())
    shown = spark.createDataFrame([(1.005,), (0.125,), (None,), (float("nan"),), (float("-inf"),)], "v double")
    assert one(shown.select(ranking.dollars(F.col("v")).alias("v")), "v") == ["$1.00", "$0.12", "—", "—", "—"]


def test_archive(spark, tmp_path):
    import zipfile

    z = tmp_path / "b.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("data/stocks/aapl.us.txt", "x")
        f.writestr("data/etfs/aapl.us.txt", "x")
        f.writestr("readme.md", "x")
    assert archive.find_archive(str(tmp_path)) == z
    with pytest.raises(FileNotFoundError):
        archive.find_archive(str(tmp_path / "none"))
    idx = archive.member_index(archive.list_members(spark, str(z)))
    want = spark.createDataFrame([("AAPL", ["aapl"]), ("MSFT", ["msft"])], "ticker string, aliases array<string>")
    got = {r.project_ticker: (r.source_member, r.reason) for r in archive.match_members(want, idx).collect()}
    assert got == {"AAPL": ("data/stocks/aapl.us.txt", "matched"), "MSFT": (None, "no_member")}
    head = archive.sniff(b"<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\nAAPL.US,D,20200102,000000,1,2,1,1.5,100,0\n")
    assert head["delimiter"] == "," and head["has_header"] and head["date_format"] == "yyyyMMdd"
    assert archive.decode_sample("é".encode("cp1252"))[1] == "cp1252"
    lines = spark.createDataFrame([("m", 1, "MSFT.US,D,20200102,000000,1,2,1,1.5,100,0"), ("m", 2, "MSFT.US,D,20200102,0,1,2,1,2.5,1,0"), ("m", 3, "MSFT.US,D,2020,0,1,2,1,2.5,1,0"), ("m", 4, "MSFT.US,D,20200103,0,1,2,1,-1,1,0")], "member string, line_no long, value string")
    rows, stats = archive.parse_members(lines)
    assert [(r.ticker, r.close) for r in rows.collect()] == [("MSFT", 2.5)]
    s = stats.first()
    assert (s.invalid_date_count, s.invalid_price_count, s.duplicate_count) == (1, 1, 1)


def test_names(spark):
    df = spark.createDataFrame([(0, -0.2, 0.4, -0.2, 0.5, 0.0), (1, 0.05, 0.1, -0.01, 0.2, 0.0), (2, 0.05, 0.1, -0.01, 0.2, 0.0)], "label int, mean_return double, market_volatility double, market_max_drawdown double, mean_correlation double, technology_minus_market double")
    got = [r.regime_name for r in labels.name_regimes(df, df.columns[1:]).orderBy("label").collect()]
    assert got == ["Regime A：危机共振状态", "Regime B：低波动牛市", "Regime C：低波动牛市 2"]


def test_members_with_headers(spark):
    """Reordered and differently spelt columns, a header that lacks a price, and no header, side by side."""
    rows = [
        ("a", 0, "Close;<DATE>;Symbol;other"), ("a", 1, "1.5;20200102;aapl.us;x"), ("a", 2, "2.5;20200102;aapl.us;x"), ("a", 3, "bad;20200103;aapl.us;x"),
        ("b", 5, "<TICKER>;<PER>;<DATE>;<TIME>;<OPEN>;<HIGH>;<LOW>;<CLOSE>;<VOL>;<OPENINT>"), ("b", 6, "MSFT.US;D;20200106;0;1;2;1;7;1;0"),
        ("c", 1, "BRK-B.US;D;20200107;0;1;2;1;9;1;0"), ("d", 1, "date;open"), ("d", 2, "20200108;3"), ("e", 1, "Adj Close;datetime"), ("e", 2, "4;20200109"),
    ]
    lines = spark.createDataFrame(rows, "member string, line_no long, value string")
    got, stats = archive.parse_members(lines, ";")
    assert sorted((r.member, str(r.ticker), str(r.date), r.close) for r in got.collect()) == [("a", "AAPL", "2020-01-02", 2.5), ("b", "MSFT", "2020-01-06", 7.0), ("c", "BRK.B", "2020-01-07", 9.0), ("e", "None", "2020-01-09", 4.0)]
    assert {r.member: (r.invalid_date_count, r.invalid_price_count, r.duplicate_count) for r in stats.collect()} == {"a": (0, 1, 1), "b": (0, 0, 0), "c": (0, 0, 0), "d": (0, 1, 0), "e": (0, 0, 0)}


def test_structural_label(spark):
    names = "window_ord int, mean_correlation double, market_volatility double, pca_first_component_ratio double, mean_pairwise_distance double, sector_cluster_ari double"
    label = lambda *last: predict.structural_label(spark.createDataFrame([(0, 0.5, 0.5, 0.5, 0.5, 0.5), (1, 9.0, 9.0, 9.0, 9.0, 9.0), (2, *last)], names)).first().label
    assert label(0.6, 0.6, 0.6, 0.1, 0.1) == predict.TOGETHER and label(0.4, 0.6, 0.6, 0.6, 0.6) == predict.APART
    assert label(0.6, 0.6, 0.4, 0.6, 0.6) == predict.MIXED and label(0.4, 0.6, 0.6, 0.6, 0.5) == predict.MIXED


def test_full_window_metrics(spark, small):
    """Every column against its definition, window by window, from the returns alone."""
    from tidemark.plans import catalog

    got = {r.window_ord: r for r in catalog._full_metrics(spark, small).collect()}
    r = windows.expand(catalog._returns(spark, small), catalog.SIZE, catalog.STEP).toPandas()
    assert len(got) == r.window_ord.nunique() > 2
    before = None
    for k, w in sorted(r.groupby("window_ord")):
        x = w.pivot(index="ord", columns="ticker", values="ret").sort_index(axis=1)
        c = x.corr().fillna(0.0).to_numpy().copy()
        np.fill_diagonal(c, 1.0)
        d = np.sqrt(np.maximum(0, 2 * (1 - c)))
        off = ~np.eye(len(c), dtype=bool)
        z = ((x - x.mean()) / x.std(ddof=1).replace(0, np.nan)).fillna(0).to_numpy()
        lab = cluster.average_linkage(d, min(6, max(2, len(c) - 1)))
        own = [np.mean([d[i, j] for j in range(len(c)) if j != i and lab[j] == lab[i]]) if (lab == lab[i]).sum() > 1 else None for i in range(len(c))]
        near = [min(np.mean(d[i, lab == o]) for o in set(lab) if o != lab[i]) for i in range(len(c))]
        sil = np.mean([0 if a is None or max(a, b) == 0 else (b - a) / max(a, b) for a, b in zip(own, near)])
        eig = np.linalg.eigvalsh(z.T @ z)
        want = {"mean_correlation": c[off].mean(), "median_correlation": np.median(c[off]), "mean_distance": d[off].mean(), "market_volatility": x.mean(axis=1).std(ddof=1) * np.sqrt(252), "dispersion": x.std(axis=1, ddof=1).mean(),
                "pca_first_component_ratio": eig[-1] / eig.sum(), "silhouette_score": sil, "cluster_count": len(set(lab)), "adjacent_window_ari": before and rand(before, lab.tolist()), "sector_cluster_ari": rand([w.set_index("ticker").sector.to_dict()[t] for t in x.columns], lab.tolist())}
        for name, v in want.items():
            assert got[k][name] == (pytest.approx(v, abs=1e-6) if v is not None else None), (k, name)
        assert 0 < got[k].mean_pairwise_distance < 2 and 0 < got[k].pca_stock_projection_pc1_ratio <= 1 and 0 <= got[k].sector_cluster_nmi <= 1
        before = lab.tolist()


def rand(a, b):
    """Adjusted Rand index by its definition."""
    two = lambda x: x * (x - 1) / 2
    s = sum(two(sum(p == (x, y) for p in zip(a, b))) for x in set(a) for y in set(b))
    sa, sb = sum(two(a.count(x)) for x in set(a)), sum(two(b.count(y)) for y in set(b))
    e = sa * sb / two(len(a))
    return 1.0 if (sa + sb) / 2 == e else (s - e) / ((sa + sb) / 2 - e)


def test_sinks_and_reports(spark, tmp_path):
    d = spark.createDataFrame([("A", 1.25), ("B", None)], "name string, v double")
    archive.write_csv(d, str(tmp_path / "c"))
    assert [tuple(r) for r in archive.dashboard_csv(spark, str(tmp_path / "c"), ["v"]).orderBy("name").collect()] == [("A", 1.25), ("B", None)]
    archive.write_json(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("v is not null").count() == 1
    built = []
    make = lambda: built.append(1) or d
    assert [archive.cached(spark, str(tmp_path / "k"), {"a": 1}, make).count() for _ in range(2)] == [2, 2] and len(built) == 1
    archive.cached(spark, str(tmp_path / "k"), {"a": 2}, make)
    assert len(built) == 2
    m = spark.createDataFrame([("x/y/a.txt", 3), ("b.md", 4)], "source_member string, member_size long")
    one = archive.inspection_report(m, str(tmp_path / "r"))
    assert (one["members"], one["text_members"], one["extensions"]) == (2, 1, {".txt": 1, ".md": 1}) and "members: 2" in (tmp_path / "r/inspection.md").read_text()
    assert labels.markdown_table(d.where("name = 'A'"), ["name", "v"]) == "| name | v |\n| --- | --- |\n| A | 1.2500 |"


def test_queries_without_the_corpus_part(tmp_path):
    """The registry on a copy of the repository that has neither the corpus operators nor the tokenizers."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / f).exists():
            shutil.copy(root / f, tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') for k in q))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    out = run().stdout.split()
    assert int(out[0]) > 100 and int(out[1]) > 90 and out[2] == "False"
    if (tmp_path / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.split() == out
