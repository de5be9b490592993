"""Low-dimensional coordinates of windows and assets, and their alignment over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .cluster import square


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    k = np.abs(v).argmax(axis=0)
    return v * np.where(v[k, np.arange(v.shape[1])] < 0, -1, 1)


def classical_mds(d: np.ndarray, dims: int = 2) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    top = np.argsort(-w)[:dims]
    out = signed(v[:, top]) * np.sqrt(np.maximum(w[top], 0))
    return np.pad(out, ((0, 0), (0, dims - out.shape[1])))


def smacof(d: np.ndarray, dims: int = 2, rounds: int = 300, eps: float = 1e-7) -> tuple[np.ndarray, float]:
    """(coordinates, stress): metric scaling from the classical solution, by Guttman transforms."""
    x = classical_mds(d, dims)
    n, old = len(d), np.inf
    stress = 0.0
    for _ in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        stress = float(((e - d) ** 2).sum() / 2)
        if old - stress < eps * max(1.0, stress):
            break
        old = stress
        b = -np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        b[np.arange(n), np.arange(n)] -= b.sum(axis=1)
        x = b @ x / n
    return x, stress


def mds(distances: DataFrame) -> DataFrame:
    """window_ord, ticker, x_raw, y_raw, stress, error: one task per window; a window that fails has its error instead."""
    ship(distances.sparkSession)

    def fit(pdf):
        import pandas as pd

        w = int(pdf.window_ord.iloc[0])
        try:
            names, d = square(pdf)
            x, stress = smacof(d)
            return pd.DataFrame({"window_ord": w, "ticker": names, "x_raw": x[:, 0], "y_raw": x[:, 1], "stress": stress, "error": None})
        except (np.linalg.LinAlgError, ValueError) as e:
            return pd.DataFrame({"window_ord": [w], "ticker": [None], "x_raw": [None], "y_raw": [None], "stress": [None], "error": [str(e)]})

    return distances.select("window_ord", "t1", "t2", "dist").groupBy("window_ord").applyInPandas(fit, "window_ord int, ticker string, x_raw double, y_raw double, stress double, error string")


def _matrix(pdf) -> tuple[list[str], np.ndarray]:
    """(tickers, standardised days x tickers) of a window's returns."""
    m = pdf.pivot(index="ord", columns="ticker", values="ret").sort_index()
    x = m.to_numpy(float)
    sd = x.std(axis=0, ddof=1)
    z = np.divide(x - x.mean(axis=0), sd, out=np.zeros_like(x), where=sd > 1e-15)
    return list(m.columns), np.nan_to_num(z)


def pca_ratio(expanded: DataFrame) -> DataFrame:
    """window_ord, pc1_ratio: largest eigenvalue of the correlation matrix over the number of series that vary."""
    ship(expanded.sparkSession)

    def fit(pdf):
        import pandas as pd

        z = _matrix(pdf)[1]
        s = np.linalg.svd(z - z.mean(axis=0), compute_uv=False) ** 2
        return pd.DataFrame({"window_ord": [int(pdf.window_ord.iloc[0])], "pc1_ratio": [float(s[0] / s.sum()) if s.sum() > 0 else 0.0]})

    return expanded.select("window_ord", "ord", "ticker", "ret").groupBy("window_ord").applyInPandas(fit, "window_ord int, pc1_ratio double")


def asset_pca(expanded: DataFrame, k: int = 6) -> DataFrame:
    """window_ord, ticker, x_pca, y_pca, ratio, kmeans_cluster: assets as rows of the standardised window."""
    ship(expanded.sparkSession)
    from .cluster import kmeans

    def fit(pdf):
        import pandas as pd

        names, z = _matrix(pdf)
        x = z.T - z.T.mean(axis=0)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        xy = signed(u[:, :2]) * s[:2]
        share = s**2 / (s**2).sum() if s.any() else s
        labels = kmeans(z.T, min(k, max(2, len(names) - 1)))[0]
        return pd.DataFrame({"window_ord": int(pdf.window_ord.iloc[0]), "ticker": names, "x_pca": xy[:, 0], "y_pca": xy[:, 1], "ratio": float(share[0]), "kmeans_cluster": labels})

    return expanded.select("window_ord", "ord", "ticker", "ret").groupBy("window_ord").applyInPandas(fit, "window_ord int, ticker string, x_pca double, y_pca double, ratio double, kmeans_cluster int")


def rotation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R, mean of a, mean of b): (a - mean_a) R is closest to b - mean_b among rotations and reflections."""
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ma).T @ (b - mb))
    return u @ vt, ma, mb


def align(coords: DataFrame) -> DataFrame:
    """window_ord, ticker, x, y: each window on the one before it, by rotation, reflection and shift of common tickers.

    The rotation of each window to its predecessor depends on raw coordinates only, so all are found in parallel; the
    2 x 2 products that chain them are taken in order by one task over one small row per window.
    """
    ship(coords.sparkSession)
    c = coords.where("ticker is not null").select("window_ord", "ticker", "x_raw", "y_raw")
    order = c.select("window_ord").distinct().withColumn("prev", F.lag("window_ord").over(W.orderBy("window_ord")))  # window ordinals only
    prev = c.select(F.col("window_ord").alias("prev"), "ticker", F.col("x_raw").alias("px"), F.col("y_raw").alias("py"))
    pairs = c.join(order, "window_ord").join(prev, ["prev", "ticker"], "left")

    def turn(pdf):
        import pandas as pd

        both = pdf.dropna(subset=["px", "py"]).sort_values("ticker")
        if len(both):
            r, ma, mb = rotation(both[["x_raw", "y_raw"]].to_numpy(float), both[["px", "py"]].to_numpy(float))
        else:
            r, ma, mb = np.eye(2), np.zeros(2), np.zeros(2)
        return pd.DataFrame({"window_ord": [int(pdf.window_ord.iloc[0])], "r": [r.ravel().tolist()], "ma": [ma.tolist()], "mb": [mb.tolist()]})

    turns = pairs.groupBy("window_ord").applyInPandas(turn, "window_ord int, r array<double>, ma array<double>, mb array<double>")

    def chain(pdf):
        pdf = pdf.sort_values("window_ord")
        total, shift, out = np.eye(2), np.zeros(2), []
        for k, (r, ma, mb) in enumerate(zip(pdf.r, pdf.ma, pdf.mb)):
            if k:  # x -> ((x - ma) r + mb) total + shift
                r, ma, mb = np.reshape(r, (2, 2)), np.array(ma), np.array(mb)
                shift = (mb - ma @ r) @ total + shift
                total = r @ total
            out.append([*total.ravel(), *shift])
        return pdf[["window_ord"]].assign(m=[[float(v) for v in o] for o in out])

    maps = turns.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(chain, "window_ord int, m array<double>")
    m = lambda i: F.col("m")[i]
    x, y = F.col("x_raw"), F.col("y_raw")
    return c.join(maps, "window_ord").select("window_ord", "ticker", (x * m(0) + y * m(2) + m(4)).alias("x"), (x * m(1) + y * m(3) + m(5)).alias("y"), "x_raw", "y_raw")


def mean_pairwise_distance(coords: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """window_ord, mean_pairwise_distance over the pairs of a window."""
    a = coords.select("window_ord", F.col("ticker").alias("a"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = coords.select("window_ord", F.col("ticker").alias("b"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    return a.join(b, "window_ord").where("a < b").groupBy("window_ord").agg(F.avg(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))).alias("mean_pairwise_distance"))


def alignment_diagnostics(aligned: DataFrame) -> DataFrame:
    """Centred norms and mean pairwise distances, raw and aligned, and their ratios (1 for any isometry)."""

    def norm(x, y):
        return F.sqrt(F.var_pop(x) + F.var_pop(y))

    n = aligned.groupBy("window_ord").agg(norm("x_raw", "y_raw").alias("raw_norm"), norm("x", "y").alias("aligned_norm"))
    d = mean_pairwise_distance(aligned, "x_raw", "y_raw").withColumnRenamed("mean_pairwise_distance", "raw_distance").join(mean_pairwise_distance(aligned).withColumnRenamed("mean_pairwise_distance", "aligned_distance"), "window_ord")
    return n.join(d, "window_ord").select("*", F.coalesce(F.try_divide("aligned_norm", "raw_norm"), F.lit(1.0)).alias("norm_ratio"), F.coalesce(F.try_divide("aligned_distance", "raw_distance"), F.lit(1.0)).alias("distance_ratio"))


# ---------------------------------------------------------------- label matching


def best_assignment(gain: np.ndarray) -> list[int]:
    """Column for each row of a small matrix, of the largest total; ties to the lowest columns. By subsets of columns."""
    rows, cols = gain.shape
    if rows > cols:
        raise ValueError("more rows than columns")
    best = {0: (0.0, ())}
    for r in range(rows):
        new: dict[int, tuple[float, tuple]] = {}
        for used, (total, path) in best.items():
            for c in range(cols):
                if not used >> c & 1:
                    t = (total + gain[r, c], (*path, c))
                    k = used | 1 << c
                    if k not in new or t[0] > new[k][0] + 1e-12 or (abs(t[0] - new[k][0]) <= 1e-12 and t[1] < new[k][1]):
                        new[k] = t
        best = new
    return list(min(best.values(), key=lambda t: (-t[0], t[1]))[1])


def overlaps(labels: DataFrame) -> DataFrame:
    """window_ord, prev_label, label, n: common tickers of the clusters of neighbouring windows."""
    prev = labels.select((F.col("window_ord") + 1).alias("window_ord"), "ticker", F.col("cluster").alias("prev_label"))
    return labels.join(prev, ["window_ord", "ticker"]).groupBy("window_ord", "prev_label", F.col("cluster").alias("label")).agg(F.count("*").alias("n"))


def match_labels(labels: DataFrame) -> DataFrame:
    """window_ord, cluster, matched: cluster names carried from window to window by largest overlap.

    Overlaps are one aggregation; names are handed on in order by one task over clusters per window, not tickers.
    """
    ship(labels.sparkSession)
    o = overlaps(labels)
    every = labels.select("window_ord", "cluster").distinct()
    j = every.join(o.withColumnRenamed("label", "cluster"), ["window_ord", "cluster"], "left")

    def carry(pdf):
        import pandas as pd

        out, name = [], {}
        for w, g in pdf.sort_values("window_ord").groupby("window_ord"):
            own = sorted(set(g.cluster))
            pairs = g.dropna(subset=["prev_label"])
            if len(pairs) and name:
                olds = sorted(name)
                size = max(len(own), len(olds))
                gain = np.zeros((len(own), size))
                for c, p, n in zip(pairs.cluster, pairs.prev_label, pairs.n):
                    if int(p) in name:
                        gain[own.index(c), olds.index(int(p))] = n
                cols = best_assignment(gain)
                now = {c: name[olds[k]] for c, k in zip(own, cols) if k < len(olds)}
                free = (i for i in range(10**9) if i not in set(now.values()))
                for c in own:
                    if c not in now:
                        now[c] = next(i for i in free if i not in now.values())
            else:
                now = {c: c for c in own}
            out += [(int(w), int(c), int(now[c])) for c in own]
            name = now
        return pd.DataFrame(out, columns=["window_ord", "cluster", "matched"])

    return j.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(carry, "window_ord int, cluster int, matched int")


# ---------------------------------------------------------------- windows and assets as points


def covariance(points: DataFrame) -> DataFrame:
    """i, j, cov of centred points (id, x): sums of products / (n - 1)."""
    e = points.select("id", F.posexplode("x").alias("i", "a"))
    p = e.join(points.select("id", F.posexplode("x").alias("j", "b")), "id")
    return p.groupBy("i", "j").agg((F.sum(F.col("a") * F.col("b")) / (F.count("*") - 1)).alias("cov"))


def power_components(cov: np.ndarray, starts: list[list[float]], steps: int = 80) -> list[np.ndarray]:
    """Leading components by power iteration, each removed before the next."""
    c, out = cov.copy(), []
    for s in starts:
        v = np.array(s, float)
        v /= np.linalg.norm(v) or 1.0
        for _ in range(steps):
            v = c @ v
            v /= np.linalg.norm(v) or 1.0
        out.append(v)
        c = c - (v @ c @ v) * np.outer(v, v)
    return out


def two_components(points: DataFrame, starts: list[list[float]] | None = None) -> DataFrame:
    """id, pc1, pc2: projections on the two leading components. The covariance is one aggregation; its dims x dims
    entries are iterated on the driver."""
    rows = covariance(points).collect()
    m = max((r["i"] for r in rows), default=-1) + 1
    if not m:
        return points.select("id", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    c = np.zeros((m, m))
    for r in rows:
        c[r["i"], r["j"]] = r["cov"]
    vs = power_components(c, starts or [np.eye(m)[0].tolist(), np.eye(m)[1 % m].tolist()])
    dot = lambda v: F.aggregate(F.zip_with("x", F.array(*(F.lit(float(z)) for z in v)), lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    return points.select("id", dot(vs[0]).alias("pc1"), dot(vs[1]).alias("pc2"))


#: Start vectors of the asset components.
ASSET_STARTS = [[1.0, 0.5, 0.25, 0.125], [0.125, -0.25, 0.5, -1.0]]
#: The force layout's steps, neighbours, repulsion and attraction.
LAYOUT_STEPS, LAYOUT_NEIGHBOURS, REPULSION, ATTRACTION = 120, 8, 0.002, 0.003


def neighbour_layout(points: DataFrame) -> DataFrame:
    """id, x, y: the two components relaxed by repulsion between all points and attraction of near ones.

    All pairs of points are held in one task, so ``points`` are report-sized: at most 5 000 rows, more are an error.
    """
    ship(points.sparkSession)
    if points.limit(5_001).count() > 5_000:
        raise ValueError("the layout is for report-sized tables")
    xy0 = {r["id"]: (r["pc1"], r["pc2"]) for r in two_components(points).collect()}

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        data = np.array(pdf.x.tolist(), float)
        p = np.array([xy0[i] for i in pdf.id], float)
        n = len(p)
        d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        near = np.zeros((n, n), bool)
        for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, : min(LAYOUT_NEIGHBOURS, n - 1)]):
            near[i, row] = True
        near = np.triu(near)  # a pair attracts if the later point is near the earlier one
        near = near | near.T
        for _ in range(LAYOUT_STEPS):
            gap = p[:, None] - p[None]
            push = REPULSION / ((gap**2).sum(axis=2) + 1e-4)
            p = p + ((push - ATTRACTION * near)[:, :, None] * gap).sum(axis=1)
        return pd.DataFrame({"id": pdf.id, "x": p[:, 0], "y": p[:, 1]})

    kind = points.schema["id"].dataType.simpleString()
    return points.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, f"id {kind}, x double, y double")
