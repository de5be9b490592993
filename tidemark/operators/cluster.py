"""Clustering: a distributed Lloyd loop for large sets, numpy kernels for the small matrices of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import square_distance
from ..session import ship, tabled
from .evaluate import adjusted_rand, normalized_mutual_information, silhouettes

# ---------------------------------------------------------------- Lloyd on DataFrames


def init_rows(n: int, k: int) -> list[int]:
    """Evenly spaced rows: round(i (n - 1) / (k - 1)), halves to even."""
    return [min(n - 1, round(i * (n - 1) / max(1, k - 1))) for i in range(k)]


def lloyd(points: DataFrame, k: int, rounds: int = 100, first_rows: bool = False, fixed_rounds: bool = False) -> DataFrame:
    """id, x, label: k-means from fixed rows. points: id (a dense ordinal from 0), x (array<double>).

    Ties go to the lowest label; an empty cluster keeps its centroid. Each round is one map with broadcast centroids
    (k rows) and one aggregation; it stops when no label changes, unless ``fixed_rounds``.
    """
    n = points.count()
    k = min(k, n)
    start = list(range(k)) if first_rows else init_rows(n, k)
    got = {r["id"]: r["x"] for r in points.where(F.col("id").isin(start)).collect()}  # k rows
    centres = [got[i] for i in start]
    before = None
    labelled = points
    for _ in range(rounds):
        cs = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centres))
        d = F.transform(cs, lambda c: square_distance(F.col("x"), c))
        labelled = points.withColumn("label", (F.array_position(d, F.array_min(d)) - 1).cast("int"))
        sums = labelled.select("label", F.posexplode("x").alias("pos", "v"), F.when(F.col("pos") == 0, F.xxhash64("id", "label").cast("decimal(38,0)")).alias("h")).groupBy("label", "pos").agg(F.avg("v").alias("v"), F.count("*").alias("n"), F.sum("h").alias("h")).collect()  # k * dims rows
        now = sorted((r["label"], r["n"], r["h"]) for r in sums if r["pos"] == 0)
        if now == before and not fixed_rounds:
            break
        before = now
        new = [list(c) for c in centres]
        for r in sums:
            new[r["label"]][r["pos"]] = r["v"]
        centres = new
    return tabled(labelled, "lloyd")


# ---------------------------------------------------------------- numpy kernels


def kmeans(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centroids) of the same procedure on a matrix."""
    c = x[init_rows(len(x), k)].astype(float)
    old = None
    for _ in range(rounds):
        labels = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if old is not None and (labels == old).all():
            break
        old = labels
        c = np.stack([x[labels == j].mean(axis=0) if (labels == j).any() else c[j] for j in range(k)])
    return labels, c


def average_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """Labels by average linkage of a distance matrix; of equal distances the first pair is joined."""
    n = len(d)
    groups = [[i] for i in range(n)]
    s = d.astype(float).copy()  # sums of distances between groups
    size = np.ones(n)
    alive = list(range(n))
    while len(alive) > max(1, k):
        a = np.array(alive)
        m = s[np.ix_(a, a)] / np.outer(size[a], size[a])
        m = np.round(m, 12)
        m[np.tril_indices(len(a))] = np.inf
        i, j = divmod(int(m.argmin()), len(a))
        i, j = alive[i], alive[j]
        groups[i] += groups[j]
        s[i] += s[j]
        s[:, i] += s[:, j]
        size[i] += size[j]
        alive.remove(j)
    labels = np.zeros(n, int)
    for lab, g in enumerate(alive):
        labels[groups[g]] = lab
    return labels


def diagonal_em(x: np.ndarray, k: int, rounds: int = 35, floor: float = 1e-4) -> np.ndarray:
    """Labels of a diagonal Gaussian mixture from the k-means centroids, unit variances and equal weights."""
    c = kmeans(x, k)[1]
    var, w = np.ones_like(c), np.full(k, 1 / k)
    r = np.zeros((len(x), k))
    for _ in range(rounds):
        v = np.maximum(var, 1e-6)
        logp = np.log(w) - 0.5 * (((x[:, None] - c) ** 2) / v).sum(axis=2) - 0.5 * np.log(v).sum(axis=1)
        logp -= logp.max(axis=1, keepdims=True)
        r = np.exp(logp)
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        for j in np.flatnonzero(n >= 1e-6):
            w[j] = n[j] / len(x)
            c[j] = r[:, j] @ x / n[j]
            var[j] = r[:, j] @ (x - c[j]) ** 2 / n[j] + floor
    return r.argmax(axis=1)


def scores(x: np.ndarray, labels: np.ndarray, singleton: float = 1.0, eps: float = 1e-9) -> dict[str, float]:
    """silhouette, davies_bouldin, calinski_harabasz, inertia of a small matrix."""
    labs = np.unique(labels)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = np.stack([x[labels == j].mean(axis=0) for j in labs])
    at = np.searchsorted(labs, labels)
    inertia = float(((x - c[at]) ** 2).sum())
    if len(labs) < 2:
        return {"silhouette": 0.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0, "inertia": inertia}
    size = np.bincount(at)
    sums = np.stack([d[:, at == j].sum(axis=1) for j in range(len(labs))], axis=1)
    own = sums[np.arange(len(x)), at]
    a = own / np.maximum(size[at] - 1, 1)
    other = sums / size
    other[np.arange(len(x)), at] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    s = np.where(size[at] == 1, singleton, np.divide(b - a, top, out=np.zeros(len(x)), where=top > 0))
    spread = np.array([np.sqrt(((x[at == j] - c[j]) ** 2).sum(axis=1)).mean() for j in range(len(labs))])
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
    gap[gap == 0] = eps
    r = (spread[:, None] + spread[None]) / gap
    np.fill_diagonal(r, -np.inf)
    between = float((size * ((c - x.mean(axis=0)) ** 2).sum(axis=1)).sum())
    k, n = len(labs), len(x)
    ch = between / (k - 1) / (inertia / (n - k)) if n > k and inertia > 0 else 0.0
    return {"silhouette": float(s.mean()), "davies_bouldin": float(r.max(axis=1).mean()), "calinski_harabasz": ch, "inertia": inertia}


ALGORITHMS = {
    "kmeans": lambda x, k: kmeans(x, k)[0],
    "agglomerative": lambda x, k: average_linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), k),
    "gmm": diagonal_em,
}


def model_grid(points: DataFrame, ks: range, algorithms: tuple[str, ...] = tuple(ALGORITHMS), singleton: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """grid_ord, algorithm, k, labels, silhouette, davies_bouldin, calinski_harabasz, inertia: each fit is one task.

    ``points`` (id, x) are the windows of a market or the assets of a study, a report-sized matrix: at most 20 000 rows.
    """
    spark = points.sparkSession
    ship(spark)
    own = points.orderBy("id").limit(20_001).collect()
    if len(own) > 20_000:
        raise ValueError("the grid is for report-sized matrices; use lloyd()")
    x = np.array([r["x"] for r in own], float)
    sent = spark.sparkContext.broadcast(x)
    kernels, score = {a: ALGORITHMS[a] for a in algorithms}, scores
    grid = [(i, a, k) for i, (a, k) in enumerate((a, k) for a in algorithms for k in ks if k <= len(x))]
    if not grid:
        return spark.createDataFrame([], "grid_ord int, algorithm string, k int, labels array<int>, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double")

    def fit(pdf):
        out = []
        for g, a, k in zip(pdf.grid_ord, pdf.algorithm, pdf.k):
            labels = kernels[a](sent.value, int(k))
            s = score(sent.value, labels, singleton, eps)
            out.append((g, a, k, labels.tolist(), *s.values()))
        import pandas as pd

        return pd.DataFrame(out, columns=["grid_ord", "algorithm", "k", "labels", "silhouette", "davies_bouldin", "calinski_harabasz", "inertia"])

    schema = "grid_ord int, algorithm string, k int, labels array<int>, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double"
    return spark.createDataFrame(grid, "grid_ord int, algorithm string, k int").groupBy("grid_ord").applyInPandas(fit, schema)


def best_model(grid: DataFrame, least_k: int = 4) -> DataFrame:
    """The best row by silhouette, then Davies-Bouldin, then Calinski-Harabasz, at six digits; the first of equals."""
    top = grid.agg(F.max("k").alias("_k"))
    g = grid.crossJoin(F.broadcast(top)).where(F.col("k") >= F.least(F.lit(least_k), F.col("_k"))).drop("_k")  # one row
    r = lambda c: F.round(c, 6)
    return g.orderBy(r("silhouette").desc(), r("davies_bouldin"), r("calinski_harabasz").desc(), "grid_ord").limit(1)


def window_labels(distances: DataFrame, k: int) -> DataFrame:
    """window_ord, ticker, cluster: average linkage of each window's distances (window_ord, t1, t2, dist)."""
    ship(distances.sparkSession)
    own = distances.select("window_ord", "t1", "t2", "dist")
    return own.groupBy("window_ord").applyInPandas(lambda pdf: _linkage_of(pdf, k), "window_ord int, ticker string, cluster int")


def square(pdf) -> tuple[list[str], np.ndarray]:
    """(tickers, matrix) of a frame of pairs t1, t2, dist."""
    names = sorted({*pdf.t1, *pdf.t2})
    at = {t: i for i, t in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pdf.t1.map(at).to_numpy(), pdf.t2.map(at).to_numpy()
    d[i, j] = d[j, i] = pdf.dist.to_numpy()
    return names, d


def _linkage_of(pdf, k: int):
    import pandas as pd

    names, d = square(pdf)
    k = min(k, max(2, len(names) - 1))
    return pd.DataFrame({"window_ord": pdf.window_ord.iloc[0], "ticker": names, "cluster": average_linkage(d, k)})


def label_scores(distances: DataFrame, labels: DataFrame, sectors: DataFrame) -> DataFrame:
    """window_ord, cluster_count, silhouette_score, adjacent_window_ari (null in the first window), sector_cluster_ari,
    sector_cluster_nmi of the labels (window_ord, ticker, cluster) of every window."""
    x = distances.select("window_ord", F.col("t1").alias("i"), F.col("t2").alias("j"), F.col("dist").alias("d"))
    own = lambda c, name: labels.select("window_ord", F.col("ticker").alias(c), F.col("cluster").alias(name))
    pairs = x.unionByName(x.select("window_ord", F.col("j").alias("i"), F.col("i").alias("j"), "d")).join(own("i", "li"), ["window_ord", "i"]).join(own("j", "lj"), ["window_ord", "j"])
    sil = silhouettes(pairs, 0.0, ("window_ord",)).groupBy("window_ord").agg(F.avg("silhouette").alias("silhouette_score"))
    before = labels.select((F.col("window_ord") + 1).alias("window_ord"), "ticker", F.col("cluster").alias("before"))
    near = adjusted_rand(labels.join(before, ["window_ord", "ticker"]), "cluster", "before", ("window_ord",)).withColumnRenamed("ari", "adjacent_window_ari")
    named = labels.join(sectors, "ticker")
    out = labels.groupBy("window_ord").agg(F.countDistinct("cluster").alias("cluster_count")).join(sil, "window_ord").join(near, "window_ord", "left")
    out = out.join(adjusted_rand(named, "sector", "cluster", ("window_ord",)).withColumnRenamed("ari", "sector_cluster_ari"), "window_ord")
    return out.join(normalized_mutual_information(named, "sector", "cluster", ("window_ord",)).withColumnRenamed("nmi", "sector_cluster_nmi"), "window_ord")
