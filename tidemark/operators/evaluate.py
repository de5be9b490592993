"""Cluster scores and agreement, from labels given as columns.

Points have the columns id, x (array<double>) and label. Pairs of points are needed by definition for the silhouette;
everything else is a plain aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import distance, ratio, square_distance


def centroids(points: DataFrame) -> DataFrame:
    """label, size, centre."""
    e = points.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"), F.count("*").alias("size"))
    g = e.groupBy("label").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))
    return g.select("label", "size", F.transform("c", lambda s: s["v"]).alias("centre"))


def pair_distances(points: DataFrame) -> DataFrame:
    """i, li, j, lj, d of every ordered pair (the definition of a silhouette needs them all)."""
    a = points.select(F.col("id").alias("i"), F.col("label").alias("li"), F.col("x").alias("xi"))
    b = points.select(F.col("id").alias("j"), F.col("label").alias("lj"), F.col("x").alias("xj"))
    return a.crossJoin(b).where("i <> j").select("i", "li", "j", "lj", distance(F.col("xi"), F.col("xj")).alias("d"))


def silhouettes(pairs: DataFrame, singleton: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys), id, label, silhouette. singleton: the score of a point alone in its cluster (1, or 0 by another convention).

    ``pairs`` may hold any distance, as i, li, j, lj, d.
    """
    m = pairs.groupBy(*keys, "i", "li", "lj").agg(F.avg("d").alias("m"))
    g = m.groupBy(*keys, "i", "li").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("m"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("m"))).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(0.0)).when(F.col("a").isNull(), F.lit(singleton)).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return g.select(*keys, F.col("i").alias("id"), F.col("li").alias("label"), s.alias("silhouette"))


def silhouette(points: DataFrame, singleton: float = 1.0) -> DataFrame:
    """One row: the mean silhouette; 0 with fewer than two clusters."""
    return silhouettes(pair_distances(points), singleton).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


def davies_bouldin(points: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row: davies_bouldin; a distance of 0 between centroids counts as eps."""
    c = centroids(points)
    s = points.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(distance(F.col("x"), F.col("centre"))).alias("s"))
    k = c.join(s, "label").select("label", "centre", "s")
    a, b = k.select(*(F.col(x).alias(f"{x}1") for x in k.columns)), k.select(*(F.col(x).alias(f"{x}2") for x in k.columns))
    d = distance(F.col("centre1"), F.col("centre2"))
    r = a.crossJoin(F.broadcast(b)).where("label1 <> label2").withColumn("r", (F.col("s1") + F.col("s2")) / F.when(d == 0, F.lit(eps)).otherwise(d))  # clusters only
    return r.groupBy("label1").agg(F.max("r").alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def inertia(points: DataFrame) -> DataFrame:
    """One row: inertia, the sum of square distances to the centroids."""
    return points.join(F.broadcast(centroids(points)), "label").agg(F.sum(square_distance(F.col("x"), F.col("centre"))).alias("inertia"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row: calinski_harabasz; 0 with fewer than two clusters, no more points than clusters or no spread within."""
    c = centroids(points)
    whole = centroids(points.withColumn("label", F.lit(0))).select(F.col("centre").alias("mid"))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("size") * square_distance(F.col("centre"), F.col("mid"))).alias("b"), F.count("*").alias("k"), F.sum("size").alias("n"))
    v = between.crossJoin(F.broadcast(inertia(points)))
    ok = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("inertia") > 0)
    return v.select(F.when(ok, F.try_divide(F.col("b"), (F.col("k") - 1).cast("double")) / F.try_divide(F.col("inertia"), (F.col("n") - F.col("k")).cast("double"))).otherwise(F.lit(0.0)).alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def _margins(df: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    c = contingency(df, a, b, keys)
    return c.withColumn("na", F.sum("n").over(W.partitionBy(*keys, "a"))).withColumn("nb", F.sum("n").over(W.partitionBy(*keys, "b"))).withColumn("ra", F.row_number().over(W.partitionBy(*keys, "a").orderBy("b"))).withColumn("rb", F.row_number().over(W.partitionBy(*keys, "b").orderBy("a")))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """ari of two labelings, per keys; 1 where both are trivial."""
    two = lambda x: x * (x - 1) / 2
    n = F.col("n")
    g = _margins(df, a, b, keys).groupBy(*keys).agg(
        F.sum(two(n)).alias("s"), F.sum(F.when(F.col("ra") == 1, two(F.col("na"))).otherwise(0.0)).alias("sa"), F.sum(F.when(F.col("rb") == 1, two(F.col("nb"))).otherwise(0.0)).alias("sb"), F.sum(n).alias("t")
    )
    expected = ratio(F.col("sa") * F.col("sb"), two(F.col("t")))
    return g.select(*keys, F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """nmi, normalised by the arithmetic mean of the entropies; 1 where both are constant."""
    m = _margins(df, a, b, keys).withColumn("t", F.sum("n").over(W.partitionBy(*keys)) if keys else F.sum("n").over(W.partitionBy(F.lit(0))))
    h = lambda x: -(x / F.col("t")) * F.log(x / F.col("t"))
    g = m.groupBy(*keys).agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(F.when(F.col("ra") == 1, h(F.col("na"))).otherwise(0.0)).alias("ha"),
        F.sum(F.when(F.col("rb") == 1, h(F.col("nb"))).otherwise(0.0)).alias("hb"),
    )
    return g.select(*keys, F.when((F.col("ha") + F.col("hb")) == 0, F.lit(1.0)).otherwise(ratio(F.col("mi"), (F.col("ha") + F.col("hb")) / 2)).alias("nmi"))
