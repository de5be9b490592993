"""Chronological prediction of the next window, and what the trend of the windows means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_ROWS, LEAST_FOREST = 12, 20


def lag_frame(metrics: DataFrame, features: list[str], target: str) -> DataFrame:
    """row, window_ord, lagged features and the next target; windows are report-sized, one task orders them."""
    w = W.orderBy("window_ord")
    f = metrics.select("window_ord", *(F.lag(c, 1).over(w).alias(f"lag_{c}") for c in features), F.lead(target, 1).over(w).alias("target")).dropna()
    return f.withColumn("row", F.row_number().over(w))


def split(frame: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds train: the first max(1, floor(share * n)) rows."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    return frame.withColumn("train", F.col("row") <= F.greatest(F.lit(1), F.floor(F.lit(share) * n + F.lit(1e-9))))


def naive(frame: DataFrame) -> DataFrame:
    """Test rows with prediction: the last target of the training rows."""
    last = frame.where("train").agg(F.max_by("target", "row").alias("prediction"))
    return frame.where("not train").crossJoin(F.broadcast(last))  # one row


def scores(predicted: DataFrame) -> DataFrame:
    """mae, rmse, r2 (null for a single row or a constant target)."""
    e = F.col("target") - F.col("prediction")
    g = predicted.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"), (F.var_pop("target") * F.count("*")).alias("_sst"), F.count("*").alias("_n"))
    return g.select("mae", "rmse", F.when(F.col("_n") > 1, 1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def _assembled(frame: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[c for c in frame.columns if c.startswith("lag_")], outputCol="features").transform(frame)


def linear(frame: DataFrame) -> DataFrame:
    """Ordinary least squares with intercept, fitted on the training rows."""
    from pyspark.ml.regression import LinearRegression

    a = _assembled(frame)
    m = LinearRegression(labelCol="target", solver="normal", regParam=0.0).fit(a.where("train"))
    return m.transform(a.where("not train"))


def forest(frame: DataFrame, trees: int = 200, seed: int = 42) -> DataFrame:
    """Random forest with leaves of at least two rows; trees are at most 30 levels deep."""
    from pyspark.ml.regression import RandomForestRegressor

    a = _assembled(frame)
    m = RandomForestRegressor(labelCol="target", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="all", maxDepth=30, seed=seed).fit(a.where("train"))
    return m.transform(a.where("not train"))


def compare(metrics: DataFrame, features: list[str], target: str) -> DataFrame:
    """model, mae, rmse, r2 of all models; no rows with fewer than LEAST_ROWS, no forest with fewer than LEAST_FOREST."""
    f = split(lag_frame(metrics, features, target)).cache()
    n, train = f.count(), f.where("train").count()
    found = [("naive", naive), ("linear", linear)] if n >= LEAST_ROWS else []
    found += [("forest", forest)] if n >= LEAST_ROWS and train >= LEAST_FOREST else []
    out = metrics.sparkSession.createDataFrame([], "model string, mae double, rmse double, r2 double")
    for name, fit in found:
        out = out.unionByName(scores(fit(f)).select(F.lit(name).alias("model"), "mae", "rmse", "r2"))
    return out


#: The names of what the change from the first to the last window means.
TOGETHER, APART, MIXED = "系统性联动增强", "市场分化增强", "结构变化混合，未形成单一方向判断"


def structural_label(metrics: DataFrame) -> DataFrame:
    """One row: the changes (last - first) of five metrics and the name of the direction they share, if any."""
    columns = ["mean_correlation", "market_volatility", "pca_first_component_ratio", "mean_pairwise_distance", "sector_cluster_ari"]
    g = metrics.agg(*((F.max_by(c, "window_ord") - F.min_by(c, "window_ord")).alias(f"{c}_change") for c in columns))
    corr, vol, pc, far, sector = (F.col(f"{c}_change") for c in columns)
    return g.withColumn("label", F.when((corr > 0) & (vol > 0) & (pc > 0), TOGETHER).when((corr < 0) & (far > 0) & (sector > 0), APART).otherwise(MIXED))


def interpretation(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """metric, delta (last - first) and direction."""
    g = metrics.agg(*((F.max_by(c, "window_ord") - F.min_by(c, "window_ord")).alias(c) for c in columns))
    d = g.unpivot([], columns, "metric", "delta")
    return d.withColumn("direction", F.when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling").otherwise("flat"))
