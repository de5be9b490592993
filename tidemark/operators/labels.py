"""Rule-based names, assignments, transitions, event neighbourhoods and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of market regimes and the bounds they need, in the order they are tried. Each line is a name and
#: alternatives of bounds (column, comparison, value).
REGIME_RULES = [
    ("危机共振状态", [[("market_volatility", ">", 0.32), ("market_max_drawdown", "<", -0.10)], [("market_max_drawdown", "<", -0.14)]]),
    ("高波动调整期", [[("mean_return", "<", 0), ("market_volatility", ">", 0.18)]]),
    ("低波动科技牛市", [[("technology_minus_market", ">", 0.03), ("mean_return", ">", 0), ("market_volatility", "<", 0.18)]]),
    ("科技成长驱动阶段", [[("technology_minus_market", ">", 0.03), ("mean_return", ">", 0)]]),
    ("强复苏扩张阶段", [[("mean_return", ">", 0.10)]]),
    ("低波动牛市", [[("mean_return", ">", 0), ("market_volatility", "<", 0.17), ("mean_correlation", "<", 0.58)]]),
    ("复苏扩张阶段", [[("mean_return", ">", 0)]]),
    ("防御震荡阶段", [[]]),
]
#: The same for profiles of assets.
PROFILE_RULES = [
    ("高收益高波动动量型", [[("avg_return_1y", ">", 0.35), ("avg_momentum_6m", ">", 0.15), ("avg_volatility_1y", ">", 0.28)]]),
    ("高收益稳健动量型", [[("avg_return_1y", ">", 0.35), ("avg_momentum_6m", ">", 0.15)]]),
    ("低波动稳健型", [[("avg_volatility_1y", "<", 0.17), ("avg_max_drawdown_1y", ">", -0.14)]]),
    ("高波动修复型", [[("avg_volatility_1y", ">", 0.31), ("avg_max_drawdown_1y", "<", -0.28), ("avg_momentum_6m", ">", 0)]]),
    ("高风险下行型", [[("avg_volatility_1y", ">", 0.31), ("avg_max_drawdown_1y", "<", -0.28), ("avg_momentum_6m", "<=", 0)]]),
    ("防御修复型", [[("avg_return_1y", "<", 0), ("avg_momentum_6m", ">", 0)]]),
    ("低波动承压型", [[("avg_volatility_1y", "<", 0.18), ("avg_return_1y", "<", 0.08), ("avg_momentum_6m", "<", 0)]]),
    ("弱动量承压型", [[("avg_return_1y", "<", 0.05), ("avg_momentum_6m", "<", 0)]]),
    ("成长波动型", [[("avg_return_1y", ">", 0.18), ("avg_volatility_1y", ">", 0.24)]]),
    ("深度价值反弹型", [[("avg_return_1y", "<", 0), ("avg_max_drawdown_1y", "<", -0.25)]]),
    ("均衡核心型", [[]]),
]


def rule_sql(rules) -> str:
    """The rules as one SQL CASE, which both Spark and other engines read."""
    line = lambda bounds: " AND ".join(f"{c} {op} {v}" for c, op, v in bounds) or "TRUE"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'({line(b)})' for b in ways)} THEN '{name}'" for name, ways in rules) + " END"


def by_rules(rules) -> Column:
    return F.expr(rule_sql(rules))


def name_regimes(snapshots: DataFrame, features: list[str]) -> DataFrame:
    """label, regime_name of each cluster: the rule its means meet, a letter by label, a number for repeated names."""
    g = snapshots.groupBy("label").agg(*(F.avg(c).alias(c) for c in features)).withColumn("_name", by_rules(REGIME_RULES))
    nth = F.row_number().over(W.partitionBy("_name").orderBy("label"))
    letter = F.chr(F.lit(64) + F.row_number().over(W.orderBy("label")))  # clusters only
    return g.select("label", F.concat(F.lit("Regime "), letter, F.lit("："), F.col("_name"), F.when(nth > 1, F.concat(F.lit(" "), nth.cast("string"))).otherwise("")).alias("regime_name"))


def transitions(labelled: DataFrame) -> DataFrame:
    """from_window, to_window, from_label, to_label, changed of neighbouring windows (ordinals only pass one task)."""
    w = W.orderBy("window_ord")
    t = labelled.select(F.col("window_ord").alias("from_window"), F.lead("window_ord").over(w).alias("to_window"), F.col("label").alias("from_label"), F.lead("label").over(w).alias("to_label"))
    return t.where("to_window is not null").withColumn("changed", F.col("from_label") != F.col("to_label"))


def transition_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))


def event_neighbourhoods(labelled: DataFrame, events: DataFrame, days: int = 45) -> DataFrame:
    """name, windows, changes, labels: windows that end within ``days`` of an event's start or during it.

    events: name, start_date, end_date, a few rows. labelled: window_ord, end_date, label.
    """
    w = labelled.select("window_ord", F.col("end_date").alias("at"), "label", F.lag("label").over(W.orderBy("window_ord")).alias("before"))
    e = F.broadcast(events.select("name", "start_date", "end_date"))
    near = (F.abs(F.date_diff("at", "start_date")) <= days) | F.col("at").between(F.col("start_date"), F.col("end_date"))
    j = e.join(w, near, "left")
    return j.groupBy("name").agg(F.count("window_ord").alias("windows"), F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("label"))).alias("changes"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ";").alias("labels"))


def latest_network(panel: DataFrame, size: int, most: int = 60, above: float = 0.62) -> DataFrame:
    """t1, t2, corr: edges above a threshold among the first tickers in the last ``size`` simple returns."""
    from ..functions.stats import guarded_corr

    last = panel.select("date").distinct().orderBy(F.col("date").desc()).limit(size + 1)
    names = panel.select("ticker").distinct().orderBy("ticker").limit(most)
    p = panel.join(last, "date", "left_semi").join(names, "ticker", "left_semi")
    r = p.withColumn("ret", F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("date")) - 1).where("ret is not null")
    a, b = r.select("date", F.col("ticker").alias("t1"), F.col("ret").alias("a")), r.select("date", F.col("ticker").alias("t2"), F.col("ret").alias("b"))
    return a.join(b, "date").where("t1 < t2").groupBy("t1", "t2").agg(guarded_corr(F.col("a"), F.col("b")).alias("corr")).where(F.col("corr") > above)


def profiles(df: DataFrame, features: list[str], prefix: str = "") -> DataFrame:
    """label, n and the mean of each feature."""
    return df.groupBy("label").agg(F.count("*").alias("n"), *(F.avg(c).alias(prefix + c) for c in features))


def asset_profiles(df: DataFrame, features: list[str], most: int = 8) -> DataFrame:
    """label, n, means, the first tickers in input order (ord), and the profile's name."""
    g = df.groupBy("label").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"avg_{c}") for c in features), F.array_sort(F.collect_list(F.struct("ord", "ticker"))).alias("_t"))
    first = F.array_join(F.transform(F.slice("_t", 1, most), lambda s: s["ticker"]), ", ")
    return g.withColumn("representatives", first).drop("_t").withColumn("profile_name", by_rules(PROFILE_RULES))


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A report-sized table as Markdown, floats with four digits."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).collect()])
