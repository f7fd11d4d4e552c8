"""Ranking fitted orders and models.  Input: fit rows ``(series, window_id, p, d, q, success, aicc, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.guards import div
from tidemark.layout import BY, TIME

ORDER = ("p", "d", "q")
TOP_K = 15


def rank_in_window(fits: DataFrame, by=BY) -> DataFrame:
    """Competition rank by AICc inside each window, successful fits only."""
    w = Window.partitionBy(*by, "window_id").orderBy("aicc")
    return fits.filter("success").withColumn("rank", F.rank().over(w).cast("long"))


def score_orders(fits: DataFrame, by=BY) -> DataFrame:
    g = rank_in_window(fits, by).groupBy(*by, *ORDER).agg(
        F.avg("rank").alias("rank_mean"), F.stddev_samp("rank").alias("rank_std"), F.count("*").alias("count"),
        F.avg("aicc").alias("aicc_mean"), F.stddev_samp("aicc").alias("aicc_std"))
    return g.withColumn("score", F.col("rank_mean") + 0.5 * F.coalesce(F.col("rank_std"), F.lit(0.0)))


def distinct_windows(fits: DataFrame, by=BY) -> DataFrame:
    return fits.groupBy(*by).agg(F.count_distinct("window_id").alias("num_windows"))


def pick_best(scores: DataFrame, by=BY) -> DataFrame:
    """Order with the lowest score, ties to the smallest (p, d, q)."""
    rest = [c for c in scores.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct("score", *ORDER))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def selection_confidence(fits: DataFrame, by=BY) -> DataFrame:
    """The winner with ``confidence`` from how often and how steadily it ranked."""
    best = pick_best(score_orders(fits, by), by).join(distinct_windows(fits, by), [*by])
    steady = F.when(F.col("rank_std") > 0, div(F.lit(1.0), 1.0 + F.col("rank_std"))).otherwise(1.0)
    return best.withColumn("confidence", 0.6 * div(F.col("count"), F.col("num_windows")) + 0.4 * steady)


def top_k_orders(scores: DataFrame, k: int = TOP_K, by=BY) -> DataFrame:
    """The k best orders; the winner is the first of them."""
    w = Window.partitionBy(*by).orderBy("score", *ORDER)
    return (scores.withColumn("position", F.row_number().over(w).cast("long"))
            .filter(F.col("position") <= k))


def distinct_messages(df: DataFrame, message: str, order: str, by=BY) -> DataFrame:
    """One row per message of a series, without repeats, numbered from 1 by first appearance."""
    first = df.filter(F.length(message) > 0).groupBy(*by, message).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(*by).orderBy("_o", message)
    return first.select(*by, F.row_number().over(w).cast("long").alias("position"), F.col(message).alias("message"))


def order_groups(df: DataFrame, by=BY) -> DataFrame:
    """Sorted by series, then time."""
    return df.orderBy(*by, TIME)


def rank_models(models: DataFrame, by=BY) -> DataFrame:
    """Position of each model by AIC, BIC and RMSE; ``best`` marks the lowest AIC."""
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, "model")).cast("long")
    ranked = models.withColumns({"aic_rank": place("aic"), "bic_rank": place("bic"), "rmse_rank": place("rmse")})
    return ranked.withColumn("best", F.col("aic_rank") == 1)
