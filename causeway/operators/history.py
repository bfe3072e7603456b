"""Memory of a trader across campaigns: aggregates of completed campaigns, averaged with decay and shrunk to a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import loss_per_lot, seconds, stop_distance, trader_cluster
from .features import averaged
from .positions import ACCOUNT

def campaign_summary(df: DataFrame) -> DataFrame:
    """One row per (trader_key, campaign_id), all accounts of the trader together: tilt (mean loss per lot of positions opened after two losses or more), stop distances, span in hours, rows. Needs loss_streak."""
    tilt = F.when(F.col("loss_streak") >= 2, loss_per_lot(F.col("profit"), F.col("amount")))
    dist = stop_distance(F.col("open_price"), F.col("sl_price"))
    out = df.filter("trader_key IS NOT NULL").groupBy("trader_key", "campaign_id").agg(
        F.avg(tilt).alias("tilt"), F.count(tilt).alias("n_tilt"), F.sum(dist).alias("sl_sum"), F.count(dist).alias("n_sl"),
        F.min("open_time").alias("first_open"), F.max("close_time").alias("last_close"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("span_hours", seconds(F.col("last_close"), F.col("first_open")) / 3600).drop("first_open", "last_close")


def population(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row: mean tilt, mean stop distance, mean survival over (campaign, trader or account). Fit it on training campaigns: filter df first."""
    tilt = F.when(F.col("loss_streak") >= 2, loss_per_lot(F.col("profit"), F.col("amount")))
    spans = df.groupBy("campaign_id", trader_cluster(F.col("trader_key"), F.col("campaign_id"), F.col("account_id")).alias("who")).agg((seconds(F.max("close_time"), F.min("open_time")) / 3600 / settings.session_hours).alias("survival"))
    means = df.agg(F.avg(tilt).alias("pop_tilt"), F.avg(stop_distance(F.col("open_price"), F.col("sl_price"))).alias("pop_sl"))
    return means.crossJoin(F.broadcast(spans.agg(F.avg("survival").alias("pop_survival"))))  # one row each


def shrunk(raw: Column, n: Column, mean: Column, k: float) -> Column:
    """raw weighted by the positions behind it: n / (n + k)."""
    w = n / (n + F.lit(k))
    return F.when(mean.isNull(), raw).when((n == 0) | raw.isNull(), mean).otherwise(w * raw + (1 - w) * mean)


def trader_memory(summary: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per (trader_key, campaign_id) what the campaigns before it tell: prior_campaigns, raw tilt, stop discipline and survival with their counts.

    The campaign itself and later ones are never visible: frames end at the row before, on a grain of one row per campaign.
    """
    w = Window.partitionBy("trader_key").orderBy("campaign_id")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    alpha = 1 - 0.5 ** (1 / settings.history_half_life)
    summary = averaged(summary, ["trader_key"], ["campaign_id"], "tilt", alpha, F.lit(None).cast("double"), "decayed_")
    return summary.select(
        "trader_key", "campaign_id", (F.row_number().over(w) - 1).cast("long").alias("prior_campaigns"), F.col("decayed_").alias("tilt_raw"), F.coalesce(F.sum("n_tilt").over(prev), F.lit(0)).alias("n_tilt_prior"),
        F.try_divide(F.sum("sl_sum").over(prev), F.sum("n_sl").over(prev)).alias("sl_raw"), F.coalesce(F.sum("n_sl").over(prev), F.lit(0)).alias("n_sl_prior"),
        (F.avg("span_hours").over(prev) / settings.session_hours).alias("survival_raw"), F.coalesce(F.sum("n").over(prev), F.lit(0)).alias("n_prior"),
    )


def trader_history(df: DataFrame, population_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per position: prior_campaigns and the shrunk trader_prior_tilt, _sl_discipline, _survival, and is_cold_start. Traders without key have the population's."""
    memory = trader_memory(campaign_summary(df), settings)
    joined = df.join(memory, ["trader_key", "campaign_id"], "left").crossJoin(F.broadcast(population_rows))  # one row
    zero = F.lit(0).cast("long")
    n = {c: F.coalesce(c, zero) for c in ("n_tilt_prior", "n_sl_prior", "n_prior", "prior_campaigns")}
    k = settings.history_k
    return joined.select(
        *ACCOUNT, "position_id", n["prior_campaigns"].alias("prior_campaigns"), (n["prior_campaigns"] * (F.col("loss_streak") >= 2).cast("long")).alias("prior_campaigns_x_loss_streak_ge_2"),
        shrunk(F.col("tilt_raw"), n["n_tilt_prior"], F.col("pop_tilt"), k).alias("trader_prior_tilt"), shrunk(F.col("sl_raw"), n["n_sl_prior"], F.col("pop_sl"), k).alias("trader_prior_sl_discipline"),
        shrunk(F.col("survival_raw"), n["n_prior"], F.col("pop_survival"), k).alias("trader_prior_survival"), (n["prior_campaigns"] == 0).alias("is_cold_start"),
    )
