"""Overlapping named conditions, and outcomes given each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import era, sure
from ..storage import written
from .buckets import edges
from .ranks import quantiles


def small_size_edge(df: DataFrame, settings: Settings = DEFAULT) -> float:
    """The second of the distinct quartile edges of amount over the primary era (where edges fall together, it isn't the first quartile)."""
    found = edges(df.filter(era(F.col("campaign_id"), "primary", settings)), "amount", 4)
    if len(found) < 2:
        raise ValueError("no primary-era amounts to derive the small-size edge from")
    return found[1]


def conditions(small: float) -> dict[str, Column]:
    c = F.col
    late = c("session_pct") > 0.75
    return {
        "baseline (all trades)": F.lit(True), "no SL set": ~c("has_sl"), "loss_streak >= 2": c("loss_streak") >= 2, "loss_streak>=2 AND small_size_flag": (c("loss_streak") >= 2) & (c("amount") <= small),
        "loss_streak >= 3": c("loss_streak") >= 3, "same side after SL hit": c("same_side_after_sl"), "fast re-entry after loss (<=60s)": c("fast_reentry_after_loss"),
        "size escalation (lot_ratio > 1.5)": c("lot_ratio_vs_avg") > 1.5, "near rule-B cliff (lot_ratio > 2.0)": c("lot_ratio_vs_avg") > 2.0, "deep drawdown (dd > 2%)": c("dd_from_peak_pct") > 0.02,
        "late session (session_pct > 0.75)": late, "late + underwater": late & (c("pnl_pct") < 0), "grid-flagged": c("grid_flag"),
    }


def matched(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """A row per row of df and condition that holds; a comparison with a missing value doesn't hold."""
    return df.withColumn("condition", F.explode(F.array_compact(F.array(*[F.when(sure(p), F.lit(n)) for n, p in named.items()]))))


def condition_table(df: DataFrame, named: dict[str, Column], settings: Settings = DEFAULT) -> DataFrame:
    """Per condition: trades, accounts, campaigns, mean loss per lot and whether it clears the hurdle, mean and median reverse profit. Conditions without rows are absent.

    Counts and means combine on the map side; accounts are counted over distinct (condition, campaign, account) rows; medians
    come from values counted and dealt by ranges.
    """
    m = written(matched(df, named).select("condition", "campaign_id", "account_id", "gross_loss_per_lot", "reverse_profit_per_lot"), "matched")
    medians = quantiles(m, ["reverse_profit_per_lot"], [0.5], ["condition"]).select("condition", F.col("quantiles")[0].alias("median_reverse"))
    told = m.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_distinct("campaign_id", "account_id").alias("n_accounts"), F.count_distinct("campaign_id").alias("n_campaigns"),
        F.avg("gross_loss_per_lot").alias("mean_loss_per_lot"), sure(F.avg("gross_loss_per_lot") > settings.hurdle).alias("clears_hurdle"),
        F.avg("reverse_profit_per_lot").alias("mean_reverse"),
    )
    return told.join(F.broadcast(medians), "condition", "left")  # a row per condition


def within_campaigns(df: DataFrame, named: dict[str, Column], least: int = 10, settings: Settings = DEFAULT) -> DataFrame:
    """Per condition over campaigns with at least `least` rows: campaigns, share of them whose mean clears the hurdle, median of their means (of as many values as there are campaigns)."""
    means = matched(df, named).filter("gross_loss_per_lot IS NOT NULL").groupBy("condition", "campaign_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_loss_per_lot").alias("m")).filter(F.col("n") >= least)
    return means.groupBy("condition").agg(F.count(F.lit(1)).alias("campaigns"), F.avg((F.col("m") > settings.hurdle).cast("double")).alias("share_clearing"), F.percentile("m", F.lit(0.5)).alias("median_mean"))


def gate_waterfall(df: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each gate stops that no gate before it stopped, and how many pass all: gate, n."""
    first = F.lit("passed")
    for name, p in reversed(gates):
        first = F.when(sure(p), F.lit(name)).otherwise(first)
    return df.groupBy(first.alias("gate")).agg(F.count(F.lit(1)).alias("n"))
