"""Fills to positions, daily bars, and rules on runs of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import seconds, sure

ACCOUNT = ("campaign_id", "account_id")
ORDER = ("open_time", "position_id")


def first_known(value: str, order: Column) -> Column:
    """The first non-null value by a total order. (first() has no order after a shuffle.)"""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def to_positions(fills: DataFrame, tie: str = "tie") -> DataFrame:
    """One row per (campaign_id, position_id).

    First non-null of descriptive columns in closing order (ties by `tie`), last close, sums of amounts (0 if all are
    missing), close price weighted by amount (missing prices count in the weights only), number of fills. One
    aggregation with map-side combining; a position with very many fills is no hot group.
    """
    order = F.struct("close_time", tie)
    first = ("account_id", "open_time", "open_price", "side", "sl_price", "tp_price")
    out = fills.groupBy("campaign_id", "position_id").agg(
        *[first_known(c, order).alias(c) for c in first], F.max("close_time").alias("close_time"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("amount", "profit", "commission")],
        F.sum(F.col("close_price") * F.col("amount")).alias("_pa"), F.sum("amount").alias("_a"), F.count(F.lit(1)).alias("n_fills"),
    )
    return out.withColumn("close_price", F.when(F.col("_a") != 0, F.col("_pa") / F.col("_a"))).withColumn("duration_sec", seconds(F.col("close_time"), F.col("open_time"))).drop("_pa", "_a")


def first_fill_audit(fills: DataFrame, value: str, tie: str = "tie") -> DataFrame:
    """Per position: the value of the literally first fill, the first known one, the last known one, and whether it changed."""
    order = F.struct("close_time", tie)
    out = fills.groupBy("campaign_id", "position_id").agg(F.min_by(value, order).alias("literal_first"), first_known(value, order).alias("first_known"), F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("last_known"))
    return out.withColumn("leaks", F.col("literal_first").isNull() & F.col("first_known").isNotNull()).withColumn("changed", sure(F.col("first_known") != F.col("last_known")))


def bars(ticks: DataFrame) -> DataFrame:
    """(date, at: a total order, price) -> date, open, high, low, close."""
    return ticks.groupBy("date").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"))


def previous_day(df: DataFrame, daily: DataFrame, date: str = "campaign_date") -> DataFrame:
    """gold_vol_prev_day: the range of the calendar day before, over its close. No bar on that very day gives null."""
    vol = daily.select(F.date_add("date", 1).alias(date), F.when(F.col("close") != 0, (F.col("high") - F.col("low")) / F.col("close")).alias("gold_vol_prev_day"))
    return df.join(vol, date, "left")


def flag_grid(df: DataFrame, within_s: float = 30.0) -> DataFrame:
    """grid_flag: three consecutive opens of an account, one side, within 30 s, each at no better a price; all three are flagged (so it looks ahead)."""
    w = Window.partitionBy(*ACCOUNT).orderBy(*ORDER)
    one, two = (lambda c, n=n: F.lag(c, n).over(w) for n in (1, 2))
    falling = (F.col("open_price") <= one("open_price")) & (one("open_price") <= two("open_price"))
    rising = (F.col("open_price") >= one("open_price")) & (one("open_price") >= two("open_price"))
    same = (F.col("side") == one("side")) & (one("side") == two("side")) & (seconds(F.col("open_time"), two("open_time")) <= within_s)
    hit = sure(same & F.when(F.col("side") == "BUY", falling).otherwise(rising))
    return df.withColumn("_hit", hit).withColumn("grid_flag", F.max("_hit").over(w.rowsBetween(0, 2))).drop("_hit")


def account_spans(df: DataFrame) -> DataFrame:
    out = df.groupBy(*ACCOUNT).agg(F.min("open_time").alias("first_open"), F.max("close_time").alias("last_close"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("hours", seconds(F.col("last_close"), F.col("first_open")) / 3600)
