"""The first-stage state vector of a position, and trade ideas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import loss_per_lot, reverse_per_lot, seconds, sure
from .features import by_account, prepared, prev
from .positions import ACCOUNT, flag_grid

#: Columns that look past the row; they serve description, never scoring.
NON_CAUSAL = ("session_pct", "trades_remaining_est", "grid_flag")


def state_vectors(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """df with the state columns of each position: streak and equity before it, clock, sizes against earlier ones, re-entry and grid flags, and outcomes per lot."""
    whole = Window.partitionBy(*ACCOUNT)
    hours = seconds(F.col("open_time"), F.min("open_time").over(whole)) / 3600
    span = seconds(F.max("close_time").over(whole), F.min("open_time").over(whole)) / 3600
    gap = seconds(F.col("open_time"), F.lag("close_time").over(by_account()))
    high, low = F.max("amount").over(prev()), F.min("amount").over(prev())
    ratio = F.greatest(high, "amount") / F.when(F.least(low, F.col("amount")) != 0, F.least(low, F.col("amount")))
    out = prepared(flag_grid(df)).withColumns({
        "hrs_elapsed": hours, "span_": span, "gap_raw_": gap, "atlsr_ratio_if_filled": F.when(F.col("ti_") > 1, ratio), "n_": F.count(F.lit(1)).over(whole),
        "prev_exit_": F.lag("exit_type").over(by_account()),
    })
    first = F.col("ti_") == 1
    drop = [c for c in out.columns if c.endswith("_")]
    return out.withColumns({
        "loss_streak": F.col("streak_"), "win_streak": F.col("win_streak_"), "trade_index": F.col("ti_").cast("long"), "cum_pnl_usd": F.col("cum_prev_"),
        "pnl_pct": F.col("cum_prev_") / settings.balance, "dd_from_peak_pct": F.col("dd_") / settings.balance,
        "dist_to_target": F.lit(settings.target_share) - F.col("cum_prev_") / settings.balance, "dist_to_dd_limit": F.lit(settings.breach_share) - F.col("dd_") / settings.balance,
        "hrs_remaining_24h": F.greatest(F.lit(0.0), F.lit(24.0) - F.col("hrs_elapsed")), "session_pct": F.when(F.col("span_") > 0, F.least(F.lit(1.0), F.col("hrs_elapsed") / F.col("span_"))),
        "trades_remaining_est": (F.col("n_") - F.col("ti_")).cast("long"), "lot_ratio_vs_avg": F.when(F.col("mean_amt_") != 0, F.col("amount") / F.col("mean_amt_")),
        "rule_b_breach_if_filled": sure(~first & (F.col("atlsr_ratio_if_filled") > 2.5)), "dt_since_last_close_s": F.col("gap_raw_"),
        "fast_reentry_after_loss": sure((F.col("prev_net_") < 0) & (F.col("gap_raw_") <= 60)), "same_side_after_sl": sure((F.col("prev_exit_") == "sl_hit") & (F.col("prev_side_") == F.col("side"))),
        "has_sl": F.col("sl_price").isNotNull(), "gross_loss_per_lot": loss_per_lot(F.col("profit"), F.col("amount")), "reverse_profit_per_lot": reverse_per_lot(F.col("profit"), F.col("amount"), settings.hurdle),
    }).withColumn("clears_hurdle", sure(F.col("gross_loss_per_lot") > settings.hurdle)).drop(*drop)


IDEA_S = 180.0


def ideas(df: DataFrame, within_s: float = IDEA_S) -> DataFrame:
    """keep and idea_id: a position belongs to the idea before it if it opens within three minutes of that idea's first open, on the side of the row before, and not later than three minutes after the close before.

    The anchor depends on the run so far, so this is a fold in order. Rows come sorted by account; the fold carries one
    row of state from batch to batch, so an account of any length takes no more memory than a batch.
    """
    cols = [*ACCOUNT, "position_id", "open_time", "close_time", "side"]
    rows = df.select(*cols).repartition(*[F.col(c) for c in ACCOUNT]).sortWithinPartitions(*ACCOUNT, "open_time", "position_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, anchor, close, side, idea = None, None, None, None, 0
        for batch in batches:
            out = []
            for a, b, opened, closed, s in zip(batch["campaign_id"], batch["account_id"], batch["open_time"], batch["close_time"], batch["side"], strict=True):
                if (a, b) != account:
                    account, idea, anchor = (a, b), 1, opened
                elif not ((opened - anchor).total_seconds() <= within_s and s == side and (pd.isna(close) or (opened - close).total_seconds() <= within_s)):
                    idea, anchor = idea + 1, opened
                close, side = closed, s
                out.append(idea)
            yield batch[[*ACCOUNT, "position_id"]].assign(idea_id=pd.Series(out, index=batch.index, dtype="int64"))

    return rows.mapInPandas(fold, df.select(*ACCOUNT, "position_id").schema.add("idea_id", "long"))
