"""Decisions on raw trades in one call: names put right, features from each account's state as it was, a decision, then the update.

A row's features are taken before its own outcome enters the account's state. Rows enter in opening order, each right
after its own decision, and only if the batch tells an outcome (a close and a profit): a position without one is decided
on, but later rows don't see it. A batch of finished positions is read as if each had closed before the next one opened.
With known_at_open an outcome waits until it has happened: it enters before the first row that opens after its close.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, Settings
from ..functions.exprs import challenge, exit_type, net_or_parts
from ..storage import written
from . import model
from .compare import canonical

# Names of the raw columns by the library's own, and types.
RAW_NAMES = {
    "campaign_id": ["campaignId"], "account_id": ["accountId"], "position_id": ["positionId"], "open_time": ["openDateTime"], "close_time": ["closeDateTime", "closeTime"], "amount": [], "side": [],
    "profit": [], "commission": [], "swap": [], "net_profit": ["netProfit"], "close_price": ["closePrice"], "sl_price": ["slPrice"], "tp_price": ["tpPrice"], "exit_type": ["exitType"], "trader_key": ["traderKey"],
    "shared_ip": ["sharedIpFlag"], "ip_cluster_size": ["ipClusterSize"], "challenge_type": ["challenge_type_id"], "gold_vol_prev_day": [], "position_key": [],
}
_TYPES = {"campaign_id": "int", "open_time": "timestamp_ntz", "close_time": "timestamp_ntz", "shared_ip": "boolean", **dict.fromkeys(("amount", "profit", "commission", "swap", "net_profit", "close_price", "sl_price", "tp_price", "ip_cluster_size", "gold_vol_prev_day"), "double")}
REQUIRED = ("campaign_id", "account_id", "open_time", "amount")


def trades(df: DataFrame) -> DataFrame:
    """Raw trades under the library's names: outcomes and exits filled in as far as they can be told, input_order the order of the rows of df.

    Of a column's several names each is used where those before it are missing or null. Columns that are missing
    altogether are null; a missing required one raises.
    """
    if missing := [n for n in REQUIRED if not {n, *RAW_NAMES[n]} & set(df.columns)]:
        raise ValueError(f"missing columns {missing}")
    own = canonical(df.select(*df.columns, F.monotonically_increasing_id().alias("input_order")), RAW_NAMES)
    own = own.select("input_order", *[F.col(c).cast(_TYPES[c]) if c in _TYPES else F.col(c).cast("string") if c in ("side", "exit_type", "trader_key", "position_key") else F.col(c) for c in RAW_NAMES])
    own = own.withColumns({"net_profit": net_or_parts(F.col("net_profit"), F.col("profit"), F.col("commission"), F.col("swap")), "exit_type": F.coalesce("exit_type", exit_type(F.col("close_price"), F.col("sl_price"), F.col("tp_price"))), "challenge_type": challenge(F.col("challenge_type")), "shared_ip": F.coalesce("shared_ip", F.lit(False))})
    key = F.concat(F.col("campaign_id").cast("string"), F.lit("::"), F.coalesce(F.col("position_id").cast("string"), F.col("input_order").cast("string")))
    return own.withColumn("position_key", F.coalesce("position_key", key))


def prior_campaigns(rows: DataFrame) -> DataFrame:
    """rows with prior_campaigns: how many earlier campaigns its trader occurs in; 0 without a trader."""
    each = rows.filter("trader_key IS NOT NULL").select("trader_key", "campaign_id").distinct()
    counted = each.withColumn("prior_campaigns", (F.row_number().over(Window.partitionBy("trader_key").orderBy("campaign_id")) - 1).cast("long"))
    return rows.join(counted, ["trader_key", "campaign_id"], "left").withColumn("prior_campaigns", F.coalesce("prior_campaigns", F.lit(0).cast("long")))


CONTEXT = ("shared_ip", "ip_cluster_size", "challenge_type", "gold_vol_prev_day")
STATE = (
    "loss_streak long, win_streak long, pnl_ewm double, lot_zscore double, size_after_loss_delta double, sl_usage_rate_5 double, manual_exit_rate_5 double, cum_pnl_usd double, dd_from_peak_usd double, "
    "trade_index long, log_dt_close double, entry_gap_sec double, trades_per_hour double, same_direction_reentry int, size_delta_ratio double"
)


class State:
    """An account as far as its outcomes are known. Missing amounts count as rows, but neither as sizes nor for their spread."""

    def __init__(self, context: tuple):
        self.context = context
        self.n = self.losses = self.wins = self.sized = 0
        self.ewm = self.total = self.peak = self.mean = self.squares = 0.0
        self.least, self.most = math.inf, -math.inf
        self.before_run = self.first = self.close = self.net = self.side = self.amount = None
        self.last5: deque = deque(maxlen=5)
        self.closing: list = []  # outcomes that haven't happened yet: (close, order, row)

    def features(self, r) -> tuple:
        spread = math.sqrt(self.squares / self.sized) if self.sized >= 3 and self.least < self.most else 0.0
        rate = lambda k: sum(x[k] for x in self.last5) / len(self.last5) if self.n >= 3 else None
        gap = max((r.open_time - self.close).total_seconds(), 0.0) if self.n else None
        hours = max((r.open_time - self.first).total_seconds() / 3600, 1 / 60) if self.n else 1 / 60
        return (
            self.losses, self.wins, self.ewm, (r.amount - self.mean) / spread if spread else None, r.amount - self.before_run if self.losses and self.before_run is not None else None, rate(0), rate(1), self.total, self.peak - self.total,
            self.n + 1, math.log1p(gap) if gap is not None else None, gap, (self.n + 1) / hours, int(bool(self.n and self.net < 0 and r.side is not None and r.side == self.side)), r.amount / self.amount if self.n and self.amount else None,
        )

    def update(self, r, alpha: float) -> None:
        x = r.net_profit
        if x < 0 and not self.losses:
            self.before_run = self.mean if self.sized else None
        self.losses, self.wins = (self.losses + 1, 0) if x < 0 else (0, self.wins + 1) if x > 0 else (0, 0)
        self.ewm, self.total = alpha * x + (1 - alpha) * self.ewm, self.total + x
        self.peak = max(self.peak, self.total)
        self.n += 1
        if not pd.isna(r.amount):
            self.sized += 1
            delta = r.amount - self.mean
            self.mean += delta / self.sized
            self.squares += delta * (r.amount - self.mean)
            self.least, self.most = min(self.least, r.amount), max(self.most, r.amount)
        self.first = r.open_time if self.first is None else min(self.first, r.open_time)
        self.last5.append((not pd.isna(r.sl_price), r.exit_type == "manual"))
        self.close, self.net, self.side, self.amount = r.close_time, x, r.side, None if pd.isna(r.amount) else r.amount

    def closed_before(self, now, alpha: float) -> None:
        while self.closing and self.closing[0][0] < now:
            self.update(heapq.heappop(self.closing)[2], alpha)

    def waits(self, r) -> None:
        heapq.heappush(self.closing, (r.close_time, r.input_order, r))


def live_features(rows: DataFrame, settings: Settings = DEFAULT, known_at_open: bool = False) -> DataFrame:
    """rows (from trades, with prior_campaigns) -> keys, STATE and what follows from it, one row per row.

    Where every row has a close and a profit, these are the batch features of the same names. Rows are taken by account and opening time (ties by position, then input). Context is that of the account's first
    row. A row without an account is an account of its own. State is carried from batch to batch.
    """
    keep = ["input_order", "position_key", "campaign_id", "account_id", "position_id", "amount", "side", "prior_campaigns"]
    read = [*keep, *CONTEXT, "open_time", "close_time", "net_profit", "sl_price", "exit_type"]
    lone = F.when(F.col("account_id").isNull(), F.col("input_order"))
    dealt = rows.select(*read, lone.alias("lone")).repartition("campaign_id", "account_id", "lone").sortWithinPartitions("campaign_id", "account_id", "lone", "open_time", "position_id", "input_order")
    names = [f.name for f in StructType.fromDDL(STATE)]
    schema = StructType([*rows.select(*keep, *CONTEXT).schema.fields, *StructType.fromDDL(STATE).fields])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            context, made = [], []
            for r in batch.itertuples(index=False):
                own = (r.campaign_id, None if pd.isna(r.account_id) else r.account_id, None if pd.isna(r.lone) else r.lone)
                if own != key:
                    key, state = own, State(tuple(getattr(r, c) for c in CONTEXT))
                if known_at_open:
                    state.closed_before(r.open_time, settings.ewm_alpha)
                context.append(state.context)
                made.append(state.features(r))
                if not pd.isna(r.close_time) and not pd.isna(r.net_profit):
                    if known_at_open:
                        state.waits(r)
                    else:
                        state.update(r, settings.ewm_alpha)
            yield pd.concat([batch[keep], pd.DataFrame(context, columns=list(CONTEXT), index=batch.index), pd.DataFrame(made, columns=names, index=batch.index)], axis=1)

    out = dealt.mapInPandas(fold, schema)
    return out.withColumns({
        "pnl_pct": F.col("cum_pnl_usd") / settings.balance, "dd_from_peak_pct": F.col("dd_from_peak_usd") / settings.balance, "breach_proximity_usd": F.lit(settings.balance * settings.breach_share) - F.col("dd_from_peak_usd"),
        "target_proximity_usd": F.lit(settings.balance * settings.target_share) - F.col("cum_pnl_usd"), "prior_campaigns_x_loss_streak_ge_2": F.col("prior_campaigns") * (F.col("loss_streak") >= 2).cast("long"),
    })


def predict(df: DataFrame, artifact: dict, settings: Settings = DEFAULT, every_level: bool = True, known_at_open: bool = False) -> DataFrame:
    """A decision per row of df, in its order: input_order, position_key, decision, score, expected_absolute, confidence, triggering_features.

    df has raw trades under the names of the exports or the library's. Categories that the artifact doesn't know raise,
    and with every_level so does a batch that lacks one that it knows. No rows give none.
    """
    model.check_columns([*artifact["numeric"], *artifact["levels"]])
    rows = written(trades(df), "trades")  # the order is fixed from here on
    features = written(live_features(prior_campaigns(rows), settings, known_at_open), "live_features")
    model.unseen_levels(features, model.design_of(artifact), every_level and bool(features.take(1)))
    return model.decide(features, artifact).select("input_order", "position_key", "decision", "score", "expected_absolute", "confidence", "triggering_features").orderBy("input_order")
