"""Account state over a stream of positions: the same features as the batch windows, emitted as event time passes.

Rows of an account may come in any order. They wait in the account's state until the watermark has passed their open
time, and are then taken in (open_time, position_id) order: features first, from the state before the row, then the row
updates the state if its close and net profit are known. Rows that open no later than one already taken are too late:
they come out marked late, without features, and change nothing. A row without an account is an account of its own.

Traders have states of their own, in a key space beside the accounts': which campaigns they have been seen in. States of
either kind can be let go once nothing has happened for so long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROW = "position_id long, open_us long, close_us long, amount double, side string, net_profit double"
STATE = "n long, losses long, wins long, cum double, peak double, ewm double, close_us long, net double, side string, amount double, first_us long, last_us long, last_id long"
OUT = "campaign_id int, account_id long, position_id long, late boolean, trade_index long, loss_streak long, win_streak long, pnl_ewm double, cum_pnl_usd double, dd_from_peak_usd double, entry_gap_sec double, trades_per_hour double, same_direction_reentry int, size_delta_ratio double"
FRESH = (0, 0, 0, 0.0, 0.0, 0.0, None, None, None, None, None, None, None)


def step(s: tuple, row: tuple, alpha: float = 0.3) -> tuple[tuple, tuple]:
    """(features of row from state s, the state after it)."""
    n, losses, wins, cum, peak, ewm, close, net, side, amount, first, _, _ = s
    pid, opened, closed, size, way, profit = row
    gap = max(0.0, (opened - close) / 1e6) if close is not None else None
    hours = max((opened - first) / 3.6e9, 1 / 60) if first is not None else 1 / 60
    out = (pid, False, n + 1, losses, wins, ewm, cum, peak - cum, gap, (n + 1) / hours, int(net is not None and net < 0 and side == way), size / amount if amount else None)
    first = opened if first is None else first
    if profit is None or closed is None:
        return out, (n + 1, losses, wins, cum, peak, ewm, closed if closed is not None else close, profit, way, size, first, opened, pid)
    cum += profit
    after = (n + 1, losses + 1 if profit < 0 else 0, wins + 1 if profit > 0 else 0, cum, max(peak, cum), alpha * profit + (1 - alpha) * ewm, closed, profit, way, size, first, opened, pid)
    return out, after


def _none(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) or v is pd.NA or v is pd.NaT else v


class Ordered(StatefulProcessor):
    """Rows of a key in (open_us, position_id) order, once the watermark has passed their open time.

    row, state, out: column lists; a row begins with position_id and open_us, a state ends with open_us and position_id
    of the last row taken, and out begins with the key's columns, position_id and late. forget_us: a row that opens more
    than so many microseconds after the one before starts anew, and a state is cleared once no other row can come
    (None: never).
    """

    row, state_columns, out = "", "", ""
    fresh: tuple = ()

    def __init__(self, forget_us: int | None = None):
        self.forget_us = forget_us

    def step(self, s: tuple, row: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def named(self, key: tuple) -> tuple:
        """The key's columns of out."""
        return key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_columns)
        self.waiting = handle.getListState("waiting", self.row)

    def _take(self, key, rows: list[tuple], upto_us: int) -> Iterator[pd.DataFrame]:
        s = tuple(_none(v) for v in self.state.get()) if self.state.exists() else self.fresh
        names = [c.split(" ")[0] for c in self.out.split(", ")]
        keys = names.index("position_id")
        made, keep, had = [], [], s
        for row in sorted(rows, key=lambda r: (r[1], r[0])):
            if s[-2] is not None and (row[1], row[0]) <= (s[-2], s[-1]):
                made.append((row[0], True, *[None] * (len(names) - keys - 2)))
            elif row[1] <= upto_us:
                if self.forget_us is not None and s[-2] is not None and row[1] - s[-2] > self.forget_us:
                    s = self.fresh
                one, s = self.step(s, row)
                made.append((row[0], False, *one))
            else:
                keep.append(row)
        if s is not had:
            self.state.update(s)
        self.waiting.clear()
        if keep:
            self.waiting.put(keep)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if keep:
            self.handle.registerTimer(min(r[1] for r in keep) // 1000 + 1)
        elif self.forget_us is not None and s[-2] is not None:
            self.handle.registerTimer(max(s[-2] + self.forget_us, upto_us) // 1000 + 1)
        if made:
            frame = pd.DataFrame(made, columns=names[keys:])
            for i, v in enumerate(self.named(key)):
                frame.insert(i, names[i], v if isinstance(v, str) else pd.array([v] * len(frame), dtype="Int64"))
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(_none(v) for v in r) for batch in rows for r in batch[[c.split(" ")[0] for c in self.row.split(", ")]].itertuples(index=False, name=None)]
        yield from self._take(key, self._held() + new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs() * 1000, self._held()
        if self.forget_us is not None and not held and self.state.exists() and int(tuple(self.state.get())[-2]) + self.forget_us <= now:
            self.state.clear()
            return
        yield from self._take(key, held, now)

    def _held(self) -> list[tuple]:
        return [tuple(_none(v) for v in r) for r in self.waiting.get()] if self.waiting.exists() else []

    def close(self) -> None:
        pass


ACCOUNT = "account "


class AccountState(Ordered):
    row, state_columns, out, fresh = ROW, STATE, OUT, FRESH

    def named(self, key: tuple) -> tuple:
        return key[0], int(key[1].removeprefix(ACCOUNT)) if key[1].startswith(ACCOUNT) else None

    def step(self, s: tuple, row: tuple) -> tuple[tuple, tuple]:
        out, after = step(s, row)
        return out[2:], after


class TraderState(Ordered):
    """The campaigns that a trader has been seen in, comma-joined."""

    row, state_columns = "position_id long, open_us long, campaign_id int", "seen string, last_us long, last_id long"
    out, fresh = "trader_key string, position_id long, late boolean, prior_campaigns long", ("", None, None)

    def step(self, s: tuple, row: tuple) -> tuple[tuple, tuple]:
        seen = {int(x) for x in s[0].split(",") if x}
        return (sum(c < row[2] for c in seen),), (",".join(map(str, sorted(seen | {row[2]}))), row[1], row[0])


def _forget(forget_s: float | None) -> int | None:
    return None if forget_s is None else int(forget_s * 1e6)


def stream_features(stream: DataFrame, delay: str = "1 hour", forget_s: float | None = None) -> DataFrame:
    """A stream of positions (open_time with or without zone) -> OUT. Needs the RocksDB state store; delay is how late rows may come, forget_s after how long without a position an account starts anew (never, by default)."""
    # one text, as null keys of several columns run into each other
    who = F.coalesce(F.concat(F.lit(ACCOUNT), F.col("account_id").cast("string")), F.concat(F.lit("row "), F.col("position_id").cast("string"))).alias("who")
    rows = stream.select("campaign_id", who, F.col("open_time").cast("timestamp").alias("event_time"), "position_id", F.unix_micros(F.col("open_time").cast("timestamp")).alias("open_us"), F.unix_micros(F.col("close_time").cast("timestamp")).alias("close_us"), "amount", "side", "net_profit")
    keyed = rows.withWatermark("event_time", delay).groupBy("campaign_id", "who")
    return keyed.transformWithStateInPandas(AccountState(_forget(forget_s)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def stream_prior_campaigns(stream: DataFrame, delay: str = "1 hour", forget_s: float | None = None) -> DataFrame:
    """A stream of positions -> trader_key, position_id, late, prior_campaigns: in how many earlier campaigns its trader has been seen. Rows without a trader are left out; they have none."""
    rows = stream.filter("trader_key IS NOT NULL").select(F.col("trader_key").cast("string").alias("trader_key"), F.col("open_time").cast("timestamp").alias("event_time"), "position_id", F.unix_micros(F.col("open_time").cast("timestamp")).alias("open_us"), "campaign_id")
    keyed = rows.withWatermark("event_time", delay).groupBy("trader_key")
    return keyed.transformWithStateInPandas(TraderState(_forget(forget_s)), outputStructType=TraderState.out, outputMode="Append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_step_stream(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Opens per campaign, side and tumbling window, with late rows bounded by a watermark."""
    return stream.withColumn("event_time", F.col("open_time").cast("timestamp")).withWatermark("event_time", delay).groupBy("campaign_id", "side", F.window("event_time", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("account_id").alias("accounts"))
