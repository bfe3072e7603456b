"""What was known when a position opened, under the strict reading: only positions that had closed by then count as outcomes.

An account's positions come in opening order. Each enters the history when it opens, and its outcome becomes visible
when it closes, which may be after later positions opened; features of outcomes fold the visible ones in opening order.
One pass carries this state from batch to batch: what lies before the earliest open position is summed up, and the rest
is kept in blocks of summaries that can be joined, so that a long open position costs no rescan of all after it.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import DEFAULT, Settings
from .positions import ACCOUNT, ORDER

BLOCK = 64


class Seen(NamedTuple):
    """A summary of closed positions in opening order; `joined` puts one behind another."""

    n: int = 0
    losses: int = 0  # trailing run, missing outcomes passed over
    wins: int = 0
    all_losses: bool = True
    all_wins: bool = True
    keep: float = 1.0  # the average after is keep * before + add
    add: float = 0.0
    total: float = 0.0
    top: float = -math.inf  # the highest running total
    last5: tuple = ()  # (has a stop, was closed by hand)
    run_start: tuple | None = None  # (mean amount before it opened,) of the first of the trailing losses; a missing outcome ends a run here
    all_run: bool = True
    last: tuple | None = None  # (close_time, outcome)


def joined(a: Seen, b: Seen) -> Seen:
    if not b.n:
        return a
    if not a.n:
        return b
    return Seen(
        a.n + b.n, b.losses + (a.losses if b.all_losses else 0), b.wins + (a.wins if b.all_wins else 0), a.all_losses and b.all_losses, a.all_wins and b.all_wins, a.keep * b.keep, b.keep * a.add + b.add,
        a.total + b.total, max(a.top, a.total + b.top), (a.last5 + b.last5)[-5:], a.run_start if b.all_run and a.run_start else b.run_start, a.all_run and b.all_run, b.last,
    )


def outcome(alpha: float, close, net: float, stop: bool, by_hand: bool, mean_before: float | None) -> Seen:
    """The summary of one closed position; a missing outcome is NaN."""
    known, loss, win = net == net, net < 0, net > 0
    return Seen(
        1, int(loss), int(win), loss or not known, win or not known, 1 - alpha if known else 1.0, alpha * net if known else 0.0, net if known else 0.0, net if known else -math.inf,
        ((stop, by_hand),), (mean_before,) if loss else None, bool(loss), (close, net),
    )


@dataclass(slots=True)
class _Block:
    rows: list = field(default_factory=list)  # [Seen, visible]
    hidden: int = 0
    sum: Seen | None = None


class Account:
    """The history of one account, fed in opening order."""

    def __init__(self, alpha: float):
        self.alpha = alpha
        self.settled, self.blocks = Seen(), deque()
        self.closing: list = []  # (close_time, order, block, place) of what is still open
        self.n, self.sum, self.first, self.squares, self.known = 0, 0.0, None, 0.0, 0
        self.before: list = []  # rows that opened at the same time as the present one
        self.side, self.amount = None, math.nan
        self.order = 0

    def at(self, now) -> Seen:
        """What had closed before now."""
        while self.closing and self.closing[0][0] < now:
            _, _, block, place = heapq.heappop(self.closing)
            block.rows[place][1] = True
            block.hidden -= 1
            block.sum = None
        while self.blocks and len(self.blocks[0].rows) == BLOCK and not self.blocks[0].hidden:
            self.settled = joined(self.settled, self._sum(self.blocks.popleft()))
        out = self.settled
        for b in self.blocks:
            out = joined(out, self._sum(b))
        return out

    @staticmethod
    def _sum(block: _Block) -> Seen:
        if block.sum is None:
            block.sum = Seen()
            for s, visible in block.rows:
                if visible:
                    block.sum = joined(block.sum, s)
        return block.sum

    def add(self, close, net: float, stop: bool, by_hand: bool, mean_before: float | None) -> None:
        if close is None or close != close:
            return  # never closes, so it is never seen
        if not self.blocks or len(self.blocks[-1].rows) == BLOCK:
            self.blocks.append(_Block())
        block = self.blocks[-1]
        one = outcome(self.alpha, close, net, stop, by_hand, mean_before)
        block.rows.append([one, False])
        block.hidden += 1
        self.order += 1
        heapq.heappush(self.closing, (close, self.order, block, len(block.rows) - 1))

    def opened(self, row) -> None:
        """Rows that opened before a later time enter the history of amounts."""
        if row.amount == row.amount:
            # Welford's update
            self.known += 1
            delta = row.amount - self.sum
            self.sum += delta / self.known
            self.squares += delta * (row.amount - self.sum)
        self.n += 1
        self.first = row.open_time if self.first is None else self.first
        self.side, self.amount = row.side, row.amount


STRICT = (
    "prior_opened long, prior_closed long, loss_streak_strict long, win_streak_strict long, cum_pnl_strict double, dd_from_peak_strict double, pnl_ewm_strict double, lot_zscore_strict double, "
    "size_after_loss_delta_strict double, sl_usage_rate_5_strict double, manual_exit_rate_5_strict double, trade_index_strict long, log_dt_close_strict double, trades_per_hour_strict double, "
    "same_direction_reentry_strict int, size_delta_ratio_strict double"
)


def _row(a: Account, r, now) -> tuple:
    s = a.at(now)
    amount = r.amount
    mean, deviation = (a.sum, math.sqrt(a.squares / a.known)) if a.known else (math.nan, 0.0)
    zscore = (amount - mean) / deviation if a.known >= 3 and deviation > 0 else None
    start = s.run_start if s.losses and s.last[1] == s.last[1] else None
    grown = amount - start[0] if start and start[0] is not None else None
    rate = lambda k: sum(x[k] for x in s.last5) / len(s.last5) if s.n >= 3 else None
    hours = max((now - a.first).total_seconds() / 3600, 1 / 60) if a.first is not None else 1 / 60
    again = int(bool(s.last and s.last[1] < 0 and a.n and r.side is not None and a.side == r.side))
    return (
        a.n, s.n, s.losses, s.wins, s.total, max(0.0, s.top) - s.total, s.add, zscore, grown, rate(0), rate(1), a.n + 1, math.log1p(max((now - s.last[0]).total_seconds(), 0.0)) if s.last else None,
        (a.n + 1) / hours, again, amount / a.amount if a.n and a.amount == a.amount and a.amount != 0 else None,
    )


def strict_features(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Keys and STRICT, one row per position: amounts, sides and counts from positions that opened earlier, outcomes from those of them that had also closed before this one opened.

    Positions of one opening time don't see each other. Missing outcomes count as closed, but neither end nor extend
    streaks; a position without a closing time is never seen to close. Positions come sorted by account, and an account
    of any length needs memory for what its open positions keep apart.
    """
    cols = [*ACCOUNT, "position_id", "open_time", "close_time", "amount", "side", "net_profit", "sl_price", "exit_type"]
    rows = df.select(*cols).repartition(*[F.col(c) for c in ACCOUNT]).sortWithinPartitions(*ACCOUNT, *ORDER)
    schema = StructType([*df.select(*ACCOUNT, "position_id").schema.fields, *StructType.fromDDL(STRICT).fields])
    names = schema.names

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, key, together, now, mean = None, None, [], None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.campaign_id, r.account_id) != key:
                    key, account, together, now = (r.campaign_id, r.account_id), Account(settings.ewm_alpha), [], None
                if now is None or r.open_time != now:
                    for x in together:
                        account.opened(x)
                    together, now = [], r.open_time
                    mean = account.sum if account.known else None
                out.append((r.campaign_id, r.account_id, r.position_id, *_row(account, r, now)))
                account.add(None if pd.isna(r.close_time) else r.close_time, r.net_profit, not pd.isna(r.sl_price), r.exit_type == "manual", mean)
                together.append(r)
            yield pd.DataFrame(out, columns=names) if out else pd.DataFrame({n: [] for n in names})

    return rows.mapInPandas(fold, schema)


def dealt(df: DataFrame) -> DataFrame:
    """df with an account's positions in one partition, in opening order. Windows over accounts need no other shuffle or sort, and leave it so."""
    return df.repartition(*[F.col(c) for c in ACCOUNT]).sortWithinPartitions(*ACCOUNT, *ORDER)


def folded(rows: DataFrame, medians: dict[str, str], averages: dict[str, tuple[str, float, float]]) -> DataFrame:
    """rows (from dealt, through windows and projections only) with running columns over the account's earlier positions, missing values passed over.

    medians: name -> column; null before the first. averages: name -> (column, alpha, start): the exponential average
    alpha * x + (1 - alpha) * before, from start on. One pass; two heaps a median and a number an average are carried from
    batch to batch. Rows that aren't in order fail the job.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heaps, means = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ACCOUNT), strict=True))
            mid, avg = ([batch.column(c).to_pylist() for c in cs] for cs in (medians.values(), [c for c, _, _ in averages.values()]))
            out: list[list] = [[] for _ in (*medians, *averages)]
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None and (k[0] is not None, k[0] or 0) < (key[0] is not None, key[0] or 0):
                        raise ValueError("positions aren't dealt by account and sorted")
                    key, heaps, means = k, [([], []) for _ in medians], [start for _, _, start in averages.values()]
                for j, (low, high) in enumerate(heaps):
                    out[j].append((-low[0] if len(low) > len(high) else (high[0] - low[0]) / 2) if low else None)
                    v = mid[j][i]
                    if v is not None:
                        heapq.heappush(high, -heapq.heappushpop(low, -v))
                        if len(high) > len(low):
                            heapq.heappush(low, -heapq.heappop(high))
                for j, (_, alpha, _) in enumerate(averages.values()):
                    out[len(medians) + j].append(means[j])
                    v = avg[j][i]
                    if v is not None:
                        means[j] = alpha * v + (1 - alpha) * means[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in out)], [*batch.schema.names, *medians, *averages])

    return rows.mapInArrow(fold, StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in (*medians, *averages))]))
