"""Account history over a stream of two kinds of events: a position opens, and later it closes.

An opening comes out with the strict features of that moment: amounts and sides of what opened before, outcomes of what had
closed before. A close puts out nothing; it makes an outcome visible to the openings after it. Events may come in any order
within the watermark's delay. They wait in the account's state and are taken by event time, openings before closes of the
same instant, so the result is that of `asof.strict_features` over the finished positions.

A position that is open lives in a map state of its account, with whatever opened after it: outcomes are folded in opening
order, so nothing behind an open position can be summed up yet. As soon as the first of them has closed, the closed ones at
the front are folded into one summary and leave the map. A position that stays open longer than `hold_s` is let go by a
timer of event time, and its close, should it come, no longer counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import STRICT, Account, Seen, _row, joined, outcome
from .state import ACCOUNT, _forget, _none

OPEN, CLOSE = 0, 1  # in this order at one instant

EVENT = "at_us long, kind int, position_id long, amount double, side string, has_stop boolean, net_profit double, by_hand boolean"
#: The account: what has opened, the closed positions at the front (Seen), and the time of the last event taken.
HISTORY = (
    "n long, known long, mean double, squares double, first_us long, side string, amount double, last_us long, last_open_us long, closed long, losses long, wins long, all_losses boolean, all_wins boolean, "
    "keep double, add double, total double, top double, last5 string, has_run boolean, run_mean double, all_run boolean, last_close_us long, last_net double"
)
#: A position that hasn't been folded: in which order it opened, the mean amount before it, and its outcome once closed.
HELD = "order long, open_us long, mean double, has_stop boolean, close_us long, net double, by_hand boolean"
OUT = f"campaign_id int, account_id long, position_id long, late boolean, {STRICT}"

_EPOCH = datetime(1970, 1, 1)


def _time(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


def _us(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


class History(Account):
    """An account fed by openings and closes in the order of their times. held: position -> [order, open_us, mean, has_stop, close_us, net, by_hand], in opening order."""

    def __init__(self, alpha: float, saved: tuple | None = None, held: dict[int, list] | None = None):
        super().__init__(alpha)
        self.held = held or {}
        self.order = max((h[0] for h in self.held.values()), default=0)
        self.last_us = self.last_open_us = None
        if saved is not None:
            (self.n, self.known, self.sum, self.squares, first, self.side, amount, self.last_us, self.last_open_us, n, losses, wins, all_losses, all_wins, keep, add, total, top, last5, has_run, run_mean, all_run, close, net) = saved
            self.first, self.amount = _time(first), math.nan if amount is None else amount
            flags = tuple((x[0] == "s", x[1] == "h") for x in last5.split(",")) if last5 else ()
            last = None if close is None else (_time(close), math.nan if net is None else net)
            self.settled = Seen(n, losses, wins, all_losses, all_wins, keep, add, total, -math.inf if top is None else top, flags, (run_mean,) if has_run else None, all_run, last)

    def saved(self) -> tuple:
        s = self.settled
        last5 = ",".join(("s" if a else "-") + ("h" if b else "-") for a, b in s.last5)
        known = lambda x: None if x is None or x != x or math.isinf(x) else x
        return (
            self.n, self.known, self.sum, self.squares, None if self.first is None else _us(self.first), self.side, known(self.amount), self.last_us, self.last_open_us, s.n, s.losses, s.wins, s.all_losses, s.all_wins,
            s.keep, s.add, s.total, known(s.top), last5, s.run_start is not None, s.run_start[0] if s.run_start else None, s.all_run, None if s.last is None else _us(s.last[0]), known(s.last[1]) if s.last else None,
        )

    def at(self, now) -> Seen:
        """All closes that were taken are of times before now."""
        out = self.settled
        for h in self.held.values():
            if h[4] is not None:
                out = joined(out, self._seen(h))
        return out

    def _seen(self, h: list) -> Seen:
        return outcome(self.alpha, _time(h[4]), math.nan if h[5] is None else h[5], bool(h[3]), bool(h[6]), h[2])

    def open(self, events: list[tuple]) -> list[tuple]:
        """Positions that open at one instant, which don't see each other -> (position_id, features)."""
        us = events[0][0]
        now, mean = _time(us), self.sum if self.known else None
        made = []
        for _, _, pid, amount, side, has_stop, _, _ in events:
            row = _Opening(now, math.nan if amount is None else amount, side)
            made.append((pid, _row(self, row, now)))
        for _, _, pid, amount, side, has_stop, _, _ in events:
            self.order += 1
            self.held[pid] = [self.order, us, mean, has_stop, None, None, None]
            self.opened(_Opening(now, math.nan if amount is None else amount, side))
        self.last_open_us = us
        return made

    def closes(self, event: tuple, hold_us: int | None) -> bool:
        """Whether the position was open, and not for too long."""
        us, _, pid, _, _, _, net, by_hand = event
        held = self.held.get(pid)
        if held is None or held[4] is not None or (hold_us is not None and us - held[1] > hold_us):
            return False
        held[4:] = [us, net, by_hand]
        self.fold()
        return True

    def let_go(self, upto_us: int, hold_us: int) -> None:
        """Positions that have been open for too long will never be seen to close."""
        if gone := [p for p, h in self.held.items() if h[4] is None and h[1] + hold_us < upto_us]:
            for pid in gone:
                del self.held[pid]
            self.fold()

    def fold(self) -> None:
        for pid, h in list(self.held.items()):
            if h[4] is None:
                return
            self.settled = joined(self.settled, self._seen(h))
            del self.held[pid]


class _Opening:
    __slots__ = ("amount", "open_time", "side")

    def __init__(self, open_time: datetime, amount: float, side: str | None):
        self.open_time, self.amount, self.side = open_time, amount, side


class TwoEvents(StatefulProcessor):
    def __init__(self, alpha: float, hold_us: int | None, forget_us: int | None):
        self.alpha, self.hold_us, self.forget_us = alpha, hold_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", HISTORY)
        self.held = handle.getMapState("held", "position_id long", HELD)
        self.waiting = handle.getListState("waiting", EVENT)

    def _load(self) -> History:
        saved = tuple(_none(v) for v in self.history.get()) if self.history.exists() else None
        held = {int(k[0]): [_none(x) for x in v] for k, v in self.held.iterator()} if saved else {}
        return History(self.alpha, saved, dict(sorted(held.items(), key=lambda kv: kv[1][0])))

    def _take(self, key: tuple, events: list[tuple], upto_us: int) -> Iterator[pd.DataFrame]:
        h = self._load()
        had = {p: tuple(v) for p, v in h.held.items()}
        heapq.heapify(events)
        made: list[tuple] = []
        blank = (None,) * len(STRICT.split(", "))
        while events and events[0][0] <= upto_us:
            e = heapq.heappop(events)
            if self.hold_us is not None:
                h.let_go(e[0], self.hold_us)
            if self.forget_us is not None and h.last_us is not None and not h.held and e[0] - h.last_us > self.forget_us:
                h = History(self.alpha)
            if e[1] == OPEN:
                together = [e]
                while events and events[0][:2] == e[:2]:
                    together.append(heapq.heappop(events))
                if h.last_open_us is not None and e[0] <= h.last_open_us:
                    made += [(x[2], True, *blank) for x in together]
                    continue
                made += [(pid, False, *row) for pid, row in h.open(together)]
            elif not h.closes(e, self.hold_us):
                made.append((e[2], True, *blank))
            h.last_us = e[0] if h.last_us is None else max(h.last_us, e[0])
        if self.hold_us is not None:
            h.let_go(upto_us, self.hold_us)
        self._save(h, had, events, upto_us)
        if made:
            frame = pd.DataFrame(made, columns=["position_id", "late", *[c.split(" ")[0] for c in STRICT.split(", ")]])
            frame.insert(0, "campaign_id", pd.array([key[0]] * len(frame), dtype="Int32"))
            account = int(key[1].removeprefix(ACCOUNT)) if key[1].startswith(ACCOUNT) else None
            frame.insert(1, "account_id", pd.array([account] * len(frame), dtype="Int64"))
            yield frame

    def _save(self, h: History, had: dict[int, tuple], left: list[tuple], upto_us: int) -> None:
        """Writes what has changed: the summary, the map's entries, the events still waiting, and one timer."""
        if h.last_us is not None:
            self.history.update(h.saved())
        for pid in had.keys() - h.held.keys():
            self.held.removeKey((pid,))
        for pid, v in h.held.items():
            if had.get(pid) != tuple(v):
                self.held.updateValue((pid,), tuple(v))
        self.waiting.clear()
        if left:
            self.waiting.put(sorted(left))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        due = [e[0] for e in left]
        if self.hold_us is not None:
            due += [v[1] + self.hold_us for v in h.held.values() if v[4] is None]
        if not due and self.forget_us is not None and h.last_us is not None and not h.held:
            due = [h.last_us + self.forget_us]
        if due:
            self.handle.registerTimer(max(min(due), upto_us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [_event(r) for batch in rows for r in batch[[c.split(" ")[0] for c in EVENT.split(", ")]].itertuples(index=False, name=None)]
        yield from self._take(key, self._held() + new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, left = timerValues.getCurrentWatermarkInMs() * 1000, self._held()
        if self.forget_us is not None and not left and self.history.exists():
            h = self._load()
            if not h.held and h.last_us + self.forget_us <= now:
                self.history.clear()
                return
        yield from self._take(key, left, now)

    def _held(self) -> list[tuple]:
        return [_event(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def close(self) -> None:
        pass


class _event(tuple):  # noqa: N801
    """An event, ordered by its instant, kind and position; its other fields may be null."""

    __slots__ = ()

    def __new__(cls, row):
        at, kind, pid, *rest = (_none(v) for v in row)
        return super().__new__(cls, (int(at), int(kind), int(pid), *rest))

    def __lt__(self, other):
        return self[:3] < other[:3]


def events_of(positions: DataFrame) -> DataFrame:
    """Finished positions as the events that a stream would have brought: an opening each, and a close unless there is no closing time."""
    both = positions.select(
        "campaign_id", "account_id", "position_id", F.explode(F.array(F.lit(OPEN), F.lit(CLOSE))).alias("kind"), "open_time", "close_time", "amount", "side", F.col("sl_price").isNotNull().alias("has_stop"), "net_profit", "exit_type",
    ).filter(f"kind = {OPEN} OR close_time IS NOT NULL")
    opens = F.col("kind") == OPEN
    return both.select(
        "campaign_id", "account_id", "position_id", "kind", F.when(opens, F.col("open_time")).otherwise(F.col("close_time")).alias("event_time"), F.when(opens, F.col("amount")).alias("amount"), F.when(opens, F.col("side")).alias("side"),
        F.when(opens, F.col("has_stop")).alias("has_stop"), F.when(~opens, F.col("net_profit")).alias("net_profit"), F.when(~opens, F.coalesce(F.col("exit_type") == "manual", F.lit(False))).alias("by_hand"),
    )


def stream_strict_features(events: DataFrame, delay: str = "1 hour", alpha: float = 0.3, hold_s: float | None = None, forget_s: float | None = None) -> DataFrame:
    """A stream of events (as events_of makes them) -> OUT, a row per opening.

    An opening that isn't after one already taken, and a close whose position isn't open (unknown, closed already, or open
    longer than hold_s), come out marked late without features; such an opening changes nothing. A close that comes after
    its instant has passed counts for all openings that are taken after it. A row without an account is one by itself.
    forget_s: an account without open positions starts anew after so long without an event. Needs the RocksDB state store.
    """
    who = F.coalesce(F.concat(F.lit(ACCOUNT), F.col("account_id").cast("string")), F.concat(F.lit("row "), F.col("position_id").cast("string"))).alias("who")
    at = F.col("event_time").cast("timestamp")
    rows = events.select("campaign_id", who, at.alias("event_time"), F.unix_micros(at).alias("at_us"), "kind", "position_id", "amount", "side", "has_stop", "net_profit", "by_hand")
    keyed = rows.withWatermark("event_time", delay).groupBy("campaign_id", "who")
    return keyed.transformWithStateInPandas(TwoEvents(alpha, _forget(hold_s), _forget(forget_s)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
