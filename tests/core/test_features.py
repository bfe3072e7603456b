"""Hand-computed sequences, and what may not change when the future does."""

import math
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from causeway.config import DEFAULT
from causeway.operators import features as f
from causeway.operators import history
from causeway.operators.state import ideas, state_vectors
from causeway.plans import adapters as a

SCHEMA = "campaign_id int, account_id long, position_id long, open_time timestamp_ntz, close_time timestamp_ntz, amount double, side string, net_profit double, profit double, open_price double, sl_price double, tp_price double, exit_type string, trader_key string"
BASE = datetime(2026, 5, 19, 9)
SIX = [(0, 10, 0.5, 10, "BUY", 99, 101, "manual"), (20, 30, 0.5, -20, "SELL", None, 101.5, "manual"), (40, 50, 1.0, -30, "BUY", 98, None, "sl_hit"), (60, 65, 0.2, 2, "BUY", None, None, "manual"), (80, 90, 0.5, 5, "SELL", 99.5, 101, "manual"), (100, 110, 2.0, -10, "SELL", None, 102, "manual")]


def rows(spark, trades, campaign=53, account=1, base=BASE, key=None, first=1):
    none = lambda v: None if v is None else float(v)
    data = [(campaign, account, first + i, base + timedelta(minutes=o), base + timedelta(minutes=c), amt, side, float(net), float(net), 100.0, none(sl), none(tp), ex, key) for i, (o, c, amt, net, side, sl, tp, ex) in enumerate(trades)]
    return spark.createDataFrame(data, SCHEMA)


def test_fourth_of_six(spark):
    got = {r["position_id"]: r for r in f.features(rows(spark, SIX), settings=replace(DEFAULT, balance=1000.0)).collect()}
    want = {"loss_streak": 2, "win_streak": 0, "pnl_ewm": -11.73, "size_after_loss_delta": -0.3, "sl_usage_rate_5": 2 / 3, "manual_exit_rate_5": 2 / 3, "pnl_pct": -0.04, "dd_from_peak_pct": 0.05, "cum_pnl_usd": -40, "dd_from_peak_usd": 50, "breach_proximity_usd": -10,
            "target_proximity_usd": 120, "trade_index": 4, "log_dt_close": math.log(601), "trades_per_hour": 4, "sl_widening_delta": None, "entry_gap_sec": 600, "same_direction_reentry": 1, "size_delta_ratio": 0.2}
    for n, w in want.items():
        assert (got[4][n] is None) if w is None else got[4][n] == pytest.approx(w), n
    assert got[1]["entry_gap_sec"] is None and got[1]["trades_per_hour"] == pytest.approx(60) and got[1]["lot_zscore"] is None


def test_stop_median(spark):
    four = [(20 * i, 20 * i + 5, 1.0, 1, "BUY", s, None, "manual") for i, s in enumerate((99, 98.5, 98, 97.5))]
    got = [r["sl_widening_delta"] for r in f.features(rows(spark, four), ["sl_widening_delta"]).orderBy("position_id").collect()]
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(0.010)


def test_future_and_other_accounts_change_nothing(spark, sf):
    p = a.positions(spark, sf)
    cut = p.agg(F.percentile("open_time".replace("open_time", "position_id"), F.lit(0.5))).first()[0]
    mid = p.filter(F.col("position_id") <= cut).agg(F.max("open_time")).first()[0]
    changed = p.withColumn("net_profit", F.when(F.col("open_time") > F.lit(mid), F.col("net_profit") * -3).otherwise(F.col("net_profit")))
    before = lambda df: f.features(df, keep=("campaign_id", "account_id", "position_id", "open_time")).filter(F.col("open_time") <= F.lit(mid))
    assert before(p).exceptAll(before(changed)).count() == 0
    prefix = before(p.filter(F.col("open_time") <= F.lit(mid)))
    assert before(p).exceptAll(prefix).count() == 0
    shuffled = f.features(p.repartition(7, "position_id").orderBy(F.rand(3)))
    assert f.features(p).exceptAll(shuffled).count() == 0


def test_trader_memory_across_campaigns(spark):
    at = lambda d, h, m=0: datetime(2026, 5, d, h, m)
    raw = [(53, 1, 5301, at(1, 9), at(1, 9, 30), 1.0, "BUY", -10, 99), (53, 1, 5302, at(1, 10), at(1, 10, 30), 1.0, "BUY", -20, 98), (53, 1, 5303, at(1, 10, 40), at(1, 11), 1.0, "SELL", -30, None),
           (54, 2, 5401, at(8, 9), at(8, 9, 20), 1.0, "BUY", -5, 99.5), (54, 2, 5402, at(8, 9, 40), at(8, 10), 1.5, "SELL", 12, None), (55, 3, 5501, at(15, 9), at(15, 9, 45), 2.0, "BUY", 50, 95)]

    def run(data):
        df = spark.createDataFrame([(c, acc, i, o, cl, amt, s, float(n), float(n), 100.0, None if sl is None else float(sl), 101.0, "manual", "T") for c, acc, i, o, cl, amt, s, n, sl in data], SCHEMA)
        with_streak = f.features(df, ["loss_streak"], keep=df.columns)
        pop = spark.createDataFrame([(0.0, 0.0, 0.0)], "pop_tilt double, pop_sl double, pop_survival double")
        return {r["position_id"]: r for r in history.trader_history(with_streak, pop).collect()}

    got = run(raw)
    r = got[5401]
    assert r["trader_prior_tilt"] == pytest.approx(30 / 6) and r["trader_prior_sl_discipline"] == pytest.approx(2 / 7 * 0.015) and r["trader_prior_survival"] == pytest.approx(3 / 8 * (2 / 1.99))
    assert r["prior_campaigns"] == 1 and not r["is_cold_start"] and got[5301]["is_cold_start"]
    other = run([x if x[0] == 53 else (*x[:7], x[7] * 9 - 1, x[8]) for x in raw])
    assert all(other[5401][c] == r[c] for c in ("trader_prior_tilt", "trader_prior_sl_discipline", "trader_prior_survival", "prior_campaigns"))


def test_lint_refuses_the_rows_own_close():
    bad = f.Feature("peek", lambda s: F.col("net_profit"), own=frozenset({"net_profit"}))
    with pytest.raises(ValueError, match="peek"):
        f.lint([bad])
    assert "sl_distance_pct" not in f.ENTRY and "loss_streak" in f.ENTRY


@pytest.mark.parametrize("alpha", [0.01, 0.3, 1.0])
def test_averages_forget_nothing_early(spark, alpha):
    """A thousand positions whose earliest outcome is large, and gaps of missing ones; alpha 0.01 still remembers it."""
    trades = [(3 * i, 3 * i + 1, 1.0, 5000 if i == 0 else (-1) ** i, "BUY", None, None, "manual") for i in range(1000)]
    df = rows(spark, trades).withColumn("net_profit", F.when(~F.col("position_id").between(300, 700), F.col("net_profit")))
    got = [r["pnl_ewm"] for r in f.features(df, ["pnl_ewm"], replace(DEFAULT, ewm_alpha=alpha)).orderBy("position_id").collect()]
    want, a = [], 0.0
    for i, t in enumerate(trades):
        want.append(a)
        if not 300 <= i + 1 <= 700:
            a = alpha * t[3] + (1 - alpha) * a
    assert got == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        f.decay_rows(0.0)


def test_missing_values(spark):
    t = [list(x) for x in SIX]
    df = rows(spark, [tuple(x) for x in t]).withColumn("net_profit", F.when(F.col("position_id") != 2, F.col("net_profit")))
    got = {r["position_id"]: r for r in f.features(df).collect()}
    assert got[3]["loss_streak"] == 0 and got[3]["cum_pnl_usd"] == 10 and got[4]["loss_streak"] == 1
    assert f.features(df.limit(0)).count() == 0


def test_ideas_fold_over_a_long_account(spark):
    long = [(i, i + 1, 1.0, 1, "BUY" if i % 7 else "SELL", None, None, "manual") for i in range(500)]
    got = [r["idea_id"] for r in ideas(rows(spark, long)).orderBy("position_id").collect()]
    want, idea, anchor, side = [], 0, None, None
    for o, _, _, _, s, *_ in long:
        if anchor is None or o - anchor > 3 or s != side:
            idea, anchor = idea + 1, o
        side = s
        want.append(idea)
    assert got == want
    assert state_vectors(rows(spark, SIX)).count() == 6
