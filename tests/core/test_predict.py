"""Decisions on raw trades in one call."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from causeway.operators import features as f
from causeway.operators import model, predict
from causeway.plans import adapters as a
from causeway.plans.queries import FIXED
from tests.core.test_features import BASE

SCHEMA = "campaignId int, accountId string, positionId long, openDateTime timestamp_ntz, closeDateTime timestamp_ntz, traderKey string, challenge_type string, amount double, side string, netProfit double, slPrice double, tpPrice double"


def stream(spark, n=12):
    """Alternating accounts, a loss in every fourth row."""
    rows = [(53, f"a{i % 2}", i, BASE + timedelta(minutes=3 * i), BASE + timedelta(minutes=3 * i + 1), f"t{i % 2}", "11" if i % 2 else "unknown", 0.2 + 0.1 * (i % 5), "BUY" if i % 3 else "SELL", -3.0 if i % 4 == 0 else 2.0, 99.0, 101.0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


WITH_LEVELS = model.artifact(model.Design(["loss_streak", "amount"], {"challenge_type": ["11", "unknown"]}, {"loss_streak": 0.0, "amount": 0.3}, {"loss_streak": 0.0, "amount": 0.3}, {"loss_streak": 1.0, "amount": 0.1}), 1.0, [2.0, 1.0, 0.5, -0.5], 1.0, 0.0, 10.0)


def decided(df, artifact=WITH_LEVELS, **kw):
    return [tuple(r)[1:] for r in predict.predict(df, artifact, **kw).collect()]


def test_order_of_rows_and_columns_does_not_matter(spark):
    t = stream(spark)
    want = decided(t)
    assert [k for k, *_ in want] == [f"53::{i}" for i in range(12)]  # the caller's order
    assert decided(t.select(*reversed(t.columns))) == want
    shuffled = t.coalesce(1).orderBy(F.rand(3))
    assert sorted(decided(shuffled)) == sorted(want)
    assert decided(t.withColumns({"profit": F.lit(1e7), "commission": F.lit(-1e7)})) == want  # the net profit that is told counts


def test_levels_columns_and_names(spark):
    t = stream(spark, 4)
    with pytest.raises(ValueError, match="unknown levels"):
        decided(t.withColumn("challenge_type", F.when(F.col("positionId") == 0, "new").otherwise(F.col("challenge_type"))))
    with pytest.raises(ValueError, match="missing levels"):
        decided(t.withColumn("challenge_type", F.lit("11")))
    assert len(decided(t.withColumn("challenge_type", F.lit("11")), every_level=False)) == 4
    with pytest.raises(ValueError, match="missing columns"):
        decided(t.drop("amount"))
    with pytest.raises(ValueError, match="close"):
        predict.predict(t, WITH_LEVELS | {"numeric": ["profit"]})
    assert decided(t.withColumnsRenamed({"closeDateTime": "closeTime", "challenge_type": "challenge_type_id"})) == decided(t) and decided(t.limit(0)) == []


def test_open_positions_are_seen_by_nobody(spark):
    """A row without a close or without a profit is decided on, and later rows are as if it weren't there; a lone row has no account."""
    t = stream(spark, 12)
    some = t.withColumns({"closeDateTime": F.when(F.col("positionId") != 4, F.col("closeDateTime")), "netProfit": F.when(F.col("positionId") != 5, F.col("netProfit"))})
    got = {r[0]: r for r in decided(some)}
    without = {r[0]: r for r in decided(t.filter(~F.col("positionId").isin(4, 5)))}
    assert len(got) == 12 and all(got[k] == r for k, r in without.items())
    lone = decided(t.withColumn("accountId", F.lit(None).cast("string")))
    want = [1 + (0.1 * (i % 5) - 0.1) / 0.1 + (0.5 if i % 2 else -0.5) for i in range(12)]  # no streak anywhere
    assert [r[2] for r in lone] == pytest.approx(want)


def test_live_features_are_the_batch_features(spark, sf):
    """Where every outcome is known, the state carried row by row tells what the windows tell."""
    p = a.positions(spark, sf)
    rows = predict.trades(p)
    live = predict.live_features(predict.prior_campaigns(rows))
    names = [n for n in f.ENTRY if n in live.columns and n != "amount"]
    assert len(names) >= 18
    batch = f.features(p, names)
    both = live.select("position_id", *[F.col(n).alias(f"l_{n}") for n in names]).join(batch, "position_id")
    same = lambda n: (F.col(n).isNull() & F.col(f"l_{n}").isNull()) | (F.abs(F.col(n).cast("double") - F.col(f"l_{n}").cast("double")) < 1e-6)
    r = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(same(n), F.lit(False))).alias(n) for n in names]).first()
    assert r["n"] == p.count() and {n: r[n] for n in names if r[n]} == {}
    assert predict.predict(p, FIXED).count() == p.count()


LIVE = ["loss_streak", "win_streak", "pnl_ewm", "lot_zscore", "size_after_loss_delta", "sl_usage_rate_5", "manual_exit_rate_5", "cum_pnl_usd", "dd_from_peak_usd", "trade_index", "log_dt_close", "entry_gap_sec", "trades_per_hour", "same_direction_reentry", "size_delta_ratio"]


def test_live_features_equal_batch_features(spark, sf):
    """Also with missing amounts, sides, stops and exits: a missing amount leaves the rows after it their z-score."""
    h = F.abs(F.xxhash64("position_id"))
    p = a.positions(spark, sf).withColumns({"amount": F.when(h % 5 != 0, F.col("amount")), "side": F.when(h % 7 != 0, F.col("side")), "sl_price": F.when(h % 3 != 0, F.col("sl_price")), "account_id": F.col("account_id") % 6})
    own = p.withColumnsRenamed({"campaign_id": "campaignId", "account_id": "accountId", "position_id": "positionId", "open_time": "openDateTime", "close_time": "closeDateTime", "net_profit": "netProfit", "sl_price": "slPrice", "tp_price": "tpPrice", "exit_type": "exitType"})
    got = {r["position_id"]: r for r in predict.live_features(predict.prior_campaigns(predict.trades(own))).collect()}
    want = {r["position_id"]: r for r in f.features(p, LIVE).collect()}
    assert sum(r["lot_zscore"] is not None for r in want.values()) > 300 and any(r["amount"] is None for r in p.collect())
    for i, r in want.items():
        for n in LIVE:
            assert (got[i][n] is None) == (r[n] is None) and (r[n] is None or abs(got[i][n] - r[n]) < 1e-6 * max(1, abs(r[n]))), (i, n, got[i][n], r[n])


def test_outcomes_wait_for_their_close(spark):
    """Rows that open a minute apart and close at night see each other's losses in opening order, or with known_at_open only after they have happened."""
    night = BASE.replace(hour=23)
    rows = [(53, "a", i, BASE + timedelta(minutes=i), night, None, "11", 1.0, "BUY", -2.0, 99.0, 101.0) for i in range(3)] + [(53, "a", 3, night + timedelta(minutes=1), night + timedelta(minutes=2), None, "11", 1.0, "BUY", -2.0, 99.0, 101.0)]
    own = predict.prior_campaigns(predict.trades(spark.createDataFrame(rows, SCHEMA)))
    streaks = lambda known: [r["loss_streak"] for r in predict.live_features(own, known_at_open=known).orderBy("position_id").collect()]
    assert streaks(False) == [0, 1, 2, 3] and streaks(True) == [0, 0, 0, 3]
