from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import features as f
from causeway.plans import adapters as a
from causeway.streaming.state import FRESH, step, stream_features, stream_prior_campaigns

NAMES = ["trade_index", "loss_streak", "win_streak", "pnl_ewm", "cum_pnl_usd", "dd_from_peak_usd", "entry_gap_sec", "trades_per_hour", "same_direction_reentry", "size_delta_ratio"]


def test_step_equals_windows(spark, sf):
    p = a.positions(spark, sf)
    batch = {r["position_id"]: r for r in f.features(p, NAMES).collect()}
    states = {}
    for r in sorted(p.collect(), key=lambda r: (r["open_time"], r["position_id"])):
        key = (r["campaign_id"], r["account_id"])
        us = lambda t: int(t.timestamp() * 1e6)
        out, states[key] = step(states.get(key, FRESH), (r["position_id"], us(r["open_time"]), us(r["close_time"]), r["amount"], r["side"], r["net_profit"]))
        want = batch[r["position_id"]]
        for name, got in zip(NAMES, out[2:], strict=True):
            assert (got is None) == (want[name] is None) and (got is None or abs(got - want[name]) < 1e-6), (name, got, want[name])


def test_stream_equals_batch(spark, sf, tmp_path):
    p = a.positions(spark, sf).filter("account_id % 5 = 0")
    last = p.agg(F.max("open_time")).first()[0]
    end = p.limit(1).withColumns({"account_id": F.lit(-1).cast("long"), "position_id": F.lit(-1).cast("long"), "open_time": F.lit(last) + F.expr("INTERVAL 10 DAY")})
    p.filter("position_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    p.filter("position_id % 2 = 1").unionByName(end).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(p.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_features(stream, "20 days").writeStream.format("memory").queryName("accounts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {r["position_id"]: r for r in spark.sql("SELECT * FROM accounts WHERE NOT late").collect()}
    batch = {r["position_id"]: r for r in f.features(p, NAMES).collect()}
    assert len(got) > 10
    # with a watermark of 20 days only what is older than the last row by that much has come out, in order and as in batch
    for i, r in got.items():
        assert all((r[n] is None) == (batch[i][n] is None) and (r[n] is None or abs(r[n] - batch[i][n]) < 1e-6) for n in NAMES)


def _run(spark, tmp_path, name, df, make, parts=3):
    """The rows of df in files by day, one a batch -> what the stream puts out."""
    for i in range(parts):
        df.filter(f"part = {i}").drop("part").coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
    stream = spark.readStream.schema(df.drop("part").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return {r["position_id"]: r for r in spark.sql(f"SELECT * FROM {name} WHERE NOT late").collect()}


POSITION = "campaign_id int, account_id long, position_id long, open_time timestamp_ntz, close_time timestamp_ntz, amount double, side string, net_profit double, trader_key string, part int"


def test_lone_rows_and_forgotten_accounts(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda d, h: datetime(2026, 5, d, h)
    row = lambda acc, i, t, part: (53, acc, i, t, t + timedelta(minutes=5), 1.0, "BUY", -2.0, "T", part)
    rows = [row(1, 1, at(1, 9), 0), row(1, 2, at(1, 10), 0), row(None, 3, at(1, 9), 0), row(None, 4, at(1, 10), 0), row(9, 90, at(3, 9), 0), row(9, 91, at(6, 9), 1), row(1, 5, at(6, 10), 1), row(9, 92, at(9, 9), 2), row(9, 93, at(20, 9), 3), row(9, 94, at(28, 9), 4)]
    df = spark.createDataFrame(rows, POSITION)
    for name, forget, index in (("kept", None, 3), ("forgotten", 2 * 86400.0, 1)):
        got = _run(spark, tmp_path, name, df, lambda s, forget=forget: stream_features(s, "1 hour", forget), 5)
        assert [got[i]["trade_index"] for i in (1, 2, 3, 4)] == [1, 2, 1, 1] and got[3]["account_id"] is None
        assert got[5]["trade_index"] == index and got[5]["loss_streak"] == index - 1


def test_traders_have_states_of_their_own(spark, tmp_path):
    from datetime import datetime, timedelta

    row = lambda c, acc, i, day, key, part: (c, acc, i, datetime(2026, 5, day, 9, i), datetime(2026, 5, day, 10) + timedelta(minutes=i), 1.0, "BUY", 1.0, key, part)
    rows = [row(53, 1, 1, 1, "A", 0), row(53, 2, 2, 1, "A", 0), row(53, 3, 3, 1, None, 0), row(54, 4, 4, 8, "A", 1), row(54, 5, 5, 8, "B", 1), row(55, 6, 6, 15, "A", 2), row(56, 7, 7, 25, "C", 3), row(56, 8, 8, 28, "C", 4)]
    got = _run(spark, tmp_path, "traders", spark.createDataFrame(rows, POSITION), lambda s: stream_prior_campaigns(s, "1 hour"), 5)
    assert {i: r["prior_campaigns"] for i, r in got.items() if i < 7} == {1: 0, 2: 0, 4: 1, 5: 0, 6: 2}


def _streamed(spark, tmp_path, name, parts, make):
    """Frames of events, one a batch -> what the stream puts out."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
    stream = spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.sql(f"SELECT * FROM {name}").collect()


EVENT = "campaign_id int, account_id long, position_id long, kind int, event_time timestamp_ntz, amount double, side string, has_stop boolean, net_profit double, by_hand boolean"


def _event(i, kind, at, account=1, amount=1.0, side="BUY", stop=True, net=None, hand=None):
    opens = kind == 0
    return (53, account, i, kind, at, amount if opens else None, side if opens else None, stop if opens else None, net, hand)


def test_two_kinds_of_events_equal_strict_history(spark, sf, tmp_path):
    """Openings and closes shuffled over batches, or in batches by time; closes long after later openings, missing amounts and profits, positions that never close."""
    from causeway.operators.asof import STRICT, strict_features
    from causeway.streaming.events import events_of, stream_strict_features

    spoil = F.abs(F.xxhash64("position_id")) % 7
    p = a.positions(spark, sf).filter("account_id % 3 = 0").withColumns({
        "close_time": F.when(spoil == 0, F.col("close_time") + F.expr("INTERVAL 5 DAYS")).when(spoil != 1, F.col("close_time")), "net_profit": F.when(spoil != 2, F.col("net_profit")), "amount": F.when(spoil != 3, F.col("amount")),
    })
    events = events_of(p)
    last = events.agg(F.max("event_time")).first()[0]
    ends = [spark.createDataFrame([_event(-1 - i, 0, last.replace(year=last.year + 20 + i), account=-1)], EVENT) for i in range(2)]
    shuffled = events.withColumn("part", F.abs(F.xxhash64("position_id", "kind")) % 3)
    by_time = events.withColumn("part", F.ntile(3).over(Window.orderBy("event_time")) - 1)
    want = {r["position_id"]: r for r in strict_features(p).collect()}
    assert len(want) > 50 and any(r["loss_streak_strict"] > 1 for r in want.values())
    names = [c.split(" ")[0] for c in STRICT.split(", ")]
    for name, mixed, delay in (("shuffled", shuffled, "4000 days"), ("by_time", by_time, "1 minute")):
        parts = [mixed.filter(f"part = {i}").drop("part").orderBy(F.xxhash64("kind", "position_id")) for i in range(3)]
        got = _streamed(spark, tmp_path, name, [*parts, *ends], lambda s, delay=delay: stream_strict_features(s, delay))
        assert not [r for r in got if r["late"]]
        got = {r["position_id"]: r for r in got}
        assert want.keys() == {i for i in got if i >= 0}
        for i, r in want.items():
            for n in names:
                assert (got[i][n] is None) == (r[n] is None) and (r[n] is None or abs(got[i][n] - r[n]) < 1e-9 * max(1, abs(r[n]))), (name, i, n, got[i][n], r[n])


def test_late_events_holds_and_forgetting(spark, tmp_path):
    from datetime import datetime

    from causeway.streaming.events import stream_strict_features

    at = lambda d, h: datetime(2026, 5, d, h)
    batches = [
        [_event(1, 0, at(1, 9)), _event(2, 0, at(1, 10)), _event(2, 1, at(1, 11), net=-5.0, hand=True), _event(9, 0, at(2, 9), account=9)],
        [_event(3, 0, at(3, 9)), _event(77, 1, at(3, 8), net=1.0, hand=True), _event(1, 1, at(3, 7), net=-1.0, hand=True), _event(10, 0, at(4, 9), account=9)],
        [_event(5, 0, at(20, 9)), _event(11, 0, at(21, 9), account=9)],
        [_event(12, 0, at(28, 9), account=9), _event(4, 0, at(1, 8))],
    ]
    parts = [spark.createDataFrame(b, EVENT) for b in batches]
    for name, hold, forget, losses, index in (("plain", None, None, 2, 4), ("held", 86400.0, None, 1, 4), ("anew", 86400.0, 5 * 86400.0, 0, 1)):
        rows = _streamed(spark, tmp_path, name, parts, lambda s, hold=hold, forget=forget: stream_strict_features(s, "1 hour", hold_s=hold, forget_s=forget))
        got = {r["position_id"]: r for r in rows if not r["late"]}
        # the close of an unknown position is late; with a hold of a day so is that of a position open for two. An opening below the watermark (4) never reaches the state
        assert {r["position_id"] for r in rows if r["late"]} == ({77} if hold is None else {77, 1}) and 4 not in got
        assert [got[i]["trade_index_strict"] for i in (1, 2, 3)] == [1, 2, 3] and got[2]["loss_streak_strict"] == 0
        assert got[3]["prior_closed"] == (2 if hold is None else 1) and got[5]["loss_streak_strict"] == losses and got[5]["trade_index_strict"] == index
