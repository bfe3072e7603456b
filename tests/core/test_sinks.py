"""Tables replaced at once, their freshness, and the tick source."""

import gzip
import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway import storage
from causeway.sources import sinks, ticks

ROWS = [(53, 1, date(2024, 1, 1), "a"), (53, 2, date(2024, 1, 2), None), (54, 1, date(2024, 1, 3), "b/c d"), (None, 1, None, "x")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "campaign int, id long, day date, what string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_publish_is_idempotent_and_replaces_partitions(spark, table, tmp_path):
    at = f"{tmp_path}/t"
    first = sinks.publish(table, at, by="campaign", bounds="day", key=["campaign", "id"])
    assert rows(sinks.current(spark, at)) == sorted(ROWS, key=str) and {k: p["rows"] for k, p in first["parts"].items()} == {"53": 2, "54": 1, "null": 1}
    assert sinks.high(spark, at) == "2024-01-03" and first["parts"]["53"]["low"] == "2024-01-01"
    assert sinks.publish(table.orderBy(F.desc("id")), at, by="campaign", bounds="day") == first  # equal rows in another order
    assert len([p for p in (tmp_path / "t" / "data").iterdir()]) == 1
    new = [(54, 7, date(2024, 2, 1), "n"), (55, 1, date(2023, 1, 1), "m")]
    second = sinks.publish(spark.createDataFrame(new, table.schema), at, by="campaign", bounds="day")
    assert rows(sinks.current(spark, at)) == sorted([r for r in ROWS if r[0] != 54] + new, key=str)
    assert second["parts"]["53"] == first["parts"]["53"] and second["version"] == 2 and second["replaced"] == [first["parts"]["54"]["folder"]]
    third = sinks.publish(spark.createDataFrame(new[:1], table.schema), at)  # the whole table
    assert rows(sinks.current(spark, at)) == new[:1] and third["version"] == 3
    assert sinks.publish(table.limit(0), at)["parts"] == {} and sinks.current(spark, at).count() == 0 and sinks.high(spark, at) is None
    with pytest.raises(ValueError, match="no table"):
        sinks.current(spark, f"{tmp_path}/none")


def test_a_broken_run_leaves_the_old_table(spark, table, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    sinks.publish(table, at, by="campaign")
    fails = F.udf(lambda x: 1 // (x - 2), "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        sinks.publish(table.withColumn("id", fails("id").cast("long")), at, by="campaign")
    assert rows(sinks.current(spark, at)) == sorted(ROWS, key=str)
    with pytest.raises(ValueError, match="2 times"):
        sinks.publish(table.unionByName(table), at, key=["campaign", "id"])
    with pytest.raises(ValueError, match="schema"):
        sinks.publish(table.withColumn("more", F.lit(1)), at, by="campaign")

    def broken(*a):
        raise OSError("the manifest can't be written")

    monkeypatch.setattr(sinks, "replace_text", broken)
    with pytest.raises(OSError):
        sinks.publish(table.filter("id = 1"), at)
    monkeypatch.undo()
    assert rows(sinks.current(spark, at)) == sorted(ROWS, key=str)
    assert sinks.publish(table.filter("id = 1"), at)["version"] == 2 and sinks.current(spark, at).count() == 3


def test_fresh_tables_are_read_without_a_job(spark, table, tmp_path):
    at, made = f"{tmp_path}/cache", []

    def make():
        made.append(1)
        return table.filter("day IS NOT NULL")

    assert sinks.cached(spark, at, "day", "2024-01-03", make).count() == 3 and made == [1]
    spark.sparkContext.setJobGroup("fresh", "no job")
    got = sinks.cached(spark, at, "day", "2024-01-03", make)
    assert made == [1] and list(spark.sparkContext.statusTracker().getJobIdsForGroup("fresh")) == []
    spark.sparkContext.setJobGroup("other", "")
    assert got.count() == 3
    sinks.cached(spark, at, "day", "2024-01-04", make)
    assert made == [1, 1]


def test_sanitised_traders(spark, tmp_path):
    t = spark.createDataFrame([(53, 1, "11", "k", True, 4, "z"), (53, 1, "11", "k", True, 4, "y"), (53, 2, None, None, False, -1, "x")], "campaign_id int, account long, challenge_type_id string, trader_key string, shared_ip boolean, ip_cluster_id int, other string")
    sinks.publish(t, f"{tmp_path}/t", by="campaign_id")
    active = spark.createDataFrame([(53, 1), (53, 1), (54, 9)], "campaign_id int, account_id long")
    assert rows(sinks.sanitised_traders(spark, f"{tmp_path}/t", active)) == [(53, 1, "11", "k", True, 4), (54, 9, None, None, None, None)]


def test_written_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_made", [])
    df = storage.written(spark.range(3), "gone")
    path = storage._made[0][1]
    assert df.count() == 3 and storage.exists(spark, path)
    storage.clear()
    assert not storage.exists(spark, path) and storage._made == []


START = datetime(2000, 1, 1)


def records(day: date, n: int, step: int = 30, base: int = 1000):
    at = (datetime(day.year, day.month, day.day) - START) // timedelta(minutes=1)
    return np.array([(at + step * i, base + i, base + 5 + i, base - 5 + i, base + 1 + i, 0, 0) for i in range(n)], dtype="<i4").tobytes()


@pytest.fixture
def folder(tmp_path):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    (tmp_path / "a").mkdir()
    (tmp_path / "info.json").write_text(json.dumps({"GOLD": {"priceScale": 100}, "BAD": {"priceScale": 0}}))
    (tmp_path / "a" / "first.bin").write_bytes(b"".join(records(d, 48) for d in days))
    (tmp_path / "a" / "later.bin").write_bytes(b"".join(records(date(2024, 2, d), 48) for d in (1, 2)) + b"\0\1")
    (tmp_path / "a" / "GOLD-2024-03-05.bin.gz").write_bytes(gzip.compress(records(date(2024, 3, 5), 48)))
    (tmp_path / "a" / "unnamed.bin.gz").write_bytes(gzip.compress(records(date(2024, 3, 6), 20)) + gzip.compress(records(date(2024, 3, 7), 20)))
    (tmp_path / "a" / "._junk.bin").write_bytes(b"junk")
    return str(tmp_path)


def test_ticks_scale_and_days(spark, folder):
    df = ticks.read_ticks(spark, folder, "GOLD", slice_records=50)
    assert df.count() == 48 * 6 + 40
    bars = {r["date"]: r for r in ticks.daily_bars(df).collect()}
    assert len(bars) == 8 and (bars[date(2024, 1, 2)]["open"], bars[date(2024, 1, 2)]["high"], bars[date(2024, 1, 2)]["low"], bars[date(2024, 1, 2)]["close"]) == (10.0, 10.52, 9.95, 10.48)
    for symbol in ("BAD", "NONE"):
        with pytest.raises(Exception, match="price scale"):
            ticks.read_ticks(spark, folder, symbol).count()


def test_a_day_reads_that_days_slices_only(spark, folder):
    d = date.fromisoformat
    for first, last, files, n in (
        (d("2024-01-02"), d("2024-01-02"), {"first.bin"}, 48), (d("2024-01-03"), d("2024-02-01"), {"first.bin", "later.bin"}, 96), (d("2024-03-05"), d("2024-03-05"), {"GOLD-2024-03-05.bin.gz"}, 48), (d("2030-01-01"), None, set(), 0), (None, d("2024-01-01"), {"first.bin"}, 48),
    ):
        got = ticks.read_ticks(spark, folder, "GOLD", first, last, slice_records=50)
        assert got.count() == n and {r[0].rsplit("/", 1)[-1] for r in got.select("file").distinct().collect()} == files
    reader = ticks.TickReader({"path": folder, "symbol": "GOLD", "slice": "50", "first": "2024-01-02", "last": "2024-01-02"})
    found = {(p.path.rsplit("/", 1)[-1], p.first, p.last) for p in reader.partitions()}
    assert found == {("first.bin", 48, 96), ("unnamed.bin.gz", 0, None)}  # a gzipped file without a day in its name can't be left out
    assert len(ticks.TickReader({"path": folder, "symbol": "GOLD", "slice": "50"}).partitions()) == 7
    both = ticks.read_ticks(spark, folder, "GOLD")  # one DataFrame, several queries
    assert both.filter("date = DATE'2030-01-01'").count() == 0 and both.filter("date = DATE'2024-01-02' OR open > 0").count() == 328


def test_ticks_out_of_order_fail(spark, folder, tmp_path):
    (tmp_path / "a" / "bad.bin").write_bytes(records(date(2024, 1, 2), 3) + records(date(2024, 1, 1), 3))
    with pytest.raises(Exception, match="order of time"):
        ticks.read_ticks(spark, folder, "GOLD").count()
