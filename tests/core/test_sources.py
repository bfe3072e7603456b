import gzip
import struct

import pytest
from pyspark.sql import functions as F

from causeway.operators import model
from causeway.operators.buckets import bucket, edges
from causeway.operators.folds import windows
from causeway.operators.forensics import sanitised
from causeway.operators.positions import to_positions
from causeway.operators.stats import prune
from causeway.sources import fills as s
from causeway.sources.reports import to_markdown


def _write(folder, name, rows, header=s.FILL_COLUMNS):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(",".join(header) + "\n" + "".join(",".join(str(r.get(c, "")) for c in header) + "\n" for r in rows))


def _fill(pos, close, sl="", trade=1, amount=1.0):
    return {"accountId": "a", "openDateTime": "2026-05-01 09:00:00", "closeDateTime": close, "positionId": pos, "slPrice": sl, "amount": amount, "profit": 2.0, "closePrice": 10.0 * trade, "closeTradeId": trade, "openPrice": "n/a", "side": "BUY"}


def test_read_collapse_and_ids(spark, tmp_path):
    big = 1234567890123456789
    _write(tmp_path / "x", "Campaign 53 Data 1st May 2026 XAUUSD only.csv", [_fill(big, "2026-05-01 10:00:00"), _fill(big, "2026-05-01 10:00:00", 98.5, 2, 3.0), _fill(big + 1, "2026-05-01 11:00:00", 97)])
    _write(tmp_path / "y", "Campaign 66 Data 8 Jun 2026 XAUUSD only.csv", [_fill(7, "2026-06-08 10:00:00")])
    _write(tmp_path / "__MACOSX", "Campaign 54 Data 1 May 2026 XAUUSD only.csv", [_fill(9, "2026-05-01 10:00:00")])
    df = s.read_fills(spark, str(tmp_path))
    assert df.count() == 4 and {r[0] for r in df.select("campaign_id").distinct().collect()} == {53, 66}
    assert df.filter("campaign_id = 66").first()["positionId"] == 66 and df.filter("openPrice IS NOT NULL").count() == 0
    assert s.completeness(df, range(53, 55)) == {"missing": [54], "unexpected": [66]}
    pos = {r["position_id"]: r for r in to_positions(s.engine_columns(df)).collect()}
    assert pos[big]["sl_price"] == 98.5 and pos[big]["n_fills"] == 2 and pos[big]["close_price"] == pytest.approx((10 + 60) / 4) and pos[big]["commission"] == 0
    legacy = to_positions(s.engine_columns(s.read_fills(spark, str(tmp_path), id_mode="legacy_float")))
    assert legacy.filter("campaign_id = 53").count() == 1  # neighbours merge


def test_contract():
    with pytest.raises(ValueError, match="position_id"):
        s.check_contract([c for c in s.FILL_COLUMNS if c != "positionId"] + ["position_id"])
    with pytest.raises(ValueError, match="padded"):
        s.check_contract([*s.FILL_COLUMNS[1:], " accountId"])


def test_bad_name_raises(spark, tmp_path):
    _write(tmp_path / "z", "no campaign here.csv", [_fill(1, "2026-05-01 10:00:00")])
    with pytest.raises(Exception, match="no campaign"):
        s.read_fills(spark, str(tmp_path)).collect()


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    _write(tmp_path, "Campaign 53 Data 1st May 2026 XAUUSD only.csv", [_fill(1, "2026-05-01 10:00:00", 98.5)])
    _write(tmp_path, "Campaign 54 Data 8 May 2026 XAUUSD only.csv", [_fill(2, "2026-05-08 10:00:00", 97.5)], [*reversed(s.FILL_COLUMNS), "extra"])
    got = {r["positionId"]: r for r in s.read_fills(spark, str(tmp_path)).collect()}
    assert [(got[i]["accountId"], got[i]["slPrice"], got[i]["side"], got[i]["campaign_id"]) for i in (1, 2)] == [("a", 98.5, "BUY", 53), ("a", 97.5, "BUY", 54)]
    _write(tmp_path, "Campaign 55 Data 15 May 2026 XAUUSD only.csv", [], [c if c != "positionId" else "position_id" for c in s.FILL_COLUMNS])
    with pytest.raises(ValueError, match="position_id"):  # every file is held to the contract, not the first alone
        s.read_fills(spark, str(tmp_path))


def test_bad_dates_raise(spark, tmp_path):
    _write(tmp_path, "Campaign 53 Data 31 Feb 2026 XAUUSD only.csv", [_fill(1, "2026-05-01 10:00:00")])
    with pytest.raises(ValueError, match="no campaign date"):
        s.read_fills(spark, str(tmp_path))


def test_two_eras_leak_no_person(spark, tmp_path):
    (tmp_path / "Campaign 40 traders.csv").write_text("ACCOUNT,EMAIL,IP ADDRESS\n1,one@x.invalid,192.0.2.1\n")
    (tmp_path / "Campaign 60 traders.csv").write_text('telegram_username,challenge_type_id,Team Colour,account,email,ip_address,email\ntg_two,11,blue,2,two@x.invalid,192.0.2.2,again@x.invalid\n')
    (tmp_path / "Campaign 61 traders.csv").write_text("")
    raw = s.read_registrations(spark, str(tmp_path))
    got = {r["account"]: r.asDict() for r in raw.collect()}
    assert got["2"] == {"account": "2", "email": "two@x.invalid", "ip_address": "192.0.2.2", "telegram_username": "tg_two", "challenge_type_id": "11", "campaign_id": 60, "team_colour": "blue"}
    assert (got["1"]["email"], got["1"]["ip_address"], got["1"]["campaign_id"], got["1"]["challenge_type_id"], got["1"]["team_colour"]) == ("one@x.invalid", "192.0.2.1", 40, None, None)
    kept = [str(v) for r in sanitised(raw).collect() for v in r]
    assert not any(x in v for v in kept for x in ("@", "192.0.2", "tg_two")) and {"blue", "11"} <= set(kept)
    assert s.read_registrations(spark, str(tmp_path / "none")).count() == 0


def test_registrations_and_sanitising(spark, tmp_path):
    (tmp_path / "Campaign 40 traders.csv").write_text("ACCOUNT,EMAIL,IP ADDRESS\n1, A@Example.invalid ,192.0.2.1\n2,nan,\n")
    df = sanitised(s.read_registrations(spark, str(tmp_path)))
    got = {r["account"]: r for r in df.collect()}
    assert got["2"]["trader_key"] is None and len(got["1"]["trader_key"]) == 12 and not {"email", "ip_address", "telegram_username"} & set(df.columns)


def test_ticks(spark, tmp_path):
    data = b"".join(struct.pack("<7i", m, 100 + m, 110, 90, 105 + m, 0, 0) for m in (0, 1, 1440))
    (tmp_path / "a.bin.gz").write_bytes(gzip.compress(data))
    got = s.daily_from_ticks(s.read_ticks(spark, str(tmp_path), 10.0)).orderBy("date").collect()
    assert [r["open"] for r in got] == [10.0, 154.0] and got[0]["close"] == 10.6 and str(got[0]["date"]) == "2000-01-01"


def test_report(spark):
    text = to_markdown(spark.createDataFrame([("a|b", 0.5), (None, None)], "k string, v double"), {"v": ".2f"}, lambda r: r["v"] == 0.5)
    assert text.splitlines()[2:] == ["| a\\|b | 0.50 ! |", "|  |  |"]


def test_edges_and_buckets(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "v double")
    e = edges(df, "v", 4)
    assert e[0] == 1.0 and len(e) < 5  # quartile edges fall together
    got = [r[0] for r in df.select(bucket(F.col("v"), e)).collect()]
    assert got[0] == 0 and got[-1] == len(e) - 2 and edges(df.limit(0), "v", 4) == []


def test_windows_and_prune():
    assert [len(v) for _, v in windows(range(13), 4, 4)] == [2, 2, 2, 3]
    with pytest.raises(ValueError):
        windows(range(7), 4, 4)
    assert prune([("a", "b", 0.95), ("b", "c", 0.94)], {"a": 1.0, "b": 0.9, "c": 1.0}) == [("b", "a", 0.95)]


def test_ridge_against_numpy(spark, sf):
    import numpy as np

    from causeway.plans.queries import CATEGORICAL, NUMERIC
    from causeway.plans.tables import model_rows

    rows = model_rows(spark, sf)
    d = model.fit_design(rows, NUMERIC, CATEGORICAL)
    data = np.array([list(r) for r in rows.select(*[c.alias(f"c{i}") for i, c in enumerate(d.columns())], "reverse_profit_per_lot").collect()], dtype=float)
    x, y = data[:, :-1], data[:, -1]
    b, w = model.ridge(model.gram(rows, d.columns(), F.col("reverse_profit_per_lot"))[None], 3.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(w, want, atol=1e-6) and b == pytest.approx(y.mean() - x.mean(0) @ want)
    with pytest.raises(ValueError, match="close"):
        model.fit_design(rows, ["net_profit"], [])


def test_artifact_round_trip(spark, sf, tmp_path):
    from causeway.plans.queries import FIXED

    digest = model.save(FIXED, f"{tmp_path}/m.json")
    got = model.load(f"{tmp_path}/m.json")
    assert len(digest) == 64 and got["weights"] == FIXED["weights"]
    (tmp_path / "m_columns.json").write_text('["a"]')
    with pytest.raises(ValueError):
        model.load(f"{tmp_path}/m.json")
