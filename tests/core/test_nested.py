"""Nested folds from Gram sums, against fits of each fold's own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import folds, model, nested
from causeway.plans.queries import CATEGORICAL, FLAGGED, NUMERIC
from causeway.plans.tables import model_rows
from causeway.storage import written

TARGET = "reverse_profit_per_lot"


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = model_rows(spark, sf).filter("campaign_id BETWEEN 53 AND 62")
    # a column of large values with little spread, one that is missing throughout in training, one without spread
    own = own.withColumns({"far": F.lit(1e7) + F.col("trade_index"), "late": F.when(F.col("campaign_id") > 58, F.col("amount")), "flat": F.lit(3.25)})
    return written(nested.inner_purged(own, "A", FLAGGED), "rows")


def test_artifacts_of_all_folds_equal_a_fit_of_each(rows):
    splits = [train for train, _ in folds.windows(range(53, 63), 3, 4)]
    numeric = [*NUMERIC, "far", "late", "flat"]
    got = nested.fit_folds(rows.drop("purged"), splits, numeric, CATEGORICAL)
    assert sorted(got) == [1, 2, 3]
    for f, train in enumerate(splits, 1):
        own = written(rows.filter(F.col(TARGET).isNotNull() & F.col("campaign_id").isin(train)), "own")
        want = model.fit_all(own, numeric, CATEGORICAL)
        assert got[f].keys() == want.keys() and got[f]["columns"] == want["columns"] and got[f]["alpha"] == pytest.approx(want["alpha"])
        assert got[f]["threshold"] == want["threshold"] and got[f]["score_scale"] == pytest.approx(want["score_scale"], rel=1e-6)
        for part in ("median", "mean", "scale"):
            assert all(got[f][part][c] == pytest.approx(want[part][c], rel=1e-9, abs=1e-9) for c in numeric), (f, part)
        assert got[f]["intercept"] == pytest.approx(want["intercept"], rel=1e-6) and np.allclose(got[f]["weights"], want["weights"], rtol=1e-5, atol=1e-7)


def test_inner_purge_and_downdated_fits(rows):
    """Marks against a loop over folds; fits and errors against numpy on the filtered rows."""
    data = [r.asDict() for r in rows.filter(F.col(TARGET).isNotNull()).select("campaign_id", "trader_key", "ip_cluster_id", "amount", "trade_index", TARGET, "purged").collect()]
    for r in data:
        before = [x for x in data if x["campaign_id"] < r["campaign_id"]]
        trader = r["trader_key"] is not None and r["trader_key"] in {x["trader_key"] for x in before}
        ip = r["ip_cluster_id"] is not None and r["ip_cluster_id"] in {x["ip_cluster_id"] for x in before} and (r["ip_cluster_id"], r["campaign_id"]) in FLAGGED
        assert r["purged"] == (trader or ip)
    assert 10 < sum(r["purged"] for r in data) < len(data) - 10
    campaigns = sorted({r["campaign_id"] for r in data})
    x = lambda rs: np.array([[1.0, r["amount"], float(r["trade_index"])] for r in rs])
    y = lambda rs: np.array([r[TARGET] for r in rs])
    for purge in (False, True):
        fits = nested.inner_fits(rows, [F.col("amount"), F.col("trade_index")], TARGET, [1.0, 100.0], purge_training=purge)
        assert [f[0] for f in fits] == [i for i in range(1, len(campaigns) - 1) for _ in "ab"]
        for fold, alpha, n, m, b, w, mse in fits:
            train = [r for r in data if r["campaign_id"] in campaigns[: fold + 1] and not (purge and r["purged"])]
            val = [r for r in data if r["campaign_id"] == campaigns[fold + 1] and not r["purged"]]
            want = np.linalg.solve(x(train).T @ x(train) + np.diag([0.0, alpha, alpha]), x(train).T @ y(train))
            assert (n, m) == (len(train), len(val)) and np.allclose([b, *w], want, rtol=1e-6, atol=1e-6)
            assert mse is None if not val else mse == pytest.approx(((x(val) @ want - y(val)) ** 2).mean(), rel=1e-6)


def test_purged_rows_leave_inner_validation(rows, monkeypatch):
    asked = []
    real = nested.spearman
    monkeypatch.setattr(nested, "spearman", lambda df, *a: asked.append(df.count()) or real(df, *a))
    nested.fit_folds(rows, [range(53, 58)], ["amount"], [], alphas=(1.0, 10.0))
    nested.fit_folds(rows.drop("purged"), [range(53, 58)], ["amount"], [], alphas=(1.0, 10.0))
    gone = rows.filter(f"purged AND campaign_id BETWEEN 55 AND 57 AND {TARGET} IS NOT NULL").count()
    assert gone and asked[1] - asked[0] == gone


def test_tracks_and_empty_folds(spark, rows):
    assert nested.inner_purged(rows.drop("purged"), "B").filter("purged").count() == 0
    with pytest.raises(ValueError):
        nested.inner_purged(rows, "C")
    with pytest.raises(ValueError, match="close"):
        nested.fit_folds(rows, [[53]], ["net_profit"], [])
    assert nested.fit_folds(rows, [[999]], ["amount"], []) == {}
    one = nested.fit_folds(rows, [[53]], ["amount"], ["challenge_type"])[1]
    assert one["alpha"] == 1.0 and nested.inner_sizes(rows.filter("campaign_id < 55")).count() == 0
