"""The choice of a penalty and a whole fit, against numpy and pandas on the collected rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions.exprs import account_cluster
from causeway.operators import compare, model
from causeway.operators.folds import inner_windows
from causeway.operators.stats import least_effect, winsorised
from causeway.plans.queries import CATEGORICAL, NUMERIC
from causeway.plans.tables import model_rows
from causeway.storage import written

TARGET = "reverse_profit_per_lot"


@pytest.fixture(scope="module")
def rows(spark, sf):
    return written(model_rows(spark, sf).filter("campaign_id <= 58"), "rows")


def collected(rows, design, target):
    data = np.array([list(r) for r in rows.select("campaign_id", *[c.alias(f"c{i}") for i, c in enumerate(design.columns())], target).collect()], dtype=float)
    return data[:, 0].astype(int), data[:, 1:-1], data[:, -1]


def fitted(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


def test_penalty_and_fit(rows):
    clipped = written(winsorised(rows, TARGET), "clipped")
    design = model.fit_design(rows, NUMERIC, CATEGORICAL)
    campaign, x, y = collected(clipped, design, f"{TARGET}_w")
    inner = inner_windows(sorted(set(campaign.tolist())))
    alphas = (0.1, 10.0, 1000.0)
    chosen, report = model.choose_alpha(clipped, design, f"{TARGET}_w", inner, alphas)
    want = []
    for a in alphas:
        rho, mae = [], []
        for train, val in inner:
            b, w = fitted(x[np.isin(campaign, train)], y[np.isin(campaign, train)], a)
            on = np.isin(campaign, val)
            p = x[on] @ w + b
            r = pd.Series(p).round(9).rank().corr(pd.Series(y[on]).rank())
            if not np.isnan(r):
                rho.append(r)
                mae.append(np.abs(p - y[on]).mean())
        want.append((a, np.mean(rho), np.mean(mae)))
    for got, w in zip(report, want, strict=True):
        assert got[0] == w[0] and got[1] == pytest.approx(w[1], abs=2e-3) and got[2] == pytest.approx(w[2], rel=1e-6)
    assert chosen == min(want, key=lambda r: (-round(r[1], 3), r[2]))[0] or abs(sorted(r[1] for r in want)[-1] - sorted(r[1] for r in want)[-2]) < 4e-3
    art = model.fit_all(rows, NUMERIC, CATEGORICAL)
    b, w = fitted(x, y, art["alpha"])
    assert art["intercept"] == pytest.approx(b, abs=1e-5) and np.allclose(art["weights"], w, atol=1e-5)
    p, actual = x @ w + b, collected(rows, design, TARGET)[2]
    grid = [t for t in np.linspace(-100, 500, 601) if (p > t).sum() >= model.LEAST_SELECTED]
    best = max((round(actual[p > t].mean(), 9), t) for t in grid) if grid else (0.0, 0.0)
    assert art["threshold"] == pytest.approx(best[1])


def test_frontier_effects(rows):
    df = rows.select("account_id", "position_id", F.col(TARGET).alias("y"), (F.col("position_id") % 97).cast("double").alias("score"))
    got = model.frontier(df, "score", (0.25, 1.0), "y", account_cluster(F.col("account_id"), F.col("position_id"))).collect()
    sd = df.agg(F.stddev_samp("y")).first()[0]
    for r in got:
        assert r["mde"] == pytest.approx(least_effect(sd, r["n"], max(r["deff"], 0.0))) and r["mde_floored"] == pytest.approx(least_effect(sd, r["n"], max(r["deff"], 1.0)))
    assert model.frontier(df.limit(0), "score", (0.5,), "y", F.col("account_id")).columns == got[0].__fields__


def test_split_is_counted(rows):
    n = rows.filter("campaign_id <= 53").count(), rows.filter("campaign_id > 53").count()
    assert compare.mandated_split(rows, 53, expected=n)[0].count() == n[0]
    with pytest.raises(ValueError, match="rows of training"):
        compare.mandated_split(rows, 53, expected=(n[0] + 1, n[1]))
