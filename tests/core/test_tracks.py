"""Fits of several models and purges at once, against fits one by one."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.config import DEFAULT
from causeway.functions.exprs import account_cluster
from causeway.operators import compare, folds, nested, ranks, tracks
from causeway.plans.queries import FLAGGED
from causeway.plans.tables import model_rows
from causeway.storage import written

TARGET = "gross_loss_per_lot"
MODELS = {"x": (["amount", "trade_index"], []), "z": (["amount", "pnl_ewm", "size_delta_ratio", "late", "flat"], ["challenge_type"]), "flat": (["flat"], [])}


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = model_rows(spark, sf).filter("campaign_id BETWEEN 53 AND 60").withColumns({"late": F.when(F.col("campaign_id") > 57, F.col("amount")), "flat": F.lit(3.25)})
    own = own.withColumn(TARGET, F.when(F.col("position_id") % 50 != 0, F.round(TARGET, -1)))  # outcomes tie, some are missing
    return written(nested.inner_purged(own, "A", FLAGGED).withColumn("kept", F.lit(None).cast("boolean")), "rows")


def test_fits_equal_those_of_one_model_and_purge(rows, monkeypatch):
    """With many ranges and jobs, and tasks that sum up early."""
    for name, value in (("RANGE_ROWS", 9), ("TASK_ROWS", 7), ("JOB_ROWS", 2_000), ("LAID_BY", 30)):
        monkeypatch.setattr(tracks, name, value)
    splits = [train for train, _ in folds.windows(range(53, 61), 2, 4)] + [[999]]
    alphas = (0.01, 1.0, 30.0, 1000.0)
    got = tracks.fit_models(rows, splits, MODELS, TARGET, ["purged", "kept"], alphas)
    assert set(got) == {(p, m) for p in ("purged", "kept") for m in MODELS}
    for (p, m), fits in got.items():
        want = nested.fit_folds(rows.withColumn("purged", F.coalesce(p, F.lit(False))), splits, *MODELS[m], TARGET, alphas)
        assert sorted(fits) == sorted(want) == [1, 2]
        for f, fit in fits.items():
            assert fit.alpha == pytest.approx(want[f]["alpha"]) and fit.intercept == pytest.approx(want[f]["intercept"]) and fit.design.names == want[f]["columns"]
            assert np.allclose(fit.weights, want[f]["weights"], rtol=1e-7, atol=1e-9) and fit.design.median == want[f]["median"]


def test_correlations_of_ranges_equal_those_of_whole_columns(rows, monkeypatch):
    """Every rank correlation, of clipped outcomes and under both purges, against pandas."""
    monkeypatch.setattr(tracks, "RANGE_ROWS", 11)
    asked, sums = [], {}
    monkeypatch.setattr(tracks, "_penalties", lambda *a, f=tracks._penalties: asked.append(a) or f(*a))
    monkeypatch.setattr(tracks, "_summed", lambda *a, f=tracks._summed: sums.update(out := f(*a)) or out)
    tracks.fit_models(rows, [range(53, 58)], MODELS, TARGET, ["purged", "kept"], (1.0, 100.0))
    own, raw, vectors, clips = asked[0][:4]
    data = own.select("campaign_id", "y_", "gone0_", "gone1_", F.array(F.lit(1.0), *raw.columns()).alias("z")).toPandas()
    assert len(sums) == len(vectors) == 3 * 3 * 2 and data["gone0_"].any() and not data["gone1_"].any()
    for i, v in enumerate(vectors):
        part = data[data["campaign_id"] == v.campaign]
        pairs = pd.DataFrame({"p": tracks._predicted(list(np.array(part["z"].tolist()).T), v), "y": part["y_"].clip(*clips[1])}, index=part.index)
        for t in (0, 1):
            want = pairs[~part[f"gone{t}_"]].corr(method="spearman").iloc[0, 1]
            assert tracks._correlation(sums[i], t) == (None if np.isnan(want) else pytest.approx(want, abs=1e-12))


def test_quantiles_of_folds(rows, monkeypatch):
    """Against quantiles of all values; also where the sketch's bounds miss the place between two values."""
    splits = [[53], [53, 54, 55], [999]]
    shares = {"amount": [0.5], "late": [0.5], "pnl_ewm": [0.0, 0.37, 1.0], TARGET: [0.01, 0.99], "flat": [0.5]}
    want = {}
    for f, cs in enumerate(splits, 1):
        for c, s in shares.items():
            for r in ranks.quantiles(rows.filter(F.col("campaign_id").isin(cs)), [c], s).collect():
                want.setdefault(f, {})[c] = r["quantiles"]
    for accuracy in (tracks.ACCURACY, 40, 10**8):
        monkeypatch.setattr(tracks, "ACCURACY", accuracy)
        assert tracks.quantiles_of_folds(rows, splits, shares) == want


def shuffled(spark):
    """Stage -> the rows that it wrote for a shuffle, of the stages that are still listed."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_rule_deals_predictions_out_once(spark, rows):
    """Predictions of the inner folds go in blocks, once for both tracks together, so far fewer rows than these are shuffled."""
    splits = folds.windows(range(53, 61), 2, 4)
    inner = sum(rows.filter(F.col("campaign_id").isin(train[2:]) & F.col(TARGET).isNotNull()).count() for train, _ in splits)
    before = shuffled(spark)
    compare.include_rule(rows.drop("purged", "kept"), splits, MODELS["x"], MODELS["z"], account_cluster(F.col("account_id"), F.col("position_id")), pairs=FLAGGED, settings=dataclasses.replace(DEFAULT, draws=10)).collect()
    assert inner < sum(n for k, n in shuffled(spark).items() if k not in before) < 3 * 26 * inner
