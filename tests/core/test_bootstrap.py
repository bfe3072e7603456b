import dataclasses
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.config import DEFAULT
from causeway.functions.exprs import account_cluster
from causeway.operators import bootstrap, compare, folds
from causeway.plans import queries
from causeway.plans.tables import model_rows
from causeway.storage import written


def test_random_in_step_draws_as_often_as_the_operator(monkeypatch):
    got = {}
    monkeypatch.setattr(queries, "with_traders", lambda *a: None)
    monkeypatch.setattr(queries.a, "positions", lambda *a: None)
    monkeypatch.setattr(queries, "rounded", lambda df: df)
    real = inspect.signature(compare.random_in_step)
    monkeypatch.setattr(compare, "random_in_step", lambda *a, **b: got.update(real.bind(*a, **b).arguments))
    queries.QUERIES["random_in_step"](None, None)
    assert got.get("draws", real.parameters["draws"].default) == 100


def test_intervals_beyond_the_bound_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(k), float(rng.normal(k % 3, 4))) for i, k in enumerate(rng.integers(0, 400, 2000))], "position_id long, k long, v double")
    named = {"all": F.lit(True), "high": F.col("k") > 200, "none": F.col("k") < 0}

    def got(method):
        rows = bootstrap.bootstrap_conditions(df, F.col("k"), named, "v", method=method).collect()
        return {r["condition"]: r for r in rows}, bootstrap.selected_interval(df, F.col("k") > 200, F.col("k"), "v", method=method)

    want, span = got(bootstrap.MULTINOMIAL)
    have, wide = got(bootstrap.POISSON)
    monkeypatch.setattr(bootstrap, "MOST_CELLS", 50)
    assert got(bootstrap.POISSON) == (have, wide)  # one estimator at any size
    with pytest.raises(ValueError, match="poisson"):
        got(bootstrap.MULTINOMIAL)
    assert set(have) == set(want) == {"all", "high"} and wide == pytest.approx(span, abs=0.06)
    for name, r in have.items():
        assert (r["n"], r["mean"]) == (want[name]["n"], pytest.approx(want[name]["mean"]))
        assert (r["lo"], r["hi"]) == pytest.approx((want[name]["lo"], want[name]["hi"]), abs=0.06)
    assert inspect.signature(bootstrap.poisson_bootstrap).parameters["draws"].default == DEFAULT.draws


def multiplicities(spark, keys, draws, seed):
    """(cluster, draw) as the operator draws them."""
    cells = spark.createDataFrame([(str(k), k, 1.0, 0.0) for k in keys], "condition string, k string, s double, n double")
    out = {k: np.zeros(draws) for k in keys}
    for r in bootstrap.poisson_sums(cells, draws, seed).collect():
        out[r["condition"]][r["d"]] = r["top"]
    return out


def test_paired_sums_share_their_draws(spark):
    settings = dataclasses.replace(DEFAULT, draws=60)
    rng = np.random.default_rng(1)
    data = [(f"k{int(k)}", float(a), None if rng.random() < 0.2 else float(a * 2)) for k, a in zip(rng.integers(0, 30, 300), rng.normal(size=300), strict=True)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, a double, b double")
    whole, drawn = bootstrap.paired_sums(df, F.col("k"), {"x": (F.col("a"), F.lit(1.0)), "y": (F.col("b"), F.when(F.col("b").isNotNull(), 1.0))}, settings)
    m = multiplicities(spark, sorted({k for k, _, _ in data if k}), 60, settings.seed)
    own = [(k, a, b) for k, a, b in data if k]
    assert whole["x"] == pytest.approx((sum(a for _, a, _ in own), len(own))) and whole["y"][1] == sum(b is not None for _, _, b in own)
    for d in range(60):
        assert drawn["x"][d] == pytest.approx((sum(m[k][d] * a for k, a, _ in own), sum(m[k][d] for k, _, _ in own)))
        assert drawn["y"][d] == pytest.approx((sum(m[k][d] * (b or 0.0) for k, _, b in own), sum(m[k][d] for k, _, b in own if b is not None)))


def test_include_rule_against_pandas(spark, sf):
    """Pooled figures and paired intervals from the walk-forward scores, by pandas and the same multiplicities."""
    settings = dataclasses.replace(DEFAULT, draws=80, hurdle=-5.0)
    rows = written(model_rows(spark, sf).filter("campaign_id BETWEEN 53 AND 61"), "rows")
    splits = folds.windows(range(53, 62), 2, 5)
    base, candidate = (["amount"], []), (["amount", "cum_pnl_usd", "loss_streak"], ["challenge_type"])
    cluster = account_cluster(F.col("account_id"), F.col("position_id"))
    got = {r["track"]: r for r in compare.include_rule(rows, splits, base, candidate, cluster, pairs=queries.FLAGGED, settings=settings).collect()}
    economics = {}
    for track in ("A", "B"):
        scored = compare.walk_forward(rows.withColumn("c", cluster), splits, {"x": base, "z": candidate}, "gross_loss_per_lot", track, queries.FLAGGED, ["c"]).toPandas().dropna(subset=["gross_loss_per_lot"])
        r, y = got[track], scored["gross_loss_per_lot"]
        assert r["n"] == len(scored) > 30
        for name, col in (("base", "x"), ("candidate", "z")):
            on = scored[col] > settings.hurdle
            assert r[f"rho_{name}"] == pytest.approx(scored[[col, "gross_loss_per_lot"]].corr(method="spearman").iloc[0, 1]) and (r[f"mean_{name}"] == pytest.approx(y[on].mean()) if on.any() else r[f"mean_{name}"] is None)
        m = multiplicities(spark, sorted(set(scored["c"])), 80, settings.seed)
        weight = np.array([m[c] for c in scored["c"]])  # rows, draws
        ranks = {c: (scored[c].rank() - (len(scored) + 1) / 2).to_numpy() for c in ("x", "z", "gross_loss_per_lot")}
        rho = lambda c: (weight * (ranks[c] * ranks["gross_loss_per_lot"])[:, None]).sum(0) / np.sqrt((weight * (ranks[c] ** 2)[:, None]).sum(0) * (weight * (ranks["gross_loss_per_lot"] ** 2)[:, None]).sum(0))  # noqa: B023,E731
        assert (r["rho_lo"], r["rho_hi"]) == pytest.approx(tuple(np.percentile(rho("z") - rho("x"), [2.5, 97.5]))) and r["rho_difference"] == pytest.approx(r["rho_candidate"] - r["rho_base"])
        economics[track] = r
    a, b = economics["A"], economics["B"]
    assert a["include"] == b["include"] == (b["rho_candidate"] > b["rho_base"] and (a["mean_base"] is None or a["mean_candidate"] is None or a["mean_candidate"] >= 0.9 * a["mean_base"]))
