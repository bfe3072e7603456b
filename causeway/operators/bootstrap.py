"""Cluster bootstrap. Spark reduces rows to (sum, n) per cluster and condition; clusters are drawn with multiplicities.

The rule, at any size: each cluster has a Poisson(1) multiplicity in every draw, made from a hash of its key, and only sums
per condition and draw leave Spark. A cluster has one multiplicity a draw in all conditions, so differences of conditions
are paired. MULTINOMIAL, if the caller asks for it, draws as many clusters as there are, in the driver, and refuses more
than MOST_CELLS rows of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import sure
from ..storage import written
from .conditions import matched

MOST_CELLS = 200_000
POISSON, MULTINOMIAL = "poisson", "multinomial"
#: Clusters that a task draws for at once.
AT_ONCE = 512
#: The Poisson(1) distribution function, to the precision of a draw of 53 bits.
STEPS = np.cumsum([1 / np.e / factorial(i) for i in range(18)])


def _cells(rows: DataFrame) -> list:
    got = rows.limit(MOST_CELLS + 1).collect()
    if len(got) > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} rows of clusters: draw them by {POISSON}")
    return got


def _summary(means: np.ndarray, draws: int) -> tuple[float, float, float]:
    return float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5)), float(max(2 * (means <= 0).mean(), 1 / draws))


def _interval(top: np.ndarray, bottom: np.ndarray, settings: Settings) -> tuple[float, float, float]:
    """2.5 and 97.5 percentiles of the ratio over draws of all clusters, and the two-sided p of a mean over 0. Draws with nothing in them are left out."""
    rng, k = np.random.default_rng(settings.seed), len(top)
    means = []
    for _ in range(settings.draws):
        m = np.bincount(rng.integers(0, k, k), minlength=k)
        n = m @ bottom
        if n:
            means.append(m @ top / n)
    return _summary(np.array(means), settings.draws)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_sums(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """cells (condition, k, s, n) -> condition, d, top, bottom: sums of s and n in each draw. A cluster k has one multiplicity a draw in all conditions; sums are made in the tasks."""
    each = _mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            h, s, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "s", "n"))
            names = batch.column("condition").to_pylist()
            for at in range(0, len(h), AT_ONCE):
                u = (_mixed(h[at : at + AT_ONCE].view(np.uint64)[:, None] ^ each[None, :]) >> np.uint64(11)) / float(1 << 53)
                m = np.searchsorted(STEPS, u.ravel()).reshape(u.shape).astype(np.float64)
                own = np.array(names[at : at + AT_ONCE], dtype=object)
                for name in set(own.tolist()):
                    x = own == name
                    part = np.stack([s[at : at + AT_ONCE][x], n[at : at + AT_ONCE][x]]) @ m[x]
                    sums[name] = sums[name] + part if name in sums else part
        for name, (top, bottom) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(np.arange(draws)), pa.array(top), pa.array(bottom)], ["condition", "d", "top", "bottom"])

    rows = cells.select("condition", F.xxhash64("k", F.lit(seed)).alias("h"), F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    return rows.mapInArrow(run, "condition string, d long, top double, bottom double").groupBy("condition", "d").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))


def _poisson(cells: DataFrame, settings: Settings) -> dict[str, tuple[float, float, float]]:
    """lo, hi and p by condition."""
    means: dict[str, list[float]] = {}
    for r in poisson_sums(cells, settings.draws, settings.seed).filter("bottom > 0").collect():
        means.setdefault(r["condition"], []).append(r["top"] / r["bottom"])
    return {name: _summary(np.array(v), settings.draws) for name, v in means.items()}


def bootstrap_conditions(df: DataFrame, cluster: Column, named: dict[str, Column], value: str = "gross_loss_per_lot", settings: Settings = DEFAULT, method: str = POISSON) -> DataFrame:
    """condition, n, mean, lo, hi, p, clears_hurdle_95. All clusters are drawn, also those without rows of the condition; null clusters and values take no part."""
    base = df.withColumn("cluster_", cluster).filter(F.col("cluster_").isNotNull())
    schema = "condition string, n long, mean double, lo double, hi double, p double, clears_hurdle_95 boolean"
    rows = matched(base.filter(F.col(value).isNotNull()), named).groupBy("condition", "cluster_").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    out = []
    if method == POISSON:
        rows = written(rows, "cells")
        drawn = _poisson(rows.withColumnRenamed("cluster_", "k"), settings)
        totals = {r["condition"]: r for r in rows.groupBy("condition").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        for name in named:
            if name in totals:
                lo, hi, p = drawn[name]
                out.append((name, int(totals[name]["n"]), float(totals[name]["s"] / totals[name]["n"]), lo, hi, p, lo > settings.hurdle))
        return df.sparkSession.createDataFrame(out, schema)
    cells, keys = _cells(rows), sorted(r["cluster_"] for r in _cells(base.select("cluster_").distinct()))
    at = {k: i for i, k in enumerate(keys)}
    for name in named:
        top, bottom = np.zeros(len(keys)), np.zeros(len(keys))
        for r in cells:
            if r["condition"] == name:
                top[at[r["cluster_"]]], bottom[at[r["cluster_"]]] = r["s"], r["n"]
        if bottom.sum():
            lo, hi, p = _interval(top, bottom, settings)
            out.append((name, int(bottom.sum()), float(top.sum() / bottom.sum()), lo, hi, p, lo > settings.hurdle))
    return df.sparkSession.createDataFrame(out, schema)


def selected_interval(df: DataFrame, selected: Column, cluster: Column, value: str, weight: str | None = None, all_clusters: bool = False, order: str = "position_id", settings: Settings = DEFAULT, method: str = POISSON) -> tuple[float, float]:
    """Interval of the mean of value (weighted: of sum(value * weight) / sum(weight)) over selected rows.

    MULTINOMIAL draws clusters in order of their first row, with all_clusters also those without selected rows; these add
    nothing to a Poisson draw. Nothing selected gives (0, 0).
    """
    w = F.col(weight) if weight else F.lit(1.0)
    on = sure(selected)
    rows = df.groupBy(cluster.alias("k")).agg(F.min(order).alias("o"), F.coalesce(F.sum(F.when(on, F.col(value) * w)), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(on, w)), F.lit(0.0)).alias("n"), F.count_if(on).alias("c"))
    if method == POISSON:
        return _poisson(rows.filter("c > 0").withColumn("condition", F.lit("")), settings).get("", (0.0, 0.0, 1.0))[:2]
    cells = sorted(_cells(rows if all_clusters else rows.filter("c > 0")), key=lambda r: r["o"])
    if not any(r["c"] for r in cells):
        return 0.0, 0.0
    lo, hi, _ = _interval(np.array([r["s"] for r in cells]), np.array([r["n"] for r in cells]), settings)
    return lo, hi


def poisson_bootstrap(df: DataFrame, cluster: Column, value: str, draws: int = DEFAULT.draws, seed: int = 7) -> DataFrame:
    """lo and hi without collecting clusters: each cluster has a Poisson(1) multiplicity in every draw, made from a hash of its key."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(cluster.alias("k")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    means = poisson_sums(cells.withColumn("condition", F.lit("")), draws, seed).select(F.try_divide("top", "bottom").alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))


def paired_sums(rows: DataFrame, cluster: Column, sums: dict[str, tuple[Column, Column]], settings: Settings = DEFAULT) -> tuple[dict[str, tuple[float, float]], dict[str, np.ndarray]]:
    """sums: name -> two columns. Their totals, and an array (draws, 2) of their totals in every draw; all names share the clusters' multiplicities. Null clusters take no part, null values count 0."""
    told = rows.select(cluster.alias("k"), F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.coalesce(a.cast("double"), F.lit(0.0)).alias("s"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("n")) for n, (a, b) in sums.items()])).alias("c")).filter("k IS NOT NULL")
    cells = written(told.select("k", "c.*").groupBy("k", "condition").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "cells")
    whole = {r["condition"]: (r["s"], r["n"]) for r in cells.groupBy("condition").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    drawn = {n: np.zeros((settings.draws, 2)) for n in sums}
    for r in poisson_sums(cells, settings.draws, settings.seed).collect():  # draws times names
        drawn[r["condition"]][r["d"]] = r["top"], r["bottom"]
    return whole, drawn
