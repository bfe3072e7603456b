"""Walk-forward models of all folds from few passes: purged inner folds, and an artifact per fold, by sums of Gram sums.

What a ridge fit reads of the data are sums over rows. They are taken once per campaign (and per purge mark) over raw
columns: values with 0 where they are missing, marks of what is missing, and levels. A fold's training sums are those of
its campaigns. Its medians, means and deviations enter afterwards, as a linear map: with the median m filled in and the
column standardised, x becomes (x0 + m * missing - mean) / deviation. Columns are first shifted and scaled by figures of
the whole table, which no result depends on, so that squares don't cancel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sure
from ..storage import written
from . import model
from .folds import inner_windows
from .ranks import quantiles
from .stats import spearman

WINSOR = (0.01, 0.99)
#: The chosen penalty is made larger by this before the fit that is frozen.
FROZEN = 10**0.5


def inner_purged(rows: DataFrame, track: str = "A", pairs: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """rows with purged: whether, as a validation row of the inner fold that trains on all earlier campaigns, it would meet an identity that trained.

    Track A: its trader occurs in an earlier campaign, or its address does and (address, campaign) is one of pairs. Missing
    keys never match. Track B purges nothing. Inner folds expand from the first campaign on, so a row has one mark.
    """
    if track not in ("A", "B"):
        raise ValueError(f"track must be A or B, got {track!r}")
    if track == "B":
        return rows.withColumn("purged", F.lit(False))
    traders = rows.filter("trader_key IS NOT NULL").groupBy("trader_key").agg(F.min("campaign_id").alias("trader_from_"))
    ips = rows.filter("ip_cluster_id IS NOT NULL").groupBy("ip_cluster_id").agg(F.min("campaign_id").alias("ip_from_"))
    flagged = rows.sparkSession.createDataFrame([*pairs], "ip_cluster_id int, campaign_id int").distinct().withColumn("flagged_", F.lit(True))  # pairs is a literal list
    marked = rows.join(traders, "trader_key", "left").join(ips, "ip_cluster_id", "left").join(F.broadcast(flagged), ["ip_cluster_id", "campaign_id"], "left")
    purged = sure(F.col("trader_from_") < F.col("campaign_id")) | (sure(F.col("ip_from_") < F.col("campaign_id")) & sure(F.col("flagged_")))
    return marked.withColumn("purged", purged).select(*rows.columns, "purged")


def inner_sizes(rows: DataFrame, least: int = 2) -> DataFrame:
    """rows (with purged) -> inner_fold, train_rows, raw_val_rows, val_rows of every inner fold, from counts per campaign."""
    counts = {(r["campaign_id"], r["purged"]): r["n"] for r in rows.groupBy("campaign_id", "purged").agg(F.count(F.lit(1)).alias("n")).collect()}  # two per campaign
    n = lambda cs, *marks: sum(counts.get((c, m), 0) for c in cs for m in marks)
    out = [(i, n(train, True, False), n(val, True, False), n(val, False)) for i, (train, val) in enumerate(inner_windows(sorted({c for c, _ in counts}), least), 1)]
    return rows.sparkSession.createDataFrame(out, "inner_fold int, train_rows long, raw_val_rows long, val_rows long")


def less(whole: model.Gram, part: model.Gram) -> model.Gram:
    """The sums of the rows that aren't in part."""
    return model.Gram(whole.xx - part.xx, whole.xy - part.xy, whole.yy - part.yy, whole.n - part.n)


def mean_squared_error(g: model.Gram, intercept: float, weights: np.ndarray) -> float | None:
    """Of a linear model over the rows whose sums these are."""
    w = np.array([intercept, *weights])
    return float((g.yy - 2 * w @ g.xy + w @ g.xx @ w) / g.n) if g.n else None


def inner_fits(rows: DataFrame, columns: Sequence[Column], target: str, alphas: Sequence[float], least: int = 2, purge_training: bool = False) -> list[tuple[int, float, int, int, float, list[float], float | None]]:
    """rows (with purged) -> (inner fold, alpha, training rows, validation rows, intercept, weights, mean squared error in validation).

    One pass gives the sums per campaign and mark; every fit and every error is made of them. Validation leaves out purged
    rows, and so does training with purge_training: their sums are taken off, rows aren't read again.
    """
    parts = model.gram(rows, columns, F.col(target), F.struct("campaign_id", "purged"))
    purged = {k["campaign_id"]: g for k, g in parts.items() if k["purged"]}
    whole = {c: model.summed([g for k, g in parts.items() if k["campaign_id"] == c]) for c in {k["campaign_id"] for k in parts}}
    clean = {c: less(g, purged[c]) if c in purged else g for c, g in whole.items()}
    out = []
    for fold, (train, val) in enumerate(inner_windows(sorted(whole), least), 1):
        own, held = model.summed([(clean if purge_training else whole)[c] for c in train]), model.summed([clean[c] for c in val])
        for a in alphas:
            b, w = model.ridge(own, a)
            out.append((fold, a, own.n, held.n, b, w.tolist(), mean_squared_error(held, b, w)))
    return out


# --- all folds at once ---


@dataclass
class Raw:
    """The raw columns of a table: numeric ones shifted and scaled, and all levels of the categorical ones."""

    numeric: list[str]
    shift: list[float]
    size: list[float]
    levels: dict[str, list[str]]

    def columns(self) -> list[Column]:
        x = [F.col(c).cast("double") for c in self.numeric]
        marks = [(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == v).cast("double") for c, vs in self.levels.items() for v in vs]
        return [*(F.coalesce((c - s) / z, F.lit(0.0)) for c, s, z in zip(x, self.shift, self.size, strict=True)), *(c.isNull().cast("double") for c in x), *marks]

    def design(self, g: model.Gram, median: dict[str, float], levels: dict[str, list[str]]) -> tuple[model.Design, np.ndarray]:
        """A fold's design, and the map from raw columns (with a leading 1) to its own."""
        p = len(self.numeric)
        every = [(c, v) for c, vs in self.levels.items() for v in vs]
        to = np.zeros((1 + p + sum(map(len, levels.values())), 1 + 2 * p + len(every)))
        to[0, 0] = 1.0
        d = model.Design(list(self.numeric), levels, dict(median))
        for j, c in enumerate(self.numeric):
            m = (median[c] - self.shift[j]) / self.size[j]
            mean = (g.xx[0, 1 + j] + m * g.xx[0, 1 + p + j]) / g.n
            square = (g.xx[1 + j, 1 + j] + m * m * g.xx[1 + p + j, 1 + p + j]) / g.n - mean * mean
            spread = square**0.5 if square > 1e-13 * (1 + mean * mean) else 0.0
            d.mean[c], d.scale[c] = mean * self.size[j] + self.shift[j], spread * self.size[j] or 1.0
            unit = spread or 1.0 / self.size[j]
            to[1 + j, [0, 1 + j, 1 + p + j]] = -mean / unit, 1 / unit, m / unit
        for i, x in enumerate([(c, v) for c, vs in levels.items() for v in vs]):
            to[1 + p + i, 1 + 2 * p + every.index(x)] = 1.0
        return d, to


def _levels(rows: DataFrame, categorical: Sequence[str]) -> dict[int, dict[str, set[str]]]:
    """campaign -> column -> its levels."""
    out: dict[int, dict[str, set[str]]] = {}
    for c in categorical:
        got = rows.select("campaign_id", F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("v")).distinct()
        if got.select("v").distinct().limit(model.MOST_LEVELS + 1).count() > model.MOST_LEVELS:
            raise ValueError(f"more than {model.MOST_LEVELS} levels: {c}")
        for r in got.collect():  # at most levels times campaigns
            out.setdefault(r["campaign_id"], {}).setdefault(c, set()).add(r["v"])
    return out


def _dot(z: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(z, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def fit_folds(rows: DataFrame, splits: Sequence[Sequence[int]], numeric: Sequence[str], categorical: Sequence[str], target: str = "reverse_profit_per_lot", alphas: Sequence[float] = model.ALPHAS) -> dict[int, dict]:
    """splits: the training campaigns of each fold -> fold (from 1) -> the artifact that `model.fit_all` makes of its training rows.

    Rows without a target take no part; with a column purged, rows so marked are left out of inner validation. All folds
    share four passes: quantiles, Gram sums, predictions of the inner folds, and scores. Nothing is read once per fold.
    """
    model.check_columns([*numeric, *categorical])
    spark = rows.sparkSession
    used = sorted({c for s in splits for c in s})
    rows = rows.filter(F.col(target).isNotNull() & F.col("campaign_id").isin(used)).select("campaign_id", F.col(target).cast("double").alias("y_"), *[F.col(c).cast("double").alias(c) for c in numeric], *categorical, (F.col("purged") if "purged" in rows.columns else F.lit(False)).alias("purged"))
    rows = written(rows, "fold_rows")
    roles = F.broadcast(spark.createDataFrame([(f, c) for f, cs in enumerate(splits, 1) for c in cs], "fold_ int, campaign_id int"))  # folds times campaigns
    middle: dict[int, dict[str, list[float]]] = {}
    for r in quantiles(rows.join(roles, "campaign_id"), [*numeric, "y_"], [*WINSOR, 0.5], ["fold_"]).collect():
        middle.setdefault(r["fold_"], {})[r["column_"]] = r["quantiles"]
    folds = [f for f in range(1, len(splits) + 1) if f in middle]
    if not folds:
        return {}
    first = rows.agg(*[x for i, c in enumerate(numeric) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    seen = _levels(rows, categorical)
    raw = Raw(list(numeric), [float(first[f"m{i}"] or 0.0) for i in range(len(numeric))], [float(first[f"s{i}"] or 0.0) or 1.0 for i in range(len(numeric))], {c: sorted(set().union(*(s.get(c, set()) for s in seen.values()))) for c in categorical})
    # one aggregation: xx per campaign, and xy and yy per campaign and fold, whose target is clipped at its own quantiles
    clipped = {f: F.greatest(F.lit(middle[f]["y_"][0]), F.least(F.lit(middle[f]["y_"][1]), F.col("y_"))) for f in folds}
    by_campaign = model.grams(rows, raw.columns(), clipped, "campaign_id")
    fits, made = [], {}
    for f in folds:
        train = sorted(c for c in splits[f - 1] if c in by_campaign)
        told = lambda cs, f=f: model.summed([by_campaign[c][f] for c in cs])
        levels = {c: sorted(set().union(*(seen[k].get(c, set()) for k in train))) for c in categorical}
        whole = told(train)
        design, to = raw.design(whole, {c: middle[f].get(c, [0.0, 0.0, 0.0])[2] for c in numeric}, levels)
        mapped = lambda g, to=to: model.Gram(to @ g.xx @ to.T, to @ g.xy, g.yy, g.n)
        inner = inner_windows(train)
        made[f] = (design, to, mapped(whole), bool(inner))
        for i, (cs, val) in enumerate(inner):
            g = mapped(told(cs))
            weights = [(to.T @ np.array([b, *w])).tolist() for b, w in (model.ridge(g, a) for a in alphas)]
            fits += [(f, i, c, *middle[f]["y_"][:2], weights) for c in val]
    chosen = _penalties(rows, raw, fits, alphas)
    finals, lines = {}, []
    for f, (design, to, g, has_inner) in made.items():
        alpha = chosen.get(f, 1.0) * FROZEN if has_inner else 1.0
        b, w = model.ridge(g, alpha)
        finals[f] = (design, b, w, alpha)
        lines += [(f, c, (to.T @ np.array([b, *w])).tolist()) for c in splits[f - 1]]
    return _finished(rows, raw, finals, lines)


def _vector(raw: Raw) -> Column:
    return F.array(F.lit(1.0), *raw.columns()).alias("z_")


def _penalties(rows: DataFrame, raw: Raw, fits: list[tuple], alphas: Sequence[float]) -> dict[int, float]:
    """fold -> the penalty with the best mean rank correlation over its inner folds, then least absolute error, then the smallest. One pass predicts all."""
    if not fits:
        return {}
    told = F.broadcast(rows.sparkSession.createDataFrame(fits, "fold_ int, inner_ int, campaign_id int, low_ double, high_ double, w_ array<array<double>>"))  # folds times campaigns
    names = [f"p{i}" for i in range(len(alphas))]
    pred = rows.filter("NOT purged").select("campaign_id", "y_", _vector(raw)).join(told, "campaign_id").select("fold_", "inner_", F.greatest("low_", F.least("high_", "y_")).alias("y_"), *[_dot(F.col("z_"), F.col("w_")[i]).alias(n) for i, n in enumerate(names)])
    pred = written(pred, "inner_predictions")
    rho = {(r["fold_"], r["inner_"], r["a"]): r["rho"] for r in spearman(pred, names, ["y_"], ["fold_", "inner_"]).collect()}
    mae = {(r["fold_"], r["inner_"]): r for r in pred.groupBy("fold_", "inner_").agg(*[F.avg(F.abs(F.col(p) - F.col("y_"))).alias(p) for p in names]).collect()}
    out = {}
    for f in sorted({f for f, _ in mae}):
        report = []
        for n, a in zip(names, alphas, strict=True):
            known = [(rho[f, i, n], r[n]) for (g, i), r in sorted(mae.items()) if g == f and rho.get((f, i, n)) is not None]
            if known:
                report.append((-round(float(np.mean([x for x, _ in known])), 12), float(np.mean([x for _, x in known])), a))
        if report:
            out[f] = min(report)[2]
    return out


def _finished(rows: DataFrame, raw: Raw, finals: dict[int, tuple], lines: list[tuple]) -> dict[int, dict]:
    """Thresholds and spreads of all folds in one pass: rows fall into the bins of the threshold grid, whose suffix sums are the sweep."""
    low, high, count = model.THRESHOLDS
    step = (high - low) / (count - 1)
    weights = F.broadcast(rows.sparkSession.createDataFrame(lines, "fold_ int, campaign_id int, w_ array<double>"))  # folds times campaigns
    scored = rows.select("campaign_id", "y_", _vector(raw)).join(weights, "campaign_id").select("fold_", "y_", _dot(F.col("z_"), F.col("w_")).alias("score"))
    at = model.thresholds_below(F.col("score"))
    bins: dict[int, tuple[np.ndarray, np.ndarray]] = {f: (np.zeros(count + 1), np.zeros(count + 1)) for f in finals}
    spread: dict[int, tuple[float, float, float]] = {}
    for r in scored.groupBy("fold_", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y_").alias("s"), F.avg("score").alias("m"), F.var_pop("score").alias("v")).collect():  # folds times bins
        n, s = bins[r["fold_"]]
        n[r["bin"]], s[r["bin"]] = r["n"], r["s"]
        k, m, v = spread.get(r["fold_"], (0.0, 0.0, 0.0))
        both = k + r["n"]
        spread[r["fold_"]] = (both, m + (r["m"] - m) * r["n"] / both, v + r["v"] * r["n"] + (r["m"] - m) ** 2 * k * r["n"] / both)
    out = {}
    for f, (design, b, w, alpha) in finals.items():
        n, s = (np.cumsum(x[:0:-1])[::-1] for x in bins[f])  # of scores above threshold i
        known = [(-round(s[i] / n[i], 12), -(low + i * step)) for i in range(count) if n[i] >= model.LEAST_SELECTED]
        k, _, v = spread[f]
        out[f] = model.artifact(design, b, w, alpha, -min(known)[1] if known else 0.0, (v / k) ** 0.5 or 1.0)
    return out
