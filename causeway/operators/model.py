"""Ridge regression from Gram sums, choice of penalty and threshold, a frozen artifact, scoring, decisions and their policies."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import sure
from ..storage import written
from .features import CLOSE_FIELDS, STOP_FIELDS
from .ranks import at_ranks, quantiles

ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 13))
THRESHOLDS = (-100.0, 500.0, 601)
LEAST_SELECTED = 30
#: Levels of a categorical column at most: each is a column of the design.
MOST_LEVELS = 1_000
BANNED = CLOSE_FIELDS | STOP_FIELDS | frozenset("gross_loss_per_lot reverse_profit_per_lot clears_hurdle".split())


@dataclass
class Design:
    """Columns after preprocessing: numeric ones (median for missing, then standardised by the population deviation) and one per level of each categorical one, in a fixed order."""

    numeric: list[str]
    levels: dict[str, list[str]]
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}={v}" for c, vs in self.levels.items() for v in vs]

    def columns(self) -> list[Column]:
        num = [(F.coalesce(F.col(c).cast("double"), F.lit(self.median[c])) - self.mean[c]) / self.scale[c] for c in self.numeric]
        return num + [(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == v).cast("double") for c, vs in self.levels.items() for v in vs]


def check_columns(names: Sequence[str]) -> None:
    if bad := BANNED & set(names):
        raise ValueError(f"known only at the close: {sorted(bad)}")


def fit_design(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Design:
    """Exact medians, then means and deviations of the filled columns, each in one aggregation; a column without values or spread is 0 throughout."""
    check_columns([*numeric, *categorical])
    levels = {c: sorted(r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).distinct().limit(MOST_LEVELS + 1).collect()) for c in categorical}
    if many := [c for c, v in levels.items() if len(v) > MOST_LEVELS]:
        raise ValueError(f"more than {MOST_LEVELS} levels: {many}")
    d = Design(list(numeric), levels)
    med = {r["column_"]: r["quantiles"][0] for r in quantiles(train, list(numeric), [0.5]).collect()} if numeric else {}
    d.median = {c: float(med.get(c, 0.0)) for c in numeric}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(d.median[c])) for c in numeric}
    got = train.agg(*[x for c in numeric for x in (F.avg(filled[c]).alias(f"m_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}"))]).first()
    d.mean = {c: float(got[f"m_{c}"] or 0.0) for c in numeric}
    d.scale = {c: float(got[f"s_{c}"] or 0.0) or 1.0 for c in numeric}
    return d


def unseen_levels(df: DataFrame, design: Design, every: bool = False) -> None:
    """Refuses categorical values that the design doesn't know, and with every, a batch that lacks one it knows."""
    for c, known in design.levels.items():
        got = {r[0] for r in df.select(F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).distinct().limit(len(known) + 1).collect()}
        if got - set(known) or every and set(known) - got:
            raise ValueError(f"{c}: unknown levels {sorted(got - set(known))}, missing levels {sorted(set(known) - got) if every else []}")


@dataclass
class Gram:
    """Sums over rows of (1, x, y): all that a ridge fit reads of the data."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int


def grams(train: DataFrame, x: Sequence[Column], targets: dict[object, Column], by: str | Column | None = None) -> dict[object, dict[object, Gram]]:
    """Gram sums per value of `by` (or under None) and target, in a single aggregation with map-side combining; targets share the sums of x. Rows without one of the targets are left out."""
    k, keys = len(x) + 1, list(targets)
    cols = [F.lit(1.0), *x]
    group = F.lit(0) if by is None else F.col(by) if isinstance(by, str) else by
    named = train.select(group.alias("by_"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *[targets[t].cast("double").alias(f"y{j}") for j, t in enumerate(keys)]).filter(" AND ".join(f"y{j} IS NOT NULL" for j in range(len(keys))))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [s for j in range(len(keys)) for s in (F.sum(F.col(f"y{j}") * F.col(f"y{j}")).alias(f"yy{j}"), *[F.sum(F.col(f"x{i}") * F.col(f"y{j}")).alias(f"h{i}_{j}") for i in range(k)])]
    out: dict[object, dict[object, Gram]] = {}
    for r in named.groupBy("by_").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        xx = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                xx[i, j] = xx[j, i] = r[f"g{i}_{j}"]
        out[r["by_"] if by is not None else None] = {t: Gram(xx, np.array([r[f"h{i}_{j}"] for i in range(k)]), r[f"yy{j}"], r["n"]) for j, t in enumerate(keys)}
    return out


def gram(train: DataFrame, x: Sequence[Column], y: Column, by: str | Column | None = None) -> dict[object, Gram]:
    """The same for one target: per value of `by` (or one under None)."""
    return {k: g[0] for k, g in grams(train, x, {0: y}, by).items()}


def summed(grams: Sequence[Gram]) -> Gram:
    return Gram(sum(g.xx for g in grams), sum(g.xy for g in grams), sum(g.yy for g in grams), sum(g.n for g in grams))


def ridge(g: Gram, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the squared error plus alpha times the squared weights; the intercept is free."""
    penalty = np.diag([0.0, *[alpha] * (len(g.xy) - 1)])
    w = np.linalg.lstsq(g.xx + penalty, g.xy, rcond=None)[0]
    return float(w[0]), w[1:]


def scored(df: DataFrame, design: Design, intercept: float, weights: Sequence[float], name: str = "score") -> DataFrame:
    total = F.lit(float(intercept))
    for c, w in zip(design.columns(), weights, strict=True):
        total = total + c * float(w)
    return df.withColumn(name, total)


def choose_alpha(rows: DataFrame, design: Design, target: str, inner: Sequence[tuple[Sequence[int], Sequence[int]]], alphas: Sequence[float] = ALPHAS) -> tuple[float, list[tuple[float, float, float]]]:
    """The penalty with the best mean rank correlation over inner folds, then least absolute error, then the smallest: (alpha, [(alpha, rho, mae)]).

    Rows are scanned once for the Gram sums of every campaign; each fold's fits are sums of those. All folds and
    penalties are predicted and ranked in one pass: the weights of a row's fold come by a join on (fold, campaign).
    """
    from .stats import spearman

    columns = design.columns()
    by_campaign = gram(rows, columns, F.col(target), "campaign_id")
    fits = []
    for fold, (train, val) in enumerate(inner):
        known = [by_campaign[c] for c in train if c in by_campaign]
        if known:
            weights = [[b, *w.tolist()] for b, w in (ridge(summed(known), a) for a in alphas)]
            fits += [(fold, c, weights) for c in val]
    table: dict[float, tuple[list, list]] = {a: ([], []) for a in alphas}
    if fits:
        spark = rows.sparkSession
        told = F.broadcast(spark.createDataFrame(fits, "fold_ int, campaign_id int, w_ array<array<double>>"))  # folds times campaigns
        x = F.array(F.lit(1.0), *[c.cast("double") for c in columns])
        pred = rows.filter(F.col(target).isNotNull()).select("campaign_id", F.col(target).alias("y_"), x.alias("x_")).join(told, "campaign_id")
        names = [f"p{i}" for i in range(len(alphas))]
        product = lambda i: F.aggregate(F.zip_with("x_", F.col("w_")[i], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        pred = written(pred.select("fold_", "y_", *[product(i).alias(n) for i, n in enumerate(names)]), "predictions")
        rho = {(r["fold_"], r["a"]): r["rho"] for r in spearman(pred, names, ["y_"], ["fold_"]).collect()}
        mae = {r["fold_"]: r for r in pred.groupBy("fold_").agg(*[F.avg(F.abs(F.col(p) - F.col("y_"))).alias(p) for p in names]).collect()}
        for fold in sorted(mae):
            for i, a in enumerate(alphas):
                if rho.get((fold, f"p{i}")) is not None:
                    table[a][0].append(rho[fold, f"p{i}"])
                    table[a][1].append(mae[fold][f"p{i}"])
    report = [(a, float(np.mean(r)) if r else float("nan"), float(np.mean(m)) if m else float("nan")) for a, (r, m) in table.items()]
    known = [x for x in report if not np.isnan(x[1])]
    return (min(known, key=lambda x: (-round(x[1], 12), x[2], x[0]))[0] if known else 1.0), report


def thresholds_below(score: Column, grid: tuple[float, float, int] = THRESHOLDS) -> Column:
    """How many thresholds of an even grid lie strictly below the score. The place told by division may be one off, as the difference from the first threshold is rounded: the score itself is held against the thresholds beside it. NaN is above all."""
    low, high, count = grid
    step = (high - low) / (count - 1)
    near = F.least(F.lit(count), F.greatest(F.lit(0), F.ceil((score - low) / step))).cast("int")
    threshold = lambda i: F.lit(low) + i * F.lit(step)
    near = near + (sure(score > threshold(near)) & (near < count)).cast("int")
    near = near - ((near > 0) & ~sure(score > threshold(near - 1))).cast("int")
    return F.when(F.isnan(score), F.lit(count)).otherwise(near)


def threshold_sweep(df: DataFrame, score: str, actual: str, grid: tuple[float, float, int] = THRESHOLDS) -> DataFrame:
    """threshold, n, coverage, mean_actual of rows above each threshold of an even grid. Rows fall into the bin of the last threshold below them; suffix sums over bins give the sweep, so no row meets every threshold."""
    from pyspark.sql import Window

    low, high, count = grid
    step = (high - low) / (count - 1)
    at = thresholds_below(F.col(score).cast("double"), grid)
    bins = df.filter(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.count(actual).alias("k"), F.sum(actual).alias("s"))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + (F.col("id") - 1) * step).alias("threshold"))
    after = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over the bins of the grid only
    out = every.join(bins, "bin", "left").withColumns({"n": F.coalesce(F.sum("c").over(after), F.lit(0)), "k": F.sum("k").over(after), "t": F.sum("s").over(after)}).crossJoin(F.broadcast(total))
    return out.select("threshold", "n", (F.col("n") / F.col("rows")).alias("coverage"), F.try_divide(F.col("t"), F.col("k")).alias("mean_actual"))


def choose_threshold(sweep: DataFrame, least: int = LEAST_SELECTED) -> tuple[float, int, float] | None:
    """The threshold with the best mean among those that select enough rows, the higher in a tie: (threshold, n, mean)."""
    r = sweep.filter((F.col("n") >= least) & F.col("mean_actual").isNotNull()).orderBy(F.desc(F.round("mean_actual", 12)), F.desc("threshold")).first()
    return (r["threshold"], r["n"], r["mean_actual"]) if r else None


def compacted(sweep: DataFrame) -> DataFrame:
    """Only thresholds at which the selection changes."""
    from pyspark.sql import Window

    return sweep.withColumn("p_", F.lag("n").over(Window.orderBy("threshold"))).filter("p_ IS NULL OR p_ <> n").drop("p_")


# --- artifact ---


def artifact(design: Design, intercept: float, weights: Sequence[float], alpha: float, threshold: float, scale: float) -> dict:
    return {"version": 1, "numeric": design.numeric, "levels": design.levels, "median": design.median, "mean": design.mean, "scale": design.scale, "columns": design.names,
            "intercept": intercept, "weights": [float(w) for w in weights], "alpha": alpha, "threshold": threshold, "score_scale": scale}


def _rounded(x):
    if isinstance(x, float):
        return float(f"{x:.12g}")
    if isinstance(x, dict):
        return {k: _rounded(v) for k, v in x.items()}
    return [_rounded(v) for v in x] if isinstance(x, list | tuple) else x


def save(a: dict, path: str) -> str:
    """Canonical JSON (12 significant digits, sorted keys) and the ordered column names beside it; the digest of the file."""
    p = Path(path)
    p.write_text(json.dumps(_rounded(a), sort_keys=True, indent=2) + "\n")
    p.with_name(f"{p.stem}_columns.json").write_text(json.dumps(a["columns"], indent=2) + "\n")
    return hashlib.sha256(p.read_bytes()).hexdigest()


def load(path: str) -> dict:
    """Refuses another version and columns that differ, in any position, from those that the design makes or the file beside it lists."""
    p = Path(path)
    a = json.loads(p.read_text())
    if a.get("version") != 1:
        raise ValueError(f"version {a.get('version')}")
    beside = p.with_name(f"{p.stem}_columns.json")
    listed = json.loads(beside.read_text()) if beside.exists() else a["columns"]
    if not listed == a["columns"] == design_of(a).names or len(set(listed)) != len(listed) or len(a["weights"]) != len(listed):
        raise ValueError("the columns aren't those of the design, in its order")
    return a


def design_of(a: dict) -> Design:
    return Design(a["numeric"], a["levels"], a["median"], a["mean"], a["scale"])


# --- decisions ---


def decide(df: DataFrame, a: dict) -> DataFrame:
    """df with score, decision (FADE or ABSTAIN), confidence, expected_absolute and triggering_features (the three largest contributions, ties by name). A missing score abstains."""
    d = design_of(a)
    parts = F.array(*[F.struct((c * float(w)).alias("v"), F.lit(n).alias("n")) for c, w, n in zip(d.columns(), a["weights"], d.names, strict=True)])
    out = scored(df, d, a["intercept"], a["weights"])
    fade = (F.col("score") > max(a["threshold"], 0.0)) & ~F.coalesce((F.col("win_streak") > 1) | (F.col("trades_per_hour") > 60), F.lit(False))
    top = F.slice(F.array_sort(F.transform(parts, lambda p: F.struct((-F.abs(p["v"])).alias("a"), p["n"].alias("n"), p["v"].alias("v")))), 1, 3)
    return out.withColumns({
        "decision": F.when(F.coalesce(fade, F.lit(False)), "FADE").otherwise("ABSTAIN"), "confidence": F.when(F.coalesce(fade, F.lit(False)), 1 / (1 + F.exp(-F.col("score") / a["score_scale"]))).otherwise(0.0),
        "expected_absolute": F.col("score") * F.col("amount"), "triggering_features": F.concat_ws(";", F.transform(top, lambda p: F.concat(p["n"], F.lit("="), F.format_string("%.6f", p["v"])))),
    })


def policy(df: DataFrame, selected: Column, label: str, actual: str = "reverse_profit_per_lot", amount: str = "amount") -> DataFrame:
    """One row: n, coverage, equal- and size-weighted mean, total of the selected rows."""
    on = F.coalesce(selected, F.lit(False))
    v, a = F.when(on, F.col(actual)), F.when(on, F.col(amount))
    return df.agg(F.count_if(on).alias("n"), (F.count_if(on) / F.count(F.lit(1))).alias("coverage"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.try_divide(F.sum(v * a), F.sum(a)), F.lit(0.0)).alias("size_weighted_mean"), F.coalesce(F.sum(v * a), F.lit(0.0)).alias("total")).select(F.lit(label).alias("policy"), "*")


def frontier(df: DataFrame, score: str, shares: Sequence[float], actual: str = "reverse_profit_per_lot", cluster: Column | None = None) -> DataFrame:
    """For each target share the cutoff midway between the last score taken and the next one: share, cutoff, n, mean.

    With cluster also deff, the design effect of the rows taken, mde, the least effect that so many of them show, and
    mde_floored, the same with a design effect of one at least. All shares' clusters are summed in one pass.
    """
    from .stats import icc, least_effect

    known = df.filter(F.col(score).isNotNull())
    n = known.count()
    ks = [max(1, round(s * n)) for s in shares]
    schema = "share double, cutoff double, n long, mean double" + (", deff double, mde double, mde_floored double" if cluster is not None else "")
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    least = at_ranks(known, score, [n - min(k, n) for k in ks] + [n - min(k + 1, n) for k in ks])
    sd = known.agg(F.stddev_samp(actual)).first()[0] or 0.0
    cut = [a - 1e-12 if k >= n else (a + b) / 2 for k, a, b in zip(ks, least, least[len(ks) :], strict=False)]
    one = known.agg(*[x for i, c in enumerate(cut) for x in (F.count_if(F.col(score) > c).alias(f"n{i}"), F.avg(F.when(F.col(score) > c, F.col(actual))).alias(f"m{i}"))]).first()
    out, deffs = [], {}
    if cluster is not None:
        taken = known.withColumn("share_", F.explode(F.array_compact(F.array(*[F.when(F.col(score) > c, F.lit(i)) for i, c in enumerate(cut)]))))
        deffs = {r["share_"]: r["deff"] for r in icc(taken, actual, cluster, ["share_"]).collect()}  # a row per share
    for i, s in enumerate(shares):
        row = [float(s), float(cut[i]), one[f"n{i}"], one[f"m{i}"]]
        if cluster is not None:
            deff = deffs.get(i) if row[2] else None
            row += [deff, *[least_effect(sd, row[2], d) if d is not None else None for d in (deff and max(deff, 0.0), deff and max(deff, 1.0))]]
        out.append(tuple(row))
    return df.sparkSession.createDataFrame(out, schema)


def fit_all(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "reverse_profit_per_lot", settings: Settings = DEFAULT) -> dict:
    """Design, penalty (the chosen one times the square root of ten), weights and threshold from training rows: an artifact."""
    from .folds import inner_windows
    from .stats import winsorised

    design = fit_design(rows, numeric, categorical)
    clipped = winsorised(rows, target)
    campaigns = sorted(r[0] for r in rows.select("campaign_id").distinct().collect())
    inner = inner_windows(campaigns)
    alpha = choose_alpha(clipped, design, f"{target}_w", inner)[0] * 10**0.5 if inner else 1.0
    g = gram(clipped, design.columns(), F.col(f"{target}_w"))[None]
    intercept, weights = ridge(g, alpha)
    preds = scored(rows, design, intercept, weights)
    chosen = choose_threshold(threshold_sweep(preds, "score", target))
    spread = preds.agg(F.stddev_pop("score")).first()[0] or 1.0
    return artifact(design, intercept, weights, alpha, chosen[0] if chosen else 0.0, spread)
