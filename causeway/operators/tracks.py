"""Walk-forward fits of several models under several purges at once, for comparisons.

Models share their quantiles and Gram sums: those of a model are a part of those of all columns. Purges differ in inner
validation only, so they share the fits and the predictions as well. What is costly are the rank correlations of the
predictions of all models, folds and penalties. The outcome is ranked once; a prediction then travels once, with the
outcome's ranks beside it, to the task of its range of values, and sums over ranks are all that leave a task. No
prediction is written, ranked by a join, or dealt out once per purge.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import sure
from ..storage import written
from . import model, nested
from .folds import inner_windows
from .ranks import quantiles, running

#: Predictions that a task sums up at once, that a range of one model's holds, and that are shuffled by one job.
TASK_ROWS, RANGE_ROWS, JOB_ROWS = 1_500_000, 250_000, 250_000_000
#: Rows of a campaign that the ranges are laid by; they decide how evenly tasks are filled, not what comes out.
LAID_BY = 2_000
#: Of the sketch that quantiles are looked for around.
ACCURACY = 10_000
ABSENT = np.iinfo(np.int64).min


class Vector(NamedTuple):
    """A fit whose predictions are ranked: the weights (of the columns at) of a model, outer and inner fold and penalty, for rows of a campaign."""

    model: str
    fold: int
    inner: int
    alpha: float
    campaign: int
    at: list[int]
    weights: list[float]


class Fit(NamedTuple):
    design: model.Design
    intercept: float
    weights: np.ndarray
    alpha: float


def fit_models(rows: DataFrame, splits: Sequence[Sequence[int]], models: dict[str, tuple[Sequence[str], Sequence[str]]], target: str, purges: Sequence[str], alphas: Sequence[float] = model.ALPHAS) -> dict[tuple[str, str], dict[int, Fit]]:
    """(purge, model) -> fold (from 1) -> what `nested.fit_folds` fits on the fold's training rows, if rows are left out of inner validation where the purge, a column of rows, is true."""
    numeric, categorical = (list(dict.fromkeys(c for m in models.values() for c in m[i])) for i in (0, 1))
    model.check_columns([*numeric, *categorical])
    used = sorted({c for s in splits for c in s})
    own = rows.filter(F.col(target).isNotNull() & F.col("campaign_id").isin(used)).select("campaign_id", F.col(target).cast("double").alias("y_"), *[F.col(c).cast("double").alias(c) for c in numeric], *categorical, *[sure(F.col(p)).alias(f"gone{i}_") for i, p in enumerate(purges)])
    own = written(own, "fit_rows")
    middle = quantiles_of_folds(own, splits, {**dict.fromkeys(numeric, [0.5]), "y_": list(nested.WINSOR)})
    folds = [f for f in range(1, len(splits) + 1) if f in middle]
    if not folds:
        return {(p, m): {} for p in purges for m in models}
    first = own.agg(*[x for i, c in enumerate(numeric) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first() if numeric else None
    seen = nested._levels(own, categorical)
    shift, size = {c: float(first[f"m{i}"] or 0.0) for i, c in enumerate(numeric)}, {c: float(first[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(numeric)}
    raws = lambda numeric, categorical: nested.Raw(list(numeric), [shift[c] for c in numeric], [size[c] for c in numeric], {c: sorted(set().union(*(s.get(c, set()) for s in seen.values()))) for c in categorical})
    raw = raws(numeric, categorical)
    names = _names(raw)
    clipped = {f: F.greatest(F.lit(middle[f]["y_"][0]), F.least(F.lit(middle[f]["y_"][1]), F.col("y_"))) for f in folds}
    by_campaign = model.grams(own, raw.columns(), clipped, "campaign_id")
    vectors, made = [], {}
    for m, (num, cat) in models.items():
        part = raws(num, cat)
        at = [names.index(n) for n in _names(part)]
        for f in folds:
            train = sorted(c for c in splits[f - 1] if c in by_campaign)
            told = lambda cs, f=f, at=at: (lambda g: model.Gram(g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.n))(model.summed([by_campaign[c][f] for c in cs]))
            whole = told(train)
            design, to = part.design(whole, {c: middle[f].get(c, [0.0])[0] for c in num}, {c: sorted(set().union(*(seen[k].get(c, set()) for k in train))) for c in cat})
            mapped = lambda g, to=to: model.Gram(to @ g.xx @ to.T, to @ g.xy, g.yy, g.n)
            inner = inner_windows(train)
            made[m, f] = (design, mapped(whole), bool(inner))
            for i, (cs, val) in enumerate(inner):
                g = mapped(told(cs))
                for a in alphas:
                    b, w = model.ridge(g, a)
                    vectors += [Vector(m, f, i, a, c, at, (to.T @ np.array([b, *w])).tolist()) for c in val]
    chosen = _penalties(own, raw, vectors, {f: tuple(middle[f]["y_"]) for f in folds}, {c: next(iter(g.values())).n for c, g in by_campaign.items()}, len(purges))
    out: dict[tuple[str, str], dict[int, Fit]] = {(p, m): {} for p in purges for m in models}
    for i, p in enumerate(purges):
        for (m, f), (design, g, has_inner) in made.items():
            alpha = chosen.get((i, m, f), 1.0) * nested.FROZEN if has_inner else 1.0
            out[p, m][f] = Fit(design, *model.ridge(g, alpha), alpha)
    return out


def _names(raw: nested.Raw) -> list[tuple]:
    """Of the columns of raw and the leading 1, in order."""
    return [("one",), *(("value", c) for c in raw.numeric), *(("missing", c) for c in raw.numeric), *(("level", c, v) for c, vs in raw.levels.items() for v in vs)]


def quantiles_of_folds(own: DataFrame, splits: Sequence[Sequence[int]], shares: dict[str, list[float]]) -> dict[int, dict[str, list[float]]]:
    """fold -> column -> its exact quantiles over the fold's training campaigns, as `ranks.quantiles` has them; a column without values has none.

    A sketch says between which values a quantile lies. The values below are counted, those between are ranked: four in
    ACCURACY. Should a rank not lie there, all quantiles are made from all values.
    """
    spark = own.sparkSession
    roles = F.broadcast(spark.createDataFrame([(f, c) for f, cs in enumerate(splits, 1) for c in cs], "fold_ int, campaign_id int"))  # folds times campaigns
    rows, near = own.join(roles, "campaign_id"), 2.0 / ACCURACY
    asked = [(c, s) for c, ss in shares.items() for s in ss]
    sketch = rows.groupBy("fold_").agg(*[F.percentile_approx(c, [max(0.0, s - near), min(1.0, s + near)], ACCURACY).alias(f"q{i}") for i, (c, s) in enumerate(asked)], *[F.count(c).alias(f"n{i}") for i, (c, _) in enumerate(asked)]).collect()
    bounds = {(r["fold_"], i): (*map(float, r[f"q{i}"]), r[f"n{i}"]) for r in sketch for i in range(len(asked)) if r[f"n{i}"]}
    if not bounds:
        return {}
    lows = {f: [bounds.get((f, i), (None, None, 0))[:2] for i in range(len(asked))] for f in {f for f, _ in bounds}}
    held = rows.join(F.broadcast(spark.createDataFrame([(f, [x for x, _ in b], [y for _, y in b]) for f, b in lows.items()], "fold_ int, low_ array<double>, high_ array<double>")), "fold_")
    below = {r["fold_"]: r for r in held.groupBy("fold_").agg(*[F.count_if(sure(F.col(c) < F.col("low_")[i])).alias(f"b{i}") for i, (c, _) in enumerate(asked)]).collect()}
    between = F.array_compact(F.array(*[F.when((F.col(c) >= F.col("low_")[i]) & (F.col(c) <= F.col("high_")[i]), F.struct(F.lit(i).alias("i_"), F.col(c).alias("value_"))) for i, (c, _) in enumerate(asked)]))
    values = held.select("fold_", F.explode(between).alias("v_")).select("fold_", "v_.*").groupBy("fold_", "i_", "value_").agg(F.count(F.lit(1)).alias("n_"))
    places = [(f, i, asked[i][1] * (n - 1)) for (f, i), (_, _, n) in bounds.items()]
    ranks = F.broadcast(spark.createDataFrame([(f, i, float(below[f][f"b{i}"]), float(np.floor(p)), float(np.ceil(p))) for f, i, p in places], "fold_ int, i_ int, below_ double, floor_ double, ceil_ double"))
    upto = F.sum("n_").over(Window.partitionBy("fold_", "i_").orderBy("value_").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto_", upto).join(ranks, ["fold_", "i_"]).withColumn("upto_", F.col("upto_") + F.col("below_"))
    has = lambda c: F.max(F.when((F.col("upto_") - F.col("n_") <= F.col(c)) & (F.col(c) < F.col("upto_")), F.col("value_")))
    found = {(r["fold_"], r["i_"]): (r["low"], r["high"]) for r in placed.groupBy("fold_", "i_").agg(has("floor_").alias("low"), has("ceil_").alias("high")).collect()}
    out: dict[int, dict[str, list[float]]] = {}
    if any(None in found.get((f, i), (None,)) for f, i, _ in places):
        for c, ss in shares.items():
            for r in quantiles(rows, [c], ss, ["fold_"]).collect():
                out.setdefault(r["fold_"], {})[c] = r["quantiles"]
        return out
    for f, i, p in sorted(places):
        low, high = found[f, i]
        out.setdefault(f, {}).setdefault(asked[i][0], []).append(low if low == high else float((np.ceil(p) - p) * low + (p - np.floor(p)) * high))
    return out


# --- rank correlations of predictions ---


def _predicted(z: list[np.ndarray], v: Vector) -> np.ndarray:
    """Term after term, so that equal rows have equal predictions wherever they stand."""
    out = np.zeros(len(z[0]))
    for j, w in zip(v.at, v.weights, strict=True):
        out += z[j] * w
    return out


def _parts(batch: pa.RecordBatch, columns: int, purges: int, vectors: dict[int, dict[int, list[int]]], clips: dict[int, tuple[float, float]], ends: dict) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray], list[int]]]:
    """Of each campaign and fold in a batch: fold, raw columns, outcome, its doubled rank less the mean (ABSENT where purged) under each purge, vectors. Clipped outcomes tie."""
    of = batch.column("campaign_id").to_numpy()
    for c in np.unique(of).tolist():
        on = np.flatnonzero(of == c)
        get = lambda name, on=on: batch.column(name).to_numpy(zero_copy_only=False)[on]
        y, z, ranks = get("y_"), [np.ones(len(on)), *(get(f"z{j}") for j in range(1, columns))], [get(f"c{t}") for t in range(purges)]
        for f, ids in vectors.get(c, {}).items():
            low, high = clips[f]
            told = []
            for t, r in enumerate(ranks):
                under, over, every = ends[c, f, t]
                r2 = np.zeros(len(r), np.int64) if low >= high else np.where(y <= low, under - every, np.where(~(y < high), every - over, r))
                told.append(np.where(r == ABSENT, ABSENT, r2))
            yield f, z, np.clip(y, low, high), told, ids


def _compacted(parts: list[tuple]) -> tuple:
    """(values, then for each purge how often each occurs and the sum of ranks beside it), the values in order and once each."""
    v = np.concatenate([p[0] for p in parts])
    order = np.argsort(v, kind="stable")
    v = v[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
    return v[new], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], new) for i in range(1, len(parts[0])))


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles goes when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _outcome_ranks(own: DataFrame, purges: int) -> DataFrame:
    """own with c0, c1, ...: the outcome's doubled average rank in its campaign among rows that the purge leaves, less its mean; ABSENT where it takes the row."""
    counts = own.groupBy("campaign_id", "y_").agg(*[F.count_if(~F.col(f"gone{t}_")).alias(f"n{t}_") for t in range(purges)])
    for t in range(purges):
        counts = running(counts, ["campaign_id"], ["y_"], f"n{t}_", f"upto{t}_", f"all{t}_")
    ranks = counts.select("campaign_id", "y_", *[(2 * F.col(f"upto{t}_") - F.col(f"n{t}_") - F.col(f"all{t}_")).alias(f"r{t}_") for t in range(purges)])
    return own.join(ranks, ["campaign_id", "y_"]).select(*own.columns, *[F.when(F.col(f"gone{t}_"), F.lit(int(ABSENT))).otherwise(F.col(f"r{t}_")).alias(f"c{t}") for t in range(purges)])


def _penalties(own: DataFrame, raw: nested.Raw, vectors: list[Vector], clips: dict[int, tuple[float, float]], sizes: dict[int, int], purges: int) -> dict[tuple[int, str, int], float]:
    """(purge, model, fold) -> the penalty with the best mean rank correlation over its inner folds, then least absolute error, then the smallest."""
    if not vectors:
        return {}
    validated = sorted({v.campaign for v in vectors})
    own = own.filter(F.col("campaign_id").isin(validated))
    counted = own.groupBy("campaign_id").agg(*[x for t in range(purges) for x in (F.count_if(~F.col(f"gone{t}_")).alias(f"all{t}"), *[c for f, (low, high) in clips.items() for c in (F.count_if(~F.col(f"gone{t}_") & (F.col("y_") <= low)).alias(f"u{t}_{f}"), F.count_if(~F.col(f"gone{t}_") & ~(F.col("y_") < high)).alias(f"o{t}_{f}"))])])
    ends = {(r["campaign_id"], f, t): (r[f"u{t}_{f}"], r[f"o{t}_{f}"], r[f"all{t}"]) for r in counted.collect() for f in clips for t in range(purges)}
    columns = 1 + len(raw.columns())
    z = [c.alias(f"z{j}") for j, c in enumerate(raw.columns(), 1)]
    ranked = written(_outcome_ranks(own, purges), "outcome_ranks").select("campaign_id", "y_", *z, *[f"c{t}" for t in range(purges)])
    laid: dict[int, list[np.ndarray]] = {}
    some = ranked.sample(min(1.0, LAID_BY * len(validated) / max(1, sum(sizes[c] for c in validated))), 1).select("campaign_id", *[f"z{j}" for j in range(1, columns)]).toPandas()
    for c, part in some.groupby("campaign_id"):
        laid[int(c)] = [np.ones(len(part)), *(part[f"z{j}"].to_numpy() for j in range(1, columns))]
    sums: dict[int, list] = {}
    jobs: list[list[int]] = [[]]
    for i, v in enumerate(vectors):
        if jobs[-1] and sum(sizes[vectors[j].campaign] for j in jobs[-1]) + sizes[v.campaign] > JOB_ROWS:
            jobs.append([])
        jobs[-1].append(i)
    with _shuffles_end(own.sparkSession):
        for ids in jobs:
            sums |= _summed(ranked, columns, purges, vectors, ids, clips, ends, sizes, laid)
    rho = {(i, t): _correlation(parts, t) for i, parts in sums.items() for t in range(purges)}
    groups: dict[tuple[int, str, int], dict[float, list[int]]] = {}
    for i, v in enumerate(vectors):
        for t in range(purges):
            if rho.get((i, t)) is not None:
                groups.setdefault((t, v.model, v.fold), {}).setdefault(v.alpha, []).append(i)
    best = {}
    for key, by_alpha in groups.items():
        means = {a: round(float(np.mean([rho[i, key[0]] for i in ids])), 12) for a, ids in by_alpha.items()}
        best[key] = {a: by_alpha[a] for a, m in means.items() if m == max(means.values())}
    tied = sorted({i for b in best.values() if len(b) > 1 for ids in b.values() for i in ids})
    mae = _errors(ranked, columns, purges, vectors, tied, clips, ends) if tied else {}
    return {key: min(b, key=lambda a: (float(np.mean([mae[i, key[0]] for i in b[a]])), a)) if len(b) > 1 else next(iter(b)) for key, b in best.items()}


def _by_campaign(vectors: list[Vector], ids: Sequence[int]) -> dict[int, dict[int, list[int]]]:
    out: dict[int, dict[int, list[int]]] = {}
    for i in ids:
        out.setdefault(vectors[i].campaign, {}).setdefault(vectors[i].fold, []).append(i)
    return out


def _summed(ranked: DataFrame, columns: int, purges: int, vectors: list[Vector], ids: list[int], clips: dict, ends: dict, sizes: dict[int, int], laid: dict[int, list[np.ndarray]]) -> dict[int, list]:
    """vector -> the sums of its ranges, in order: for each purge (rows, sum of outcome ranks, sum of place times outcome rank, sum of places, sum of squared places, sum of squared outcome ranks). A place is the doubled average rank in the range."""
    wanted = _by_campaign(vectors, ids)
    bounds, first, at = {}, {}, 0
    for i in ids:
        c = vectors[i].campaign
        n = -(-sizes[c] // RANGE_ROWS)
        bounds[i] = np.unique(np.quantile(_predicted(laid[c], vectors[i]), np.arange(1, n) / n)) if n > 1 and c in laid else np.zeros(0)
        first[i] = at
        at += len(bounds[i]) + 1
    wide = np.dtype(np.int32 if 2 * max(sizes.values()) < 2**31 else np.int64)  # of a rank
    absent = np.iinfo(wide).min

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, z, _, told, own in _parts(batch, columns, purges, wanted, clips, ends):
                there = np.flatnonzero(np.any([r != ABSENT for r in told], axis=0))
                if len(there):
                    z, told = [x[there] for x in z], [np.where(r == ABSENT, absent, r)[there].astype(wide) for r in told]
                    parts, blocks = [], []
                    for i in own:
                        p = _predicted(z, vectors[i])
                        of = np.searchsorted(bounds[i], p, side="right")
                        order = np.argsort(of, kind="stable") if len(bounds[i]) else np.arange(len(p))
                        ends_ = np.cumsum(np.bincount(of, minlength=len(bounds[i]) + 1))
                        for r, on in enumerate(np.split(order, ends_[:-1])):
                            if len(on):
                                parts.append(first[i] + r)
                                blocks.append(b"".join((p[on].tobytes(), *(x[on].tobytes() for x in told))))
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        fresh: dict[int, list[list[np.ndarray]]] = {}
        waiting: dict[int, int] = {}
        squares: dict[int, np.ndarray] = {}

        def settled(k: int) -> None:
            v, *told = (np.concatenate(x) for x in zip(*fresh.pop(k), strict=True))
            there = [r != absent for r in told]
            own = [np.where(h, r, 0).astype(np.int64) for h, r in zip(there, told, strict=True)]
            squares[k] = squares.get(k, 0.0) + np.array([np.sum(np.square(r.astype(np.float64))) for r in own])
            held[k], waiting[k] = [_compacted([*held.get(k, []), (v, *(h.astype(np.int64) for h in there), *own)])], 0

        for batch in batches:
            for k, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                data = block.as_buffer()
                n = data.size // (8 + purges * wide.itemsize)
                # copies, as the batch goes
                fresh.setdefault(k, []).append([np.frombuffer(data, np.float64, n).copy(), *(np.frombuffer(data, wide, n, 8 * n + t * n * wide.itemsize).copy() for t in range(purges))])
                waiting[k] = waiting.get(k, 0) + n
                if waiting[k] > TASK_ROWS:
                    settled(k)
        for k in list(fresh):
            settled(k)
        for k, parts in held.items():
            own, out = _compacted(parts), []
            for t in range(purges):
                n, s = own[1 + t].astype(np.float64), own[1 + purges + t].astype(np.float64)
                place = 2 * np.cumsum(n) - n
                out += [n.sum(), s.sum(), (place * s).sum(), (n * place).sum(), (n * place * place).sum(), squares[k][t]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out], pa.list_(pa.float64()))], ["part", "sums"])

    spark = ranked.sparkSession
    of = {first[i] + r: (i, r) for i in ids for r in range(len(bounds[i]) + 1)}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes[vectors[i].campaign] for i in ids) // TASK_ROWS)
    dealt = ranked.filter(F.col("campaign_id").isin(list(wanted))).mapInArrow(predict, "part int, block binary").repartition(tasks, "part")
    out: dict[int, dict[int, list]] = {}
    for row in dealt.mapInArrow(add, "part int, sums array<double>").collect():  # a row per vector and range
        i, r = of[row["part"]]
        out.setdefault(i, {})[r] = row["sums"]
    return {i: [parts[r] for r in sorted(parts)] for i, parts in out.items()}


def _correlation(parts: list, t: int) -> float | None:
    """From the sums of ranges in order: the rank correlation under a purge, missing where nothing varies."""
    own = [p[6 * t : 6 * t + 6] for p in parts]
    every, before, xy, xx, yy = sum(p[0] for p in own), 0.0, 0.0, 0.0, 0.0
    for n, s, ps, p1, p2, q in own:
        off = 2 * before - every
        xy += off * s + ps
        xx += off * off * n + 2 * off * p1 + p2
        yy += q
        before += n
    return float(xy / (xx * yy) ** 0.5) if xx > 0 and yy > 0 else None


def _errors(ranked: DataFrame, columns: int, purges: int, vectors: list[Vector], ids: list[int], clips: dict, ends: dict) -> dict[tuple[int, int], float]:
    """(vector, purge) -> the mean absolute error: for penalties whose rank correlations tie."""
    wanted = _by_campaign(vectors, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[float, int]] = {}
        for batch in batches:
            for _, z, y, told, own in _parts(batch, columns, purges, wanted, clips, ends):
                for i in own:
                    off = np.abs(_predicted(z, vectors[i]) - y)
                    for t, r in enumerate(told):
                        s, n = sums.get((i, t), (0.0, 0))
                        sums[i, t] = (s + float(off[r != ABSENT].sum()), n + int((r != ABSENT).sum()))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array([s for s, _ in sums.values()]), pa.array([n for _, n in sums.values()])], ["i", "t", "s", "n"])

    told = ranked.filter(F.col("campaign_id").isin(list(wanted))).mapInArrow(run, "i long, t long, s double, n long").groupBy("i", "t").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return {(r["i"], r["t"]): r["s"] / r["n"] for r in told.collect() if r["n"]}
