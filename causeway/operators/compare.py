"""Comparisons: models over folds, selections against each other, groups taken out, random draws of accounts, levels that repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import sure
from ..storage import written
from . import bootstrap, folds, model, nested, stats, tracks


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """df, checked when it runs: a join to it can't fan out."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys).limit(3).collect()
    if n:
        raise ValueError(f"{what} repeat {tuple(keys)}: {[tuple(r) for r in n]}")
    return df


def canonical(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Every name coalesced over the aliases that are there (the name itself first); the aliases go, and a name without any source becomes null text."""
    out = df
    for name, others in aliases.items():
        have = [c for c in (name, *others) if c in df.columns]
        out = out.withColumn(name, F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("string"))
    return out.drop(*[o for os in aliases.values() for o in os if o in df.columns and o not in aliases])


def mandated_split(df: DataFrame, last_train: int = 52, settings: Settings = DEFAULT, expected: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, evaluation, economic evaluation): campaigns up to last_train; later ones; those without excluded campaigns. expected: rows of the first two, which are counted and must agree."""
    later = df.filter(F.col("campaign_id") > last_train)
    if expected is not None:
        got = tuple(df.agg(F.count_if(F.col("campaign_id") <= last_train), F.count_if(F.col("campaign_id") > last_train)).first())
        if got != tuple(expected):
            raise ValueError(f"{got} rows of training and evaluation, not {tuple(expected)}")
    return df.filter(F.col("campaign_id") <= last_train), later, later.filter(~F.col("campaign_id").isin(*settings.excluded_campaigns))


def best_group_removed(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the group with the largest sum, the totals with and without it."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.agg(F.max_by(group, F.struct("s", group)).alias("best"), F.sum("s").alias("total"), (F.sum("s") - F.max("s")).alias("total_without"), F.try_divide(F.sum("s") - F.max("s"), F.sum("n") - F.max_by("n", F.struct("s", group))).alias("mean_without"))


def selection_overlap(df: DataFrame, a: Column, b: Column, value: str) -> DataFrame:
    """both, only the first, only the second, neither: n and mean value."""
    x, y = sure(a), sure(b)
    kind = F.when(x & y, "both").when(x, "first only").when(y, "second only").otherwise("neither")
    return df.groupBy(kind.alias("selected")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def duplicate_groups(df: DataFrame, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Groups of rows that share keys: how many groups and rows, and in how many groups each cell differs."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.count_distinct(F.struct(F.col(c).isNull(), c)) > 1).alias(c) for c in cells]).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[F.count_if(F.col(c)).alias(f"{c}_differs") for c in cells])


def cliff(df: DataFrame, value: str, width: float = 25.0) -> DataFrame:
    """Where values pile up: bins of equal width with their counts and the ratio to the next bin, so that a limit that accounts run into shows as a cliff."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    after = bins.select((F.col("bin") - 1).alias("bin"), F.col("n").alias("next"))
    return bins.join(after, "bin", "left").select((F.col("bin") * width).alias("from_value"), "n", (F.col("n") / F.greatest(F.coalesce("next", F.lit(0)), F.lit(1))).alias("drop"))


def mean_contributions(df: DataFrame, artifact: dict, by: str) -> DataFrame:
    """(by, column, mean_abs): which columns carry the score in each group."""
    d = model.design_of(artifact)
    parts = F.array(*[F.struct(F.lit(n).alias("column"), F.abs(c * float(w)).alias("v")) for c, w, n in zip(d.columns(), artifact["weights"], d.names, strict=True)])
    return df.select(by, F.explode(parts).alias("p")).groupBy(by, F.col("p.column").alias("column")).agg(F.avg("p.v").alias("mean_abs"))


#: Rows of accounts or of opens that a task holds against all draws.
DEALT_ROWS = 100_000
#: Standard deviations on either side of a cut's expected place in which it is looked for first.
BAND = 6.0


def random_in_step(df: DataFrame, group: str, draws: int = 100, clusters: int = 10, minutes: int = 5, seed: int = 7) -> DataFrame:
    """For the largest groups: their share of opens in step, beside the mean share of as many random accounts of the same campaigns.

    Only the `clusters` largest groups are compared, so the list that is broadcast is small by definition; each draw
    takes the accounts of a campaign that a hash ranks first. Accounts aren't dealt out per draw: the hash of the last one
    taken is looked up for every group, campaign and draw, and an account is drawn if its own hash isn't above it. What is
    broadcast are these cuts (draws times clusters times campaigns), and what is shuffled are opens per account and window
    once, and two counts and two accounts per window and draw.
    """
    spark = df.sparkSession
    # a row without a time makes its account count, but is no open
    at = F.coalesce(F.col("open_time"), F.lit("1970-01-01").cast(df.schema["open_time"].dataType))
    w = F.window(at, f"{minutes} minutes").getField("start")
    opens = written(df.groupBy("campaign_id", "account_id", group, w.alias("w")).agg(F.count("open_time").alias("n")), "opens")
    accounts = written(opens.select("campaign_id", "account_id", group).distinct(), "accounts")
    largest = accounts.filter(F.col(group).isNotNull() & (F.col(group) != -1)).groupBy(group).agg(F.count_distinct("account_id").alias("a")).orderBy(F.desc("a"), group).limit(clusters)
    largest = written(largest.select(group), "largest")
    sizes = accounts.join(F.broadcast(largest), group).groupBy(group, "campaign_id").agg(F.count_distinct("account_id").alias("size"))
    tasks = lambda rows: max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // DEALT_ROWS)
    pool = accounts.select("campaign_id", "account_id").repartition(tasks(accounts), "campaign_id", "account_id").distinct()
    drawn = F.broadcast(_cuts(pool, sizes, group, draws, seed))
    known = opens.filter("n > 0 AND account_id IS NOT NULL").select("campaign_id", "w", "account_id", "n")
    # by ranges, so that a window of any size spans tasks; an account's rows of a window are few and only its first and last name count
    each = known.repartitionByRange(tasks(opens), "campaign_id", "w", "account_id").join(drawn, "campaign_id").select("campaign_id", "w", "account_id", "n", group, F.posexplode("cuts").alias("i", "cut"))
    h = _hash(F.col("i") + 1, group, seed)
    each = each.filter((h < F.col("cut.h")) | ((h == F.col("cut.h")) & sure(F.col("account_id") <= F.col("cut.a"))))
    per = each.groupBy("campaign_id", "w", group, "i").agg(F.sum("n").alias("n"), F.min("account_id").alias("x"), F.max("account_id").alias("y"))
    share = lambda both: F.sum(F.when(both, F.col("n")).otherwise(0)) / F.sum("n")
    random = per.groupBy(group).agg(share(F.col("x") != F.col("y")).alias("random_share"))
    own = opens.filter("n > 0").join(F.broadcast(largest), group).groupBy(group, "campaign_id", "w").agg(F.sum("n").alias("n"), F.count("account_id").alias("a"))
    return own.groupBy(group).agg(share(F.col("a") >= 2).alias("share"), F.sum("n").alias("n_opens")).join(random, group, "left")


def _hash(draw: Column, group: str, seed: int) -> Column:
    """What a draw ranks accounts by."""
    return F.xxhash64("account_id", draw, group, F.lit(seed))


def _cuts(pool: DataFrame, sizes: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """(campaign_id, group, cuts): for every draw in order the (hash, account) of the last of `size` accounts of the pool, taken by hash and account.

    Hashes lie evenly, so a cut has an expected place. Accounts below the band around it are counted, those in it are
    ranked (in number about the square root of size), those above go at once. A cut that isn't in its band, which
    the counts tell, is looked for again among all accounts.
    """
    spark = pool.sparkSession
    counts = written(sizes.filter("campaign_id IS NOT NULL AND size > 0").join(pool.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("all")), "campaign_id"), "sizes")
    place = F.col("size") / F.col("all")
    off = BAND * F.sqrt(place * (1 - place) / F.col("all")) + BAND / F.col("all")
    asked = counts.withColumns({"draws": F.sequence(F.lit(1), F.lit(draws)), "low": place - off, "high": place + off})
    found = []
    while True:
        ranked = pool.join(F.broadcast(asked), "campaign_id").select("campaign_id", group, "account_id", "low", "high", F.explode("draws").alias("draw"))
        ranked = ranked.withColumn("h", _hash(F.col("draw"), group, seed)).withColumn("u", F.col("h").cast("double") / 2.0**64 + 0.5).filter("u <= high")
        inside = F.when(F.col("u") >= F.col("low"), F.struct("h", F.col("account_id").alias("a")))
        told = ranked.groupBy("campaign_id", group, "draw", inside.alias("cut")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("campaign_id", group, "draw").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)  # what lies below comes first
        told = told.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(counts), ["campaign_id", group])
        found.append(written(told.filter("upto >= size AND upto - n < size AND cut IS NOT NULL").select("campaign_id", group, "draw", "cut"), "cuts"))
        cuts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        cuts = cuts.groupBy("campaign_id", group).agg(F.sort_array(F.collect_list(F.struct("draw", "cut"))).alias("c"))  # draws times groups times campaigns
        if len(found) == 2:
            break
        missing = counts.join(cuts, ["campaign_id", group], "left").withColumn("draws", F.array_except(F.sequence(F.lit(1), F.lit(draws)), F.coalesce("c.draw", F.array().cast("array<int>")))).filter("size(draws) > 0")
        asked = written(missing.select("campaign_id", group, "size", "all", "draws", F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), "missing")
        if not asked.count():
            break
    return cuts.select("campaign_id", group, F.col("c.cut").alias("cuts"))


def compare_models(fold_rows: DataFrame, models: dict[str, Sequence[str]], target: str, alpha: float = 100.0, hurdle: float = 0.0) -> DataFrame:
    """model, fold, n, rho, mae, mean_selected: ridge fits of several feature sets on each fold's training rows, judged on its purged validation rows; fold 0 is the pooled validation.

    Spearman doesn't pool from folds, so it is computed again on the pooled rows.
    """
    out = None
    for name, columns in models.items():
        pooled = None
        for fold in sorted(r[0] for r in fold_rows.select("fold").distinct().collect()):
            rows = fold_rows.filter((F.col("fold") == fold) & F.col(target).isNotNull())
            train, val = rows.filter("role = 'train'"), rows.filter("role = 'validate' AND NOT purged")
            d = model.fit_design(train, columns, [])
            pred = model.scored(val, d, *model.ridge(model.gram(train, d.columns(), F.col(target))[None], alpha)).select("fold", "score", target)
            pooled = pred if pooled is None else pooled.unionByName(pred)
        both = written(pooled.unionByName(pooled.withColumn("fold", F.lit(0))), "predictions")
        err = both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("score") - F.col(target))).alias("mae"), F.avg(F.when(F.col("score") > hurdle, F.col(target))).alias("mean_selected"))
        rho = stats.spearman(both, ["score"], [target], ["fold"]).select("fold", "rho")
        part = err.join(rho, "fold", "left").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "fold", "n", "rho", "mae", "mean_selected")


def walk_forward(rows: DataFrame, splits: Sequence[tuple[Sequence[int], Sequence[int]]], models: dict[str, tuple[Sequence[str], Sequence[str]]], target: str, track: str, pairs: Sequence[tuple[int, int]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Every validation row that track leaves, once per fold it stands in: fold, keep, target, and a score per model (numeric, categorical columns), from the artifact of the fold's training rows."""
    own = written(nested.inner_purged(rows, track, pairs), "own")
    val = folds.fold_rows(rows, track, pairs, splits=splits).filter("role = 'validate' AND NOT purged")
    for name, (numeric, categorical) in models.items():
        score = F.lit(None).cast("double")
        for fold, art in nested.fit_folds(own, [train for train, _ in splits], numeric, categorical, target).items():
            total = F.lit(float(art["intercept"]))
            for c, w in zip(model.design_of(art).columns(), art["weights"], strict=True):
                total = total + c * float(w)
            score = F.when(F.col("fold") == fold, total).otherwise(score)
        val = val.withColumn(name, score)
    return val.select("fold", *keep, target, *models)


#: The candidate's economics may fall to this share of the base's.
RETAINED = 0.9


def include_rule(rows: DataFrame, splits: Sequence[tuple[Sequence[int], Sequence[int]]], base: tuple[Sequence[str], Sequence[str]], candidate: tuple[Sequence[str], Sequence[str]], cluster: Column, target: str = "gross_loss_per_lot", pairs: Sequence[tuple[int, int]] = (), settings: Settings = DEFAULT) -> DataFrame:
    """Whether the candidate's columns are worth including, judged on walk-forward validation: one row per track.

    track, n, rho_base, rho_candidate, rho_difference with lo and hi, mean_base, mean_candidate (of the target over rows
    whose score clears the hurdle), mean_difference with lo and hi, include. Included is what has the higher pooled rank
    correlation in track B, which purges nothing, and keeps RETAINED of the base's mean in track A, if both have one.
    Intervals are of differences under the same draws of clusters; ranks are those of the whole, not ranked again.
    """
    models = {"base_": base, "candidate_": candidate}
    told = {}
    # both tracks train on the same rows; they differ in what is purged from validation, inner and outer
    own = nested.inner_purged(rows, "A", pairs).withColumn("kept", F.lit(False))
    fits = tracks.fit_models(own, [train for train, _ in splits], models, target, ["purged", "kept"])
    val = folds.fold_rows(rows.withColumn("cluster_", cluster), "A", pairs, splits=splits).filter((F.col("role") == "validate") & F.col(target).isNotNull())
    scores = {f"{m}{track}": _score(fits[purge, m]) for track, purge in (("A", "purged"), ("B", "kept")) for m in models}
    both = written(val.select("cluster_", F.col(target).cast("double").alias("y_"), "purged", *[s.alias(n) for n, s in scores.items()]), "scored")
    for track in ("A", "B"):
        scored = both.filter("NOT purged" if track == "A" else "true").select("cluster_", "y_", *[F.col(f"{m}{track}").alias(m) for m in models])
        ranked = stats.with_ranks(scored, ["y_", *models], keep=["cluster_"])
        kinds = {m: (F.col(f"r{m}") * F.col("ry_"), F.col(f"r{m}") * F.col(f"r{m}")) for m in models} | {"y_": (F.col("ry_") * F.col("ry_"), F.lit(1.0))}
        whole, drawn = bootstrap.paired_sums(ranked, F.col("cluster_"), kinds, settings)
        rho = {m: _rho(whole[m], whole["y_"]) if m in whole else None for m in models}
        rhos = [_rho(drawn[m].T, drawn["y_"].T) for m in models]
        chosen = {m: (F.when(F.col(m) > settings.hurdle, F.col("y_")), F.when(F.col(m) > settings.hurdle, 1.0)) for m in models}
        total, sums = bootstrap.paired_sums(scored, F.col("cluster_"), chosen, settings)
        mean = {m: total[m][0] / total[m][1] if m in total and total[m][1] else None for m in models}
        with np.errstate(invalid="ignore", divide="ignore"):
            means = [sums[m][:, 0] / sums[m][:, 1] for m in models]
        told[track] = (scored.count(), rho, _difference(rho, rhos), mean, _difference(mean, means))
    (a, b), (x, y) = (told["A"][3][m] for m in models), (told["B"][1][m] for m in models)
    include = bool(x is not None and y is not None and y > x and (a is None or b is None or b >= RETAINED * a))
    out = [(t, n, *r.values(), *dr, *m.values(), *dm, include) for t, (n, r, dr, m, dm) in told.items()]
    columns = "rho_base double, rho_candidate double, rho_difference double, rho_lo double, rho_hi double, mean_base double, mean_candidate double, mean_difference double, mean_lo double, mean_hi double"
    return rows.sparkSession.createDataFrame(out, f"track string, n long, {columns}, include boolean")


def _score(fits: dict[int, tracks.Fit]) -> Column:
    """Of a row of a fold, by the fold's fit."""
    score = F.lit(None).cast("double")
    for fold, fit in fits.items():
        total = F.lit(float(fit.intercept))
        for c, w in zip(fit.design.columns(), fit.weights, strict=True):
            total = total + c * float(w)
        score = F.when(F.col("fold") == fold, total).otherwise(score)
    return score


def _rho(own, y):
    """From sums of (product with y, own square) and (square of y, rows); missing where nothing varies."""
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where((own[1] > 0) & (y[0] > 0), own[0] / np.sqrt(own[1] * y[0]), np.nan)
    return r if r.ndim else None if np.isnan(r) else float(r)


def _difference(whole: dict[str, float | None], drawn: list[np.ndarray]) -> tuple[float | None, float | None, float | None]:
    """Second less first: of the whole, and the bounds of the middle 95 % of draws that have both."""
    a, b = whole.values()
    d = drawn[1] - drawn[0]
    d = d[~np.isnan(d)]
    if a is None or b is None or not len(d):
        return None, None, None
    return b - a, float(np.percentile(d, 2.5)), float(np.percentile(d, 97.5))


def select_then_validate(fold_rows: DataFrame, bucket: Column, value: str, least: int = 30) -> DataFrame:
    """Per fold: the bucket with the best mean in training (of those with enough rows), and its n and mean in validation."""
    g = fold_rows.filter(F.col(value).isNotNull() & ~F.col("purged")).groupBy("fold", "role", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")).filter("bucket IS NOT NULL")
    best = g.filter((F.col("role") == "train") & (F.col("n") >= least)).groupBy("fold").agg(F.max_by("bucket", F.struct(F.round("m", 9), "bucket")).alias("bucket"), F.max("m").alias("train_mean"))
    val = g.filter("role = 'validate'").select("fold", "bucket", F.col("n").alias("val_n"), F.col("m").alias("val_mean"))
    return best.join(val, ["fold", "bucket"], "left").select("fold", "bucket", "train_mean", F.coalesce("val_n", F.lit(0)).alias("val_n"), "val_mean")


def grid_states(df: DataFrame, first: Sequence[tuple[str, Column]], second: Sequence[tuple[str, Column]], value: str, least: int = 30) -> DataFrame:
    """Every pair of a first and a second predicate with enough rows: state, n, mean, standard error. All pairs in one pass over conditional sums."""
    pairs = [(f"{a} & {b}", sure(p) & sure(q)) for a, p in first for b, q in second]
    one = df.agg(*[x for i, (_, p) in enumerate(pairs) for x in (F.count(F.when(p, F.col(value))).alias(f"n{i}"), F.avg(F.when(p, F.col(value))).alias(f"m{i}"), F.stddev_samp(F.when(p, F.col(value))).alias(f"s{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("state"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), (F.col(f"s{i}") / F.sqrt(F.col(f"n{i}"))).alias("se")) for i, (n, _) in enumerate(pairs)])).alias("r")).select("r.*").filter(F.col("n") >= least)
