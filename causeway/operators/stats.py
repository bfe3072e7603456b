"""Rank correlation, pruning, winsorising, intra-cluster correlation, power, multiple testing, small tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .ranks import centred_ranks, quantiles, quantiles_of

#: Sum of the normal quantiles for a two-sided 5 % test with 80 % power.
Z_SUM = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


def describe(df: DataFrame, column: str, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """One row: n, mean, std (n - 1), min, exact percentiles p10 ..., max."""
    own = written(df.select(F.col(column).alias("v")), "described")
    found = quantiles(own, ["v"], shares)  # one row, or none
    one = own.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).join(F.broadcast(found), how="left")
    return one.select("n", "mean", "std", "min", *[F.col("quantiles")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(shares)], "max")


def spearman(df: DataFrame, columns: Sequence[str], against: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(*by, a, b, rho, n) for every pair of columns, or of columns with `against`, in each group of by; rows with both values, average ranks for ties.

    A column is ranked once for all its pairs, if neither it nor a partner lacks values; a pair that lacks some ranks its
    own rows. Ranks come from counts per value and are joined back by column and value, all columns at once. No rows give no groups, and without by one row
    per pair with no rho.
    """
    pairs = [(a, b) for a in columns for b in against if a != b] if against else list(combinations(columns, 2))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    have = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(used)]).first()
    whole = {c for i, c in enumerate(used) if have[f"c{i}"] == have["n"]}
    values: dict[str, Column] = {}
    sides: list[tuple[str, str]] = []

    def side(key: tuple, value: Column) -> str:
        names.setdefault(key, f"v{len(names)}")
        values[names[key]] = value
        return names[key]

    names: dict[tuple, str] = {}
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        if a in whole and b in whole:
            sides.append((side((a,), x), side((b,), y)))
        else:
            sides.append((side((a, b, 0), F.when(y.isNotNull(), x)), side((a, b, 1), F.when(x.isNotNull(), y))))
    wide = with_ranks(df.select(*by, *[v.alias(n) for n, v in values.items()]), list(values), by)
    sums = [s for i, (x, y) in enumerate(sides) for s in (F.count(f"r{x}").alias(f"n{i}"), F.sum(F.col(f"r{x}") * F.col(f"r{y}")).alias(f"s{i}"))]
    spread = [F.sum(F.col(f"r{n}") * F.col(f"r{n}")).alias(f"q{n}") for n in values]
    one = wide.groupBy(*by).agg(*sums, *spread)
    rho = lambda i, x, y: F.when((F.col(f"q{x}") > 0) & (F.col(f"q{y}") > 0), F.col(f"s{i}") / F.sqrt(F.col(f"q{x}") * F.col(f"q{y}")))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(i, x, y).alias("rho"), F.col(f"n{i}").alias("n")) for i, ((a, b), (x, y)) in enumerate(zip(pairs, sides, strict=True))]
    return one.select(*by, F.explode(F.array(*rows)).alias("r_")).select(*by, "r_.*")


def with_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """by, keep, and r<column> for every column: its average rank less the mean of all in its group, null where it is missing. Rows without any of the columns are gone."""
    wide = written(df.select(*by, *keep, *columns, F.monotonically_increasing_id().alias("row_")), "ranked")
    long = wide.select(*by, *keep, "row_", F.explode(F.array(*[F.struct(F.lit(n).alias("column_"), F.col(n).cast("double").alias("value_")) for n in columns])).alias("c_")).select(*by, *keep, "row_", "c_.*").filter("value_ IS NOT NULL")
    # one join gives all columns their ranks; a value that very many rows share is one row of the smaller side
    long = long.join(written(centred_ranks(wide, columns, by), "ranks"), [*by, "column_", "value_"])
    return long.groupBy(*by, "row_").agg(*[F.first(k).alias(k) for k in keep], *[F.max(F.when(F.col("column_") == n, F.col("rank_"))).alias(f"r{n}") for n in columns]).drop("row_")


def prune(pairs: Sequence[tuple[str, str, float]], coverage: dict[str, float], family: dict[str, int] | None = None, at: float = 0.9, gap: float = 0.02) -> list[tuple[str, str, float]]:
    """(dropped, kept, rho) in order of falling |rho|. Of two features over the bound goes the one with less coverage if they differ by more than gap, else that of the newer family, else the later name; pairs with a dropped one are passed over. On a small collected list: the rule is sequential."""
    gone: list[tuple[str, str, float]] = []
    for a, b, rho in sorted(pairs, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if abs(rho) > at and not {a, b} & {g[0] for g in gone}:
            age = family or {}
            if abs(coverage[a] - coverage[b]) > gap:
                out = a if coverage[a] < coverage[b] else b
            elif age.get(a, 0) != age.get(b, 0):
                out = a if age.get(a, 0) > age.get(b, 0) else b
            else:
                out = max(a, b)
            gone.append((out, a if out == b else b, rho))
    return gone


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, coverage): the share of rows with a value."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in columns])).alias("c")).select("c.*")


def winsorised(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, train: DataFrame | None = None) -> DataFrame:
    """df with the column clipped at quantiles of train (df itself by default), as <column>_w."""
    a, b = quantiles_of(train if train is not None else df, column, (low, high)) or (None, None)
    return df.withColumn(f"{column}_w", F.when(F.col(column).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(column)))))


def icc(df: DataFrame, value: str, cluster: Column, by: Sequence[str] = ()) -> DataFrame:
    """One-way random effects, of each group of by: n_rows, n_clusters, ms_between, ms_within, m0, icc, deff. From (n, sum, sum of squares) per cluster, centred by the grand mean against cancellation; degenerate data give icc 0 and deff 1."""
    work = df.select(*by, F.col(value).alias("y"), cluster.alias("k")).filter("y IS NOT NULL AND k IS NOT NULL")
    mean = work.groupBy(*by).agg(F.avg("y").alias("g"))
    both = work.join(mean, list(by)) if by else work.crossJoin(F.broadcast(mean))  # without groups, mean is one row
    g = both.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") - F.col("g")).alias("s"), F.sum(F.pow(F.col("y") - F.col("g"), F.lit(2))).alias("q"))
    t = g.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ssb"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    c = F.col
    t = t.withColumns({"ms_between": F.try_divide(c("ssb"), c("n_clusters") - 1), "ms_within": F.try_divide(c("ssw"), c("n_rows") - c("n_clusters")), "m0": F.try_divide(c("n_rows") - c("n2") / c("n_rows"), c("n_clusters") - 1)})
    raw = F.try_divide(c("ms_between") - c("ms_within"), c("ms_between") + (c("m0") - 1) * c("ms_within"))
    return t.withColumn("icc", F.coalesce(raw, F.lit(0.0))).select(*by, "n_rows", "n_clusters", "ms_between", "ms_within", "m0", "icc", (1 + (c("n_rows") / c("n_clusters") - 1) * c("icc")).alias("deff"))


def per_arm(sigma: float, deff: float, delta: float) -> float:
    return 2 * Z_SUM**2 * sigma**2 / delta**2 * deff


def least_effect(sigma: float, n: int, deff: float) -> float:
    """The smallest effect that n rows of one arm show."""
    return Z_SUM * sigma * math.sqrt(deff / n) if n > 0 else math.inf


def benjamini_hochberg(df: DataFrame, p: str, tests: int | None = None, key: str = "test") -> DataFrame:
    """df with q, the false discovery rate: the running least, from the largest p down, of p * m / rank. tests enlarges m. df is a table of tests, small by nature."""
    up = Window.orderBy(F.asc(p), F.asc(key))
    m = F.lit(tests) if tests else F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("q_", F.col(p) * m / F.row_number().over(up)).withColumn("q", F.least(F.lit(1.0), F.min("q_").over(Window.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)))).drop("q_")


def two_by_two(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of a crossed with b, Pearson's chi-squared and the z of two proportions."""
    t = df.agg(*[F.count_if(x & y).alias(n) for n, x, y in (("n11", a, b), ("n10", a, ~b), ("n01", ~a, b), ("n00", ~a, ~b))])
    r1, r0, c1, c0 = F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00"), F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00")
    n, det = r1 + r0, F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01")
    pooled = c1 / n
    return t.select("*", F.try_divide(n * det.cast("double") * det, r1.cast("double") * r0 * c1 * c0).alias("chi2"), F.try_divide(F.try_divide(F.col("n11"), r1) - F.try_divide(F.col("n01"), r0), F.sqrt(pooled * (1 - pooled) * (1 / r1 + 1 / r0))).alias("z"))


def least_squares(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept, r2 and n of y on x over rows with both."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def shift(old: DataFrame, new: DataFrame, columns: Sequence[str], collapse: float = 0.1) -> DataFrame:
    """Per feature: mean and coverage before and after, and whether coverage fell by `collapse` or more."""

    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[x for c in columns for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.avg(F.col(c).isNotNull().cast("double")).alias(f"c_{c}"))])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias(f"mean_{name}"), F.col(f"c_{c}").alias(f"coverage_{name}")) for c in columns])).alias("r")).select("r.*")

    return side(old, "old").join(side(new, "new"), "feature").withColumn("collapsed", F.col("coverage_old") - F.col("coverage_new") >= collapse)


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n_rest, mean_rest): the mean over all other groups, from sums."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))  # one row
    return g.crossJoin(F.broadcast(total)).select(group, (F.col("tn") - F.col("n")).alias("n_rest"), F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("mean_rest"))
