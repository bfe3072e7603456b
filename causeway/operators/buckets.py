"""Bucketing by quantiles or fixed edges, and tables over buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .ranks import at_ranks, quantiles, quantiles_of


def edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """Distinct edges of equal-count buckets: exact quantiles by linear interpolation, duplicates dropped. Nulls are left out; no values, no edges."""
    return list(dict.fromkeys(quantiles_of(df, column, [i / parts for i in range(parts + 1)]) or []))


def edges_by(df: DataFrame, group: str, value: str, parts: int) -> DataFrame:
    """(group, edges) for every group that has values, all at once."""
    return quantiles(df, [value], [i / parts for i in range(parts + 1)], [group]).select(group, F.array_distinct("quantiles").alias("edges"))


def bucket(value: Column, found: Sequence[float] | Column) -> Column:
    """Index from 0 of a right-closed bucket, the lowest value included; null for null and outside. With one edge all is bucket 0."""
    e = F.array(*[F.lit(float(x)) for x in found]) if not isinstance(found, Column) else found
    inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
    inside = (value >= F.element_at(e, 1)) & (value <= F.element_at(e, -1))
    return F.when(inside & (F.size(e) > 0), F.size(F.filter(inner, lambda x: x < value)))


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per row and column: keep, feature, value (double)."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("u")).select(*keep, "u.feature", "u.value")


def univariate(df: DataFrame, columns: Sequence[str], target: str, parts: int = 5) -> DataFrame:
    """Per numeric feature and quantile bucket: n, mean target. One pass for the edges of all features, one for the buckets; the edges (a row per feature) are broadcast."""
    long = written(unpivoted(df, columns, [target]).filter("value IS NOT NULL"), "unpivoted")
    found = edges_by(long, "feature", "value", parts)
    joined = long.join(F.broadcast(found), "feature")  # as many rows as there are columns
    return joined.groupBy("feature", bucket(F.col("value"), F.col("edges")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"))


def by_level(df: DataFrame, column: str, target: str) -> DataFrame:
    """The same for a categorical or boolean column: level (null as missing), n, mean target."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"))


def histogram(df: DataFrame, column: str, upper: Sequence[float], labels: Sequence[str], lower: float) -> DataFrame:
    """Counts in the right-closed bins (lower, upper[0]], (upper[0], upper[1]], ...; every label has a row, empty ones 0."""
    at = F.lit(None).cast("string")
    for u, name in reversed(list(zip(upper, labels, strict=True))):
        at = F.when(F.col(column) <= u, name).otherwise(at)
    counts = df.filter(F.col(column) > lower).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "bin string")
    return names.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row by column, 0 where there is none. values: the columns, named so that no pass is needed to find them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def tail_share(df: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """Sum of the ceil(share * n) largest values over the sum of all: n_top, tail_share. Ties at the bound count as often as the tail has room; all by aggregates."""
    v = F.col(column)
    known = df.filter(v.isNotNull())
    n = known.count()
    k = math.ceil(n * share)
    if not k:
        return df.sparkSession.createDataFrame([], "n_top long, tail_share double")
    bound = at_ranks(known, column, [n - k])[0]
    out = known.agg(F.count_if(v > bound).alias("above"), F.coalesce(F.sum(F.when(v > bound, v)), F.lit(0.0)).alias("s"), F.sum(v).alias("total"))
    return out.select(F.lit(k).cast("long").alias("n_top"), F.try_divide(F.col("s") + (F.lit(k) - F.col("above")) * F.lit(bound), F.col("total")).alias("tail_share"))
