"""Running sums and ranks over whole tables, whose groups may be of any size: no group is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "running", total: str | None = None) -> DataFrame:
    """df with the sum of value over the rows of its keys up to each row by order, and with total, over all of them. order must tell rows apart.

    Rows are dealt by ranges of keys and order, so a large group spans many tasks. Sums start anew in each range; what
    the ranges before hold (a row per range and group that it has) is added.
    """
    dealt = written(df.sort(*keys, *order).withColumn("range_", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*keys, "range_").agg(F.sum(value).alias("in_range_"))
    group = Window.partitionBy(*keys)
    # ranges and the groups that cross them: few rows
    offsets = sums.select(*keys, "range_", F.coalesce(F.sum("in_range_").over(group.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("in_range_").over(group).alias("total_"))
    local = dealt.withColumn(name, F.sum(value).over(Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(offsets, [*keys, "range_"]).withColumn(name, F.col(name) + F.col("before_"))
    if total:
        out = out.withColumn(total, F.col("total_"))
    return out.drop("range_", "before_", "total_")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with dense numbers from 0 by order, which must tell rows apart."""
    return running(df.withColumn("one_", F.lit(1).cast("long")), [], order, "one_", name).withColumn(name, F.col(name) - 1).drop("one_")


def placed(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column_, value_, n_, upto_, all_) of every distinct value of the columns, taken as doubles: how often it occurs, how many values of its column and group are not above it, and how many there are. Missing values have none."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column_"), F.col(c).cast("double").alias("value_")) for c in columns])).alias("c_")).select(*by, "c_.*").filter("value_ IS NOT NULL")
    counts = long.groupBy(*by, "column_", "value_").agg(F.count(F.lit(1)).alias("n_"))
    return running(counts, [*by, "column_"], ["value_"], "n_", "upto_", "all_")


def centred_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column_, value_, rank_) of every distinct value: its average rank less the mean of all ranks of its column and group."""
    return placed(df, columns, by).select(*by, "column_", "value_", (F.col("upto_") - (F.col("n_") - 1) / 2.0 - (F.col("all_") + 1) / 2.0).alias("rank_"))


def _at(rank: Column) -> Column:
    """In a group of placed values: the value of this rank, from 0."""
    return F.max(F.when((F.col("upto_") - F.col("n_") <= rank) & (rank < F.col("upto_")), F.col("value_")))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column_, quantiles array<double>): exact quantiles by linear interpolation. A column without values has no row in its group.

    Values are counted, dealt by ranges and numbered; the two neighbours of each quantile are then picked by map-side
    aggregates, so neither a sketch nor all distinct values of a column meet in one task.
    """
    picked = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("all_") - 1)
        picked += [_at(F.floor(place)), _at(F.ceil(place))]
    names = [f"q{i}_" for i in range(len(picked))]
    found = placed(df, columns, by).groupBy(*by, "column_").agg(F.max("all_").alias("all_"), *[c.alias(n) for c, n in zip(picked, names, strict=True)])
    told = []
    for i, share in enumerate(shares):
        place, low, high = F.lit(float(share)) * (F.col("all_") - 1), F.col(names[2 * i]), F.col(names[2 * i + 1])
        told.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return found.select(*by, "column_", F.array(*told).alias("quantiles"))


def quantiles_of(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """The exact quantiles of one column; None without values."""
    found = quantiles(df, [column], shares).first()
    return found["quantiles"] if found else None


def at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """The values of these ranks, from 0 for the least; None where there are not so many."""
    found = placed(df, [column]).agg(*[_at(F.lit(int(r))).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    return list(found)
