"""Walk-forward folds over campaigns, with identities purged from validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.exprs import sure


def windows(campaigns: Sequence[int], n_folds: int, least: int) -> list[tuple[list[int], list[int]]]:
    """(training, validation) campaigns of each fold: training expands, what doesn't divide evenly goes to the last folds."""
    c = sorted(campaigns)
    if len(c) < least + n_folds:
        raise ValueError(f"{n_folds} folds need {least + n_folds} campaigns, got {len(c)}")
    base, more = divmod(len(c) - least, n_folds)
    out, at = [], least
    for i in range(n_folds):
        n = base + (i >= n_folds - more)
        out.append((c[:at], c[at : at + n]))
        at += n
    return out


def inner_windows(campaigns: Sequence[int], least: int = 2) -> list[tuple[list[int], list[int]]]:
    """Expanding from two campaigns, the next one validates."""
    c = sorted(campaigns)
    return [(c[:i], [c[i]]) for i in range(least, len(c))]


def fold_rows(df: DataFrame, track: str = "A", pairs: Sequence[tuple[int, int]] = (), settings: Settings = DEFAULT, splits: Sequence[tuple[Sequence[int], Sequence[int]]] | None = None) -> DataFrame:
    """Every row once per fold it takes part in: df, fold, role (train or validate), trader_overlap, ip_overlap, targeted, purged.

    Track A purges a validation row whose trader trained, or whose address trained and whose (address, campaign) is one
    of `pairs`; missing keys never match, and -1 is an address like any other here. Track B purges nothing.
    """
    if track not in ("A", "B"):
        raise ValueError(f"track must be A or B, got {track!r}")
    spark = df.sparkSession
    primary = df.filter(F.col("campaign_id").between(settings.primary_from, settings.primary_to))
    splits = splits or windows([r[0] for r in primary.select("campaign_id").distinct().collect()], settings.fold_count, settings.least_train_campaigns)
    roles = spark.createDataFrame([(f, c, role) for f, (a, b) in enumerate(splits, 1) for role, cs in (("train", a), ("validate", b)) for c in cs], "fold int, campaign_id int, role string")
    rows = primary.join(F.broadcast(roles), "campaign_id")  # folds times campaigns: a few hundred rows at most
    train = rows.filter("role = 'train'")
    traders = train.filter("trader_key IS NOT NULL").select("fold", "trader_key").distinct().withColumn("trader_trained", F.lit(True))
    ips = train.filter("ip_cluster_id IS NOT NULL").select("fold", "ip_cluster_id").distinct().withColumn("ip_trained", F.lit(True))
    flagged = spark.createDataFrame([*pairs], "ip_cluster_id int, campaign_id int").distinct().withColumn("flagged", F.lit(True))
    joined = rows.join(traders, ["fold", "trader_key"], "left").join(ips, ["fold", "ip_cluster_id"], "left").join(F.broadcast(flagged), ["ip_cluster_id", "campaign_id"], "left")  # pairs is a literal list
    on = (F.col("role") == "validate") & F.lit(track == "A")
    marked = joined.withColumns({"trader_overlap": on & sure(F.col("trader_trained")), "ip_overlap": on & sure(F.col("ip_trained")), "targeted": on & sure(F.col("ip_trained") & F.col("flagged"))})
    return marked.withColumn("purged", F.col("trader_overlap") | F.col("targeted")).drop("trader_trained", "ip_trained", "flagged")


def attrition(rows: DataFrame) -> DataFrame:
    """Per fold: rows and accounts of training, of raw and of purged validation, and why rows went."""
    v, t, i, g, p = F.col("role") == "validate", F.col("trader_overlap"), F.col("ip_overlap"), F.col("targeted"), F.col("purged")
    n = lambda c: F.count_if(c)
    acc = lambda c: F.count_distinct(F.when(c, F.col("account_id")))
    return rows.groupBy("fold").agg(
        n(~v).alias("train_rows"), n(v).alias("raw_val_rows"), n(v & ~p).alias("purged_val_rows"), n(p).alias("rows_removed"), n(t & ~i).alias("trader_only_rows"), n(i & ~t).alias("ip_only_rows"),
        n(t & i).alias("both_rows"), n(t | i).alias("broad_rows_removed"), n(g & ~t).alias("targeted_ip_only_rows"), n(g & t).alias("targeted_both_rows"),
        acc(~v).alias("train_accounts"), acc(v).alias("raw_val_accounts"), acc(v & ~p).alias("purged_val_accounts"),
    ).withColumn("attrition", F.try_divide(F.col("rows_removed"), F.col("raw_val_rows")))
