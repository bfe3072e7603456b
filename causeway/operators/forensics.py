"""Who shares what: registrations, addresses, and accounts that open in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sure
from .ranks import numbered


def activation(registered: DataFrame, active: DataFrame, campaign: str = "campaign_id", account: str = "account_id") -> DataFrame:
    """Per campaign: registrants, active accounts, their share. Campaigns without registrants are left out."""
    r = registered.groupBy(campaign).agg(F.count(F.lit(1)).alias("registrants"))
    a = active.groupBy(campaign).agg(F.count_distinct(account).alias("active"))
    return r.join(a, campaign).withColumn("rate", F.col("active") / F.col("registrants"))


def ip_clusters(registrations: DataFrame, traded: DataFrame) -> DataFrame:
    """Per address: accounts, campaigns, first and last campaign, most accounts registered and most trading in one campaign, and whether its accounts come in parallel, one after another, or alone."""
    known = registrations.filter("ip_cluster_id IS NOT NULL AND ip_cluster_id <> -1")
    per = known.groupBy("ip_cluster_id", "campaign_id").agg(F.count_distinct("account_id").alias("reg"))
    act = known.join(traded.select("campaign_id", "account_id").distinct(), ["campaign_id", "account_id"], "left_semi").groupBy("ip_cluster_id", "campaign_id").agg(F.count_distinct("account_id").alias("act"))
    wide = known.groupBy("ip_cluster_id").agg(F.count_distinct("account_id").alias("accounts"))
    out = per.join(act, ["ip_cluster_id", "campaign_id"], "left").groupBy("ip_cluster_id").agg(
        F.count(F.lit(1)).alias("campaigns"), F.min("campaign_id").alias("first_campaign"), F.max("campaign_id").alias("last_campaign"), F.max("reg").alias("most_registered"), F.coalesce(F.max("act"), F.lit(0)).alias("most_trading")
    )
    kind = F.when(F.col("accounts") == 1, "single").when(F.col("most_trading") >= 2, "parallel").otherwise("serial")
    return out.join(wide, "ip_cluster_id").withColumn("kind", kind)


def in_step(df: DataFrame, group: str, minutes: int = 5) -> DataFrame:
    """Per (group, campaign): opens, and the share of them in windows of so many minutes in which two accounts of the group or more opened."""
    w = F.window("open_time", f"{minutes} minutes").getField("start")
    each = df.groupBy(group, "campaign_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("a"))
    return each.groupBy(group, "campaign_id").agg(F.sum("n").alias("n_opens"), (F.sum(F.when(F.col("a") >= 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_in_step"))


def shared_addresses(df: DataFrame, account: str, address: str, order: str) -> DataFrame:
    """df with shared (more than one account at the address) and ip_cluster, dense numbers in order of first appearance, -1 where the address is missing.

    The numbering ranks addresses that occur, by their first row; it runs over one row per address, in ranges.
    """
    per = df.filter(F.col(address).isNotNull()).groupBy(address).agg((F.count_distinct(account) > 1).alias("shared"), F.min(order).alias("o"))
    named = numbered(per, ["o", address], "ip_cluster").withColumn("ip_cluster", F.col("ip_cluster").cast("int")).drop("o")
    return df.join(named, address, "left").withColumns({"shared": sure(F.col("shared")), "ip_cluster": F.coalesce("ip_cluster", F.lit(-1))})


def sanitised(df: DataFrame, email: str = "email", address: str = "ip_address", drop: tuple[str, ...] = ("telegram", "email", "ip_address", "phone", "name"), salt: str = "") -> DataFrame:
    """df with trader_key (12 hex digits of the SHA-256 of the lower-cased, trimmed email, null where it is blank or a spelled-out missing value) and without any column whose name contains one of drop. Unsalted digests of emails can be guessed: give a salt."""
    e = F.lower(F.trim(F.col(email)))
    keyed = df.withColumn("trader_key", F.when(e.isNotNull() & ~e.isin("", "nan", "none", "null"), F.substring(F.sha2(F.concat(F.lit(salt), e).cast("binary"), 256), 1, 12)))
    out = keyed.drop(*[c for c in keyed.columns if c != "trader_key" and any(p in c.lower() for p in drop)])
    left = [c for c in out.columns if any(p in c.lower() for p in drop)]
    if left:
        raise ValueError(f"personal columns are left: {left}")
    return out
