"""Column expressions shared by the operators. Predicates never yield null: a comparison with a missing value is false."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT


def sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def seconds(later: Column, earlier: Column) -> Column:
    """Difference in seconds with fractions; timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def number(c: Column) -> Column:
    """A double, or null where the value isn't a number (NaN included)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def era(campaign: Column, name: str, settings=DEFAULT) -> Column:
    kept = ~campaign.isin(*settings.excluded_campaigns)
    if name == "all":
        return kept
    if name == "primary":
        return kept & (campaign >= settings.primary_from)
    if name == "prelude":
        return kept & (campaign < settings.primary_from)
    raise ValueError(f"unknown era {name!r}")


def loss_per_lot(profit: Column, amount: Column) -> Column:
    return F.when(amount != 0, -profit / amount)


def reverse_per_lot(profit: Column, amount: Column, hurdle: float = DEFAULT.hurdle) -> Column:
    return loss_per_lot(profit, amount) - hurdle


def net_or_parts(net: Column, profit: Column, commission: Column, swap: Column) -> Column:
    """netProfit, else profit plus commission and swap (missing ones count nothing); null only if both are missing."""
    return F.coalesce(net, profit + F.coalesce(commission, F.lit(0.0)) + F.coalesce(swap, F.lit(0.0)))


def exit_type(close: Column, stop: Column, take: Column, tolerance: float = 1.0) -> Column:
    """Stop wins over take where both are near."""
    return F.when(F.abs(close - stop) <= tolerance, "sl_hit").when(F.abs(close - take) <= tolerance, "tp_hit").otherwise("manual")


def trader_cluster(trader: Column, campaign: Column, account: Column) -> Column:
    return F.coalesce(trader.cast("string"), F.concat_ws("_", campaign.cast("string"), account.cast("string")))


def ip_cluster(ip: Column, campaign: Column, account: Column, minus_one_is_missing: bool = True) -> Column:
    """The two conventions of the source data: -1 marks a missing address, or is an address like any other."""
    known = ip.isNotNull() & (ip != -1) if minus_one_is_missing else ip.isNotNull()
    return F.when(sure(known), F.concat(F.lit("ip_"), ip.cast("string"))).otherwise(F.concat_ws("_", F.lit("acct"), campaign.cast("string"), account.cast("string")))


def account_cluster(account: Column, row_key: Column) -> Column:
    return F.coalesce(account.cast("string"), F.concat(F.lit("missing"), row_key.cast("string")))


def challenge(c: Column) -> Column:
    """Canonical text of a mixed number and text column: 11.0 is 11, missing is unknown."""
    d = c.try_cast("double")
    whole = sure((d == F.floor(d)) & (F.abs(d) < 1e15))
    return F.coalesce(F.when(whole, F.floor(d).cast("bigint").cast("string")).otherwise(F.when(F.isnan(d), F.lit(None)).otherwise(c.cast("string"))), F.lit("unknown"))


def normal_tails(z: Column) -> Column:
    """The probability of a standard normal beyond |z| on either side, to some 15 decimals, by the power series of the distribution about 0."""
    a = F.abs(z)
    first = F.struct(a.cast("double").alias("term"), a.cast("double").alias("sum"))
    step = lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2 * k + 1)).alias("sum"))
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(160)), first, step, lambda s: s["sum"]) * F.exp(-a * a / 2) * math.sqrt(2 / math.pi)
    return F.when(a < 8, F.greatest(F.lit(0.0), 1 - inside)).when(a >= 8, F.lit(0.0))


def stop_distance(open_price: Column, stop: Column) -> Column:
    return F.when(open_price != 0, F.abs(open_price - stop) / open_price)
