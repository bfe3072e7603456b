"""The driver's tables seen as fills, positions, registrations and daily bars, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY, FIRST_CAMPAIGN = "2024-01-01", 52


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as positions: two days make a campaign, a user is an account, props.k gives size, length and prices."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    price = F.lit(100.0) + (F.col("event_id") % 50) / F.lit(10.0)
    return e.select(
        (F.lit(FIRST_CAMPAIGN) + F.floor(F.datediff("ts", F.lit(FIRST_DAY).cast("date")) / 2)).cast("int").alias("campaign_id"),
        F.col("user_id").alias("account_id"), F.col("event_id").alias("position_id"), F.col("ts").alias("open_time"),
        F.timestamp_add("MINUTE", F.col("k") * 10, F.col("ts")).alias("close_time"),
        ((F.lit(1) + F.col("k") % 50) / F.lit(100.0)).alias("amount"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        price.alias("open_price"),
        F.when(F.col("k") % 5 != 0, price - (F.lit(1) + F.col("k") % 7) / F.lit(10.0)).alias("sl_price"),
        F.when(F.col("k") % 4 != 0, price + F.lit(1.5)).alias("tp_price"),
        F.round(F.lit(35.0) - F.col("value"), 2).alias("net_profit"), F.round(F.lit(35.5) - F.col("value"), 2).alias("profit"),
        F.when(F.col("event_type") == "error", "sl_hit").when(F.col("event_type") == "signup", "tp_hit").otherwise("manual").alias("exit_type"),
        F.to_date("ts").alias("campaign_date"),
    )


POSITIONS = f"""
    events_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 100.0::DOUBLE + (event_id % 50) / 10.0::DOUBLE AS price FROM events),
    positions AS (SELECT CAST({FIRST_CAMPAIGN} + floor(datediff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) / 2) AS INTEGER) AS campaign_id, user_id AS account_id, event_id AS position_id,
        ts AS open_time, ts + to_minutes(k * 10) AS close_time, (1 + k % 50) / 100.0::DOUBLE AS amount, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, price AS open_price,
        CASE WHEN k % 5 <> 0 THEN price - (1 + k % 7) / 10.0::DOUBLE END AS sl_price, CASE WHEN k % 4 <> 0 THEN price + 1.5::DOUBLE END AS tp_price,
        round(35.0::DOUBLE - value, 2) AS net_profit, round(35.5::DOUBLE - value, 2) AS profit,
        CASE event_type WHEN 'error' THEN 'sl_hit' WHEN 'signup' THEN 'tp_hit' ELSE 'manual' END AS exit_type, CAST(ts AS DATE) AS campaign_date FROM events_k)"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per campaign and account that traded: some traders return, some are new each campaign, some have no key; addresses are shared."""
    active = positions(spark, sf_dir).select("campaign_id", "account_id").distinct()
    u = F.col("account_id")
    return active.select(
        "campaign_id", "account_id",
        F.when(u % 11 == 0, F.lit(None)).when(u % 4 == 0, u).otherwise(u * 100 + F.floor(F.col("campaign_id") / 4)).cast("bigint").alias("trader_key"),
        F.when(u % 7 == 0, -1).otherwise(u % 40).cast("int").alias("ip_cluster_id"), (u % 3 == 0).alias("shared_ip"),
        F.when(u % 5 == 0, "11.0").when(u % 5 == 1, "12").alias("challenge_type_id"),
    )


REGISTRATIONS = """
    registrations AS (SELECT DISTINCT campaign_id, account_id,
        CASE WHEN account_id % 11 = 0 THEN NULL WHEN account_id % 4 = 0 THEN account_id ELSE account_id * 100 + CAST(floor(campaign_id / 4) AS BIGINT) END AS trader_key,
        CAST(CASE WHEN account_id % 7 = 0 THEN -1 ELSE account_id % 40 END AS INTEGER) AS ip_cluster_id, account_id % 3 = 0 AS shared_ip,
        CASE account_id % 5 WHEN 0 THEN '11' WHEN 1 THEN '12' ELSE 'unknown' END AS challenge_type FROM positions)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as fills: an order is a position, a line one partial close. (order, line, part, supplier, date) is a total order of lines."""
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    j = li.join(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return j.select(
        (F.lit(FIRST_CAMPAIGN) + F.col("l_orderkey") % 15).cast("int").alias("campaign_id"), F.col("l_orderkey").alias("position_id"), F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("open_time"), F.col("l_shipdate").alias("close_time"), F.col("l_quantity").alias("amount"), price.alias("close_price"),
        (F.lit(1000.0) + F.col("l_orderkey") % 100).alias("open_price"), F.when(F.col("l_returnflag") == "R", price).alias("sl_price"), F.when(F.col("l_returnflag") == "A", price + 0.5).alias("tp_price"),
        F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("side"),
        (F.col("l_extendedprice") * F.col("l_discount") - 1000).alias("profit"), (F.col("l_extendedprice") * F.col("l_tax") / 10).alias("commission"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("tie"),
    )


FILLS = f"""
    fills AS (SELECT CAST({FIRST_CAMPAIGN} + l_orderkey % 15 AS INTEGER) AS campaign_id, l_orderkey AS position_id, o_custkey AS account_id, o_orderdate AS open_time, l_shipdate AS close_time,
        l_quantity AS amount, l_extendedprice / l_quantity AS close_price, 1000.0::DOUBLE + l_orderkey % 100 AS open_price, CASE WHEN l_returnflag = 'R' THEN l_extendedprice / l_quantity END AS sl_price,
        CASE WHEN l_returnflag = 'A' THEN l_extendedprice / l_quantity + 0.5::DOUBLE END AS tp_price, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side,
        l_extendedprice * l_discount - 1000 AS profit, l_extendedprice * l_tax / 10 AS commission, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as a price: open, high, low, close of each day."""
    from ..operators.positions import bars

    return bars(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("price")))


BARS = "bars AS (SELECT CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1)"
