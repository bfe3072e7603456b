"""Analysis tables over the adapters, each a plan that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import challenge, loss_per_lot, reverse_per_lot
from ..operators import features as f
from ..operators.positions import ACCOUNT, previous_day
from ..operators.state import state_vectors
from . import adapters as a

POSITION = ("position_id", *ACCOUNT)


def with_traders(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration columns and cluster sizes; one row per campaign and account there, so nothing fans out."""
    r = a.registrations(spark, sf_dir).withColumn("challenge_type", challenge(F.col("challenge_type_id"))).drop("challenge_type_id")
    return df.join(r, [*ACCOUNT], "left")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_vectors(a.positions(spark, sf_dir))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry-time features with identities, context and outcomes: what folds and models read."""
    names = [n for n in f.ENTRY if n != "amount"]
    keep = [*POSITION, "open_time", "campaign_date", "amount", "profit"]
    rows = f.features(a.positions(spark, sf_dir), names, keep=keep)
    rows = rows.withColumns({"gross_loss_per_lot": loss_per_lot(F.col("profit"), F.col("amount")), "reverse_profit_per_lot": reverse_per_lot(F.col("profit"), F.col("amount"))})
    return previous_day(with_traders(rows, spark, sf_dir), a.daily_bars(spark, sf_dir))
