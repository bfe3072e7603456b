"""Audit of causality on sampled rows: each is rebuilt from what it may know, and differences are told by the class of fields that made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .features import CLOSE_FIELDS, features
from .positions import ACCOUNT, ORDER

OWN_CLOSE, LATER_ROWS, OPEN_OUTCOMES = "own close", "later rows", "outcomes to come"
#: What is taken away for each class: the close of the row itself; rows that opened after it; closes of earlier rows that hadn't happened when it opened.
CLASSES = (OWN_CLOSE, LATER_ROWS, OPEN_OUTCOMES)


def prefix_rebuild(df: DataFrame, build: Callable[[DataFrame], DataFrame] = features, sample: int = 64, seed: int = 7) -> DataFrame:
    """field_class, feature, checked, mismatches, missingness_mismatches, max_magnitude over `sample` rows picked by a hash (the sample is the feature here).

    build: positions -> keys (campaign_id, account_id, position_id) and features. Every sampled row's account is built anew
    three times, each without one class of fields; all copies are accounts of their own in one call of build. A feature that
    reads a class differs there: the first two must show none, the third shows where the plain reading of outcomes differs
    from the strict one. Positions must be unique by id and have an account.
    """
    cases = df.filter(F.col("account_id").isNotNull()).select(*ACCOUNT, F.col("open_time").alias("at_"), F.col("position_id").alias("case_")).orderBy(F.xxhash64("position_id", F.lit(seed)), "position_id").limit(sample)
    cases = F.broadcast(written(cases, "cases"))  # as many rows as are sampled
    near = df.join(cases, list(ACCOUNT)).withColumn("class_", F.explode(F.array(*[F.lit(i) for i in range(len(CLASSES))])))
    upto = F.struct(*ORDER) <= F.struct("at_", "case_")
    own, unknown = F.col("position_id") == F.col("case_"), ~F.coalesce(F.col("close_time") < F.col("at_"), F.lit(False))
    near = near.filter((F.col("class_") == CLASSES.index(OWN_CLOSE)) | upto)
    blank = ((F.col("class_") == CLASSES.index(OWN_CLOSE)) & own) | ((F.col("class_") == CLASSES.index(OPEN_OUTCOMES)) & ~own & unknown)
    account = (F.col("case_") * len(CLASSES) + F.col("class_")).cast(df.schema["account_id"].dataType)
    copies = near.select(*[account.alias(c) if c == "account_id" else F.when(~blank, F.col(c)).alias(c) if c in CLOSE_FIELDS else F.col(c) for c in df.columns])
    whole = build(df)
    names = [c for c in whole.columns if c not in (*ACCOUNT, "position_id")]
    whole = whole.join(cases.select(F.col("case_").alias("position_id")), "position_id").select("position_id", *[F.col(n).alias(f"{n}_whole") for n in names])
    again = written(build(copies), "copies")
    number = F.col("account_id").cast("long")
    again = again.filter(F.floor(number / len(CLASSES)) == F.col("position_id")).withColumn("class_", F.pmod(number, F.lit(len(CLASSES))).cast("int"))
    both = again.join(whole, "position_id")
    told = F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("feature"), (~F.col(n).eqNullSafe(F.col(f"{n}_whole"))).alias("differs"), (F.col(n).isNull() != F.col(f"{n}_whole").isNull()).alias("missing"),
            F.abs(F.col(n).try_cast("double") - F.col(f"{n}_whole").try_cast("double")).alias("size"),
        )
        for n in names
    ]))
    rows = both.select(F.element_at(F.array(*map(F.lit, CLASSES)), F.col("class_") + 1).alias("field_class"), told.alias("t")).select("field_class", "t.*")
    return rows.groupBy("field_class", "feature").agg(F.count(F.lit(1)).alias("checked"), F.count_if("differs").alias("mismatches"), F.count_if("missing").alias("missingness_mismatches"), F.coalesce(F.max(F.when(F.col("differs"), F.col("size"))), F.lit(0.0)).alias("max_magnitude"))
