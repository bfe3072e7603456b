"""Planted leaks are told by their class; the library's own features have none."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import features as f
from causeway.operators import rebuild
from causeway.plans import adapters as a


def leaky(df):
    """Features with three leaks beside two clean ones."""
    w = Window.partitionBy("campaign_id", "account_id").orderBy("open_time", "position_id")
    return df.select(
        "campaign_id", "account_id", "position_id", "amount", F.lag("amount").over(w).alias("before"), (F.col("net_profit") > 0).alias("peeks"), F.lead("amount").over(w).alias("ahead"), F.lag("net_profit").over(w).alias("trusts"),
    )


def test_planted_leaks_are_reported_by_class(spark, sf):
    p = a.positions(spark, sf).withColumn("account_id", F.col("account_id") % 8)
    got = {(r["field_class"], r["feature"]): r for r in rebuild.prefix_rebuild(p, leaky, 40).collect()}
    assert all(r["checked"] == 40 for r in got.values()) and len(got) == 15
    wrong = {k for k, r in got.items() if r["mismatches"]}
    # the third class also leaves later rows away
    assert wrong == {(rebuild.OWN_CLOSE, "peeks"), (rebuild.LATER_ROWS, "ahead"), (rebuild.OPEN_OUTCOMES, "ahead"), (rebuild.OPEN_OUTCOMES, "trusts")}
    assert got[rebuild.OWN_CLOSE, "peeks"]["missingness_mismatches"] == 40 and got[rebuild.LATER_ROWS, "ahead"]["missingness_mismatches"] > 30


def test_own_features_have_no_leak(spark, sf):
    p = a.positions(spark, sf).withColumn("account_id", F.col("account_id") % 8)
    rows = rebuild.prefix_rebuild(p, sample=24).collect()
    wrong = {(r["field_class"], r["feature"]) for r in rows if r["mismatches"] and r["max_magnitude"] > 1e-9}
    assert {c for c, _ in wrong} <= {rebuild.OPEN_OUTCOMES} and {n for _, n in wrong} <= {n for n, x in f.FEATURES.items() if x.prior & f.CLOSE_FIELDS}
    assert rebuild.prefix_rebuild(p.limit(0)).count() == 0
