"""What columns read, told from plans; features that read too much or declare too little."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import features as f
from causeway.operators.lineage import Reads, reads, refuse
from causeway.plans import adapters as a

SCHEMA = "campaign_id int, account_id long, position_id long, open_time timestamp_ntz, close_time timestamp_ntz, amount double, net_profit double, side string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([], SCHEMA)


def test_windows_tell_own_earlier_and_later_rows(rows):
    w = Window.partitionBy("account_id").orderBy("open_time")
    before, upto, after = (w.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0, 1))
    out = rows.select(
        (F.col("amount") + 1).alias("own"), F.sum("net_profit").over(before).alias("before"), F.sum("net_profit").over(upto).alias("upto"), F.max("net_profit").over(after).alias("after"), F.lag("close_time").over(w).alias("lag"), F.lag("net_profit", 3).over(w).alias("lag3"),
        F.lead("net_profit").over(w).alias("lead"), F.row_number().over(w).alias("number"), F.avg("net_profit").over(Window.partitionBy("account_id")).alias("whole"), F.last(F.when(F.col("net_profit") > 0, F.col("amount")), ignorenulls=True).over(before).alias("last"),
    )
    found = reads(out)
    keys = {"account_id", "open_time"}
    assert found["own"] == Reads(frozenset(["amount"]))
    assert found["before"].own == keys and found["before"].prior == {"net_profit"} and not found["before"].any
    assert found["upto"].own == keys | {"net_profit"} and found["lag"].prior == {"close_time"} and found["lag3"].prior == {"net_profit"} and found["number"].own == keys
    assert all(found[c].any == {"net_profit"} for c in ("after", "lead", "whole")) and found["last"].prior == {"net_profit", "amount"}


def test_reads_are_followed_through_steps_joins_and_subqueries(spark, rows):
    w = Window.partitionBy("account_id").orderBy("open_time")
    step = rows.withColumn("x", F.col("net_profit") * 2).withColumn("cum", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = step.withColumn("less", F.col("cum") - F.col("x")).withColumn("prior", F.lag("cum").over(w)).withColumn("part", F.explode(F.array("x")))
    found = reads(out.select("less", "prior", "part"))
    assert "net_profit" in found["less"].own and found["prior"].prior >= {"net_profit"} and "net_profit" not in found["prior"].own and found["part"].own == {"net_profit"}
    mean = rows.groupBy("account_id").agg(F.avg("net_profit").alias("m"))
    assert reads(rows.join(mean, "account_id").select("m"))["m"].any == {"net_profit"}
    rows.createOrReplaceTempView("rows_of_test")
    assert "net_profit" in reads(spark.sql("SELECT amount - (SELECT max(net_profit) FROM rows_of_test) AS s FROM rows_of_test"))["s"].any
    with pytest.raises(ValueError, match="known only later"):
        refuse(out, ["less"], f.CLOSE_FIELDS)
    refuse(out, ["prior", "amount"], f.CLOSE_FIELDS)


def test_what_cannot_be_followed_is_refused(rows):
    hidden = rows.select("amount").mapInArrow(lambda b: b, "amount double, made double")
    assert reads(hidden.select("amount"))["amount"].own == {"amount"}
    with pytest.raises(ValueError, match="vouches"):
        reads(hidden)
    assert reads(hidden, {"made": Reads(prior=frozenset(["amount"]))})["made"].prior == {"amount"}
    with pytest.raises(ValueError, match="followed"):
        reads(rows.union(rows))


def test_false_declarations_raise(spark, sf, monkeypatch):
    p = a.positions(spark, sf)
    lies = {
        "peeks": f.Feature("peeks", lambda s: F.col("net_profit") > 0, frozenset(["amount"])), "hides": f.Feature("hides", lambda s: F.col("cum_") - F.col("cum_prev_"), prior=frozenset(["net_profit"])),
        "ahead": f.Feature("ahead", lambda s: F.lead("amount").over(f.by_account()), prior=frozenset(["amount"])), "quiet": f.Feature("quiet", lambda s: F.col("amount") * F.length("side"), frozenset(["amount"])), "silent": f.Feature("silent", lambda s: F.lag("net_profit").over(f.by_account())),
    }
    for name, said in (("peeks", "net_profit"), ("hides", "net_profit"), ("ahead", "aren't earlier"), ("quiet", "side"), ("silent", "net_profit")):
        monkeypatch.setitem(f.FEATURES, name, lies[name])
        with pytest.raises(ValueError, match=said):
            f.features(p, ["amount", name])
    assert f.features(p, ["loss_streak", "pnl_ewm", "sl_widening_delta"]).columns[-3:] == ["loss_streak", "pnl_ewm", "sl_widening_delta"]


def test_all_features_take_one_shuffle_and_one_sort(spark, sf):
    plan = f.features(a.positions(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
