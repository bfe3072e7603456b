import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.operators import compare, stats
from causeway.operators.buckets import histogram, tail_share
from causeway.operators.forensics import in_step
from causeway.operators.model import choose_threshold, compacted, frontier, threshold_sweep


def test_unique_and_canonical(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, "b")], "k int, closeTime string, close_time string")
    with pytest.raises(ValueError, match="repeat"):
        compare.assert_unique(df, ["k"])
    out = compare.canonical(df, {"close_time": ["closeTime"], "swap": ["Swap"]})
    assert [r["close_time"] for r in out.collect()] == ["a", "b"] and "closeTime" not in out.columns and out.filter("swap IS NOT NULL").count() == 0


def test_tail_with_ties(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 5.0, 5.0, 1.0, 1.0, None]], "v double")
    r = tail_share(df, "v", 0.4).first()
    assert (r["n_top"], r["tail_share"]) == (2, pytest.approx(10 / 17)) and tail_share(df.limit(0), "v").count() == 0


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(1.5,), (20.0,), (None,)], "v double")
    assert {r["bin"]: r["n"] for r in histogram(df, "v", [2, 5, float("inf")], ["2", "5", "more"], 1).collect()} == {"2": 1, "5": 0, "more": 1}


def test_sweep_against_brute_force(spark):
    rows = [(float(s), float(s * 2 - 7)) for s in range(-20, 60)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "score double, y double")
    got = {r["threshold"]: r for r in threshold_sweep(df, "score", "y", (-10.0, 50.0, 61)).collect()}
    for t, r in got.items():
        on = [y for s, y in rows if s is not None and s > t]
        assert r["n"] == len(on) and (not on or r["mean_actual"] == pytest.approx(sum(on) / len(on)))
    sweep = threshold_sweep(df, "score", "y", (-10.0, 50.0, 61))
    assert choose_threshold(sweep, 30) == (29.0, 30, pytest.approx(82.0)) and compacted(sweep).count() == 61
    f = {r["share"]: r["n"] for r in frontier(df, "score", (0.1, 0.5, 1.0), "y").collect()}
    assert f == {0.1: 8, 0.5: 40, 1.0: 80}


def test_sweep_at_the_thresholds_themselves(spark):
    """Scores a bit or two beside a threshold, far off, infinite and NaN (above all), and rows without an outcome: all as SQL compares them."""
    scores = [x for i in range(-100, 501, 7) for x in (float(i), math.nextafter(i, 1e9), math.nextafter(i, -1e9))] + [1e300, -1e300, 5e9, math.inf, -math.inf, math.nan]
    rows = [(s, None if i % 5 == 0 else float(i)) for i, s in enumerate(scores)]
    for grid in ((-100.0, 500.0, 601), (0.0, 0.7, 8)):
        got = threshold_sweep(spark.createDataFrame(rows, "score double, y double"), "score", "y", grid).collect()
        assert len(got) == grid[2]
        for r in got:
            on = [y for s, y in rows if math.isnan(s) or s > r["threshold"]]
            known = [y for y in on if y is not None]
            assert r["n"] == len(on) and r["mean_actual"] == pytest.approx(sum(known) / len(known))


def _ranked_table(df, group, draws, clusters, minutes=5, seed=7):
    """random_in_step as it reads: every account of a campaign is ranked anew for each draw."""
    accounts = df.select("campaign_id", "account_id", group).distinct()
    largest = accounts.filter(F.col(group).isNotNull() & (F.col(group) != -1)).groupBy(group).agg(F.count_distinct("account_id").alias("a")).orderBy(F.desc("a"), group).limit(clusters)
    sizes = accounts.join(largest.select(group), group).groupBy(group, "campaign_id").agg(F.count_distinct("account_id").alias("size"))
    pool = accounts.select("campaign_id", "account_id").distinct().join(sizes, "campaign_id").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = Window.partitionBy(group, "campaign_id", "draw").orderBy(F.xxhash64("account_id", "draw", group, F.lit(seed)), "account_id")
    drawn = pool.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("size")).select("campaign_id", "account_id", F.struct(group, "draw").alias("key"))
    total = lambda rows, key: rows.select(key.alias(group), "n_opens", (F.col("share_in_step") * F.col("n_opens")).alias("s")).groupBy(group).agg((F.sum("s") / F.sum("n_opens")).alias("share"), F.sum("n_opens").alias("n"))
    random = total(in_step(df.select("campaign_id", "account_id", "open_time").join(drawn, ["campaign_id", "account_id"]), "key", minutes), F.col(f"key.{group}"))
    own = total(in_step(df.join(largest.select(group), group), group, minutes), F.col(group))
    return {r[group]: (r["share"], r["n"], r["random"]) for r in own.join(random.select(group, F.col("share").alias("random")), group, "left").collect()}


def test_random_draws_are_those_of_ranked_tables(spark, monkeypatch):
    """Also where accounts, times, groups and campaigns are missing, an account has two groups, or opens repeat; by bands, and by the search that follows if cuts aren't in theirs."""
    rng = random.Random(3)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(20_000))
    rows = [(c, a, None if rng.random() < 0.05 else at(), None if a % 13 == 0 else -1 if a % 11 == 0 else (a + (rng.random() < 0.1)) % 6) for c in (1, 2, None) for a in range(150) for _ in range(rng.randrange(1, 5)) if c != 2 or a % 3]
    rows += [(1, None, at(), 2), (2, None, at(), 4), (2, None, None, 9), (1, 7, rows[0][2], 1), (3, 500, at(), 5), *rows[:20]]
    df = spark.createDataFrame(rows, "campaign_id int, account_id long, open_time timestamp, g int")
    for t in ("timestamp", "timestamp_ntz"):
        own = df.withColumn("open_time", F.col("open_time").cast(t))
        want = _ranked_table(own, "g", 12, 4)
        for band in (compare.BAND, 0.0):
            monkeypatch.setattr(compare, "BAND", band)
            got = {r["g"]: (r["share"], r["n_opens"], r["random_share"]) for r in compare.random_in_step(own, "g", 12, 4).collect()}
            assert got.keys() == want.keys() and len(got) == 4 and all(got[k] == pytest.approx(want[k]) for k in want)
        monkeypatch.undo()


def shuffled(spark):
    """Stage -> the rows that it wrote for a shuffle, of the stages that are still listed."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_draws_are_not_dealt_out(spark):
    """What is shuffled is far less than a row per account, group and draw."""
    n, draws, clusters = 6_000, 100, 3
    df = spark.range(n).select(F.lit(1).alias("campaign_id"), F.col("id").alias("account_id"), F.timestamp_seconds(F.col("id") % 1500).alias("open_time"), (F.col("id") % clusters).cast("int").alias("g"))
    before = shuffled(spark)
    assert compare.random_in_step(df, "g", draws, clusters).count() == clusters
    assert n < sum(x for k, x in shuffled(spark).items() if k not in before) < n * draws * clusters / 4


def test_false_discovery_is_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "test int, p double")
    got = {r["test"]: r["q"] for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got == {0: pytest.approx(0.04), 2: pytest.approx(0.16 / 3), 1: pytest.approx(0.16 / 3), 3: pytest.approx(0.5)}
    assert stats.benjamini_hochberg(df, "p", 8).filter(F.col("test") == 0).first()["q"] == pytest.approx(0.08)


def test_icc_of_one_cluster_is_zero(spark):
    r = stats.icc(spark.createDataFrame([(1.0, "a"), (2.0, "a")], "y double, k string"), "y", F.col("k")).first()
    assert r["icc"] == 0 and r["deff"] == 1


def test_normal_tails(spark):
    """Known values of the normal distribution, both tails."""
    from causeway.functions.exprs import normal_tails

    known = {0.0: 1.0, 1.0: 0.31731050786291415, -1.959963984540054: 0.05, 2.5758293035489004: 0.01, 3.2905267314919255: 0.001, 6.0: 1.973175290075396e-09, 40.0: 0.0}
    df = spark.createDataFrame([(z,) for z in known] + [(None,)], "z double")
    got = {r["z"]: r["p"] for r in df.select("z", normal_tails(F.col("z")).alias("p")).collect()}
    assert got.pop(None) is None and all(abs(got[z] - p) < 1e-13 for z, p in known.items())
