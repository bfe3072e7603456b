"""Causal features of a position from the earlier positions of its account.

A registry says for each feature how it is built and which fields it reads of the row itself and of earlier rows.
"Earlier" is by (open_time, position_id) within (campaign_id, account_id). All windows share that partitioning and
order, and what is folded in Python comes last, over rows as the windows leave them: one shuffle and one sort serve every
feature. Declarations are held against what the plan of a feature reads (`lineage`).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, Settings
from ..functions.exprs import seconds, stop_distance, sure
from .asof import dealt, folded
from .lineage import Reads, reads
from .positions import ACCOUNT, ORDER
from .ranks import quantiles_of


def decay_rows(alpha: float) -> int:
    """Values after which an exponential average of this alpha has forgotten: what lies further back weighs less than 2^-64."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha {alpha} is not in (0, 1]")
    return 1 if alpha == 1 else math.ceil(64 * math.log(2) / -math.log1p(-alpha))


def by_account() -> WindowSpec:
    """(Made when used: a window needs a session.)"""
    return Window.partitionBy(*ACCOUNT).orderBy(*ORDER)


def prev() -> WindowSpec:
    return by_account().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return by_account().rowsBetween(Window.unboundedPreceding, 0)


def last5() -> WindowSpec:
    return by_account().rowsBetween(-5, -1)


def averaged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, start: Column, name: str) -> DataFrame:
    """df with name: the exponential average of the value over the rows before, missing ones passed over; null before the first.

    start: what the first value is averaged with (null: it counts whole). Frames reach as many known values back as the
    decay needs, whatever lies between them.
    """
    known = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(*order).rowsBetween(1 - decay_rows(alpha), 0)
    seen = F.collect_list(value).over(known)
    first = F.coalesce(alpha * F.get(seen, F.lit(0)) + (1 - alpha) * start, F.get(seen, F.lit(0)))
    upto = F.aggregate(F.slice(seen, F.lit(2), F.size(seen)), first, lambda a, x: alpha * x + (1 - alpha) * a)
    own = df.withColumn(name, F.when(F.col(value).isNotNull(), upto))
    return own.withColumn(name, F.last(name, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


#: Fields of a row that are known when it opens, and those known only when it closes.
OPEN_FIELDS = frozenset("campaign_id account_id position_id open_time campaign_date amount open_price side trader_key ip_cluster_id shared_ip ip_cluster_size challenge_type gold_vol_prev_day".split())
STOP_FIELDS = frozenset("sl_price tp_price".split())
CLOSE_FIELDS = frozenset("close_time net_profit profit exit_type close_price commission duration_sec n_fills".split())


@dataclass(frozen=True)
class Feature:
    """build: settings -> column over the prepared rows. own, prior: fields read of the row and of rows before it. frame: the last row offset read. late: it is built of folded columns (and prepared ones), without a window of its own."""

    name: str
    build: Callable[[Settings], Column]
    own: frozenset[str] = frozenset()
    prior: frozenset[str] = frozenset()
    frame: int = -1
    late: bool = False


def prepared(df: DataFrame) -> DataFrame:
    """Running sums that features of a second step need. All of them end in _ and are dropped at the end."""
    net = F.col("net_profit")
    return (
        df.withColumns({
            "ti_": F.row_number().over(by_account()), "cum_": F.sum("net_profit").over(upto()), "cum_prev_": F.coalesce(F.sum("net_profit").over(prev()), F.lit(0.0)), "mean_amt_": F.avg("amount").over(prev()),
            "losses_": F.coalesce(F.sum(sure(net < 0).cast("long")).over(upto()), F.lit(0)), "wins_": F.coalesce(F.sum(sure(net > 0).cast("long")).over(upto()), F.lit(0)),
            "losses_prev_": F.coalesce(F.sum(sure(net < 0).cast("long")).over(prev()), F.lit(0)), "wins_prev_": F.coalesce(F.sum(sure(net > 0).cast("long")).over(prev()), F.lit(0)),
            "prev_net_": F.lag("net_profit").over(by_account()), "prev_side_": F.lag("side").over(by_account()), "prev_amt_": F.lag("amount").over(by_account()), "gap_": F.greatest(F.lit(0.0), seconds(F.col("open_time"), F.lag("close_time").over(by_account()))),
            "dist_": stop_distance(F.col("open_price"), F.col("sl_price")),
        })
        .withColumns({
            "streak_": F.col("losses_prev_") - F.coalesce(F.max(F.when(net >= 0, F.col("losses_"))).over(prev()), F.lit(0)),
            "win_streak_": F.col("wins_prev_") - F.coalesce(F.max(F.when(net <= 0, F.col("wins_"))).over(prev()), F.lit(0)),
            "dd_": F.greatest(F.lit(0.0), F.coalesce(F.max("cum_").over(prev()), F.lit(0.0))) - F.col("cum_prev_"),
        })
        .withColumn("dists_", F.count("dist_").over(prev()))
        .withColumn("before_run_", F.last(F.when(sure(net < 0) & (F.col("streak_") == 0), F.struct(F.col("mean_amt_").alias("m"))), ignorenulls=True).over(prev()))
    )


def _when_seen(value: Column, n: Column, least: int = 3) -> Column:
    return F.when(n >= least, value)


def _f(*names: str) -> frozenset[str]:
    return frozenset(names)


FEATURES: dict[str, Feature] = {
    f.name: f
    for f in (
        Feature("loss_streak", lambda s: F.col("streak_"), prior=_f("net_profit")),
        Feature("win_streak", lambda s: F.col("win_streak_"), prior=_f("net_profit")),
        Feature("pnl_ewm", lambda s: F.col("ewm_"), prior=_f("net_profit"), late=True),
        Feature("lot_zscore", lambda s: F.when((F.count("amount").over(prev()) >= 3) & (F.min("amount").over(prev()) < F.max("amount").over(prev())), (F.col("amount") - F.col("mean_amt_")) / F.stddev_pop("amount").over(prev())), _f("amount"), _f("amount")),
        Feature("amount", lambda s: F.col("amount"), _f("amount")),
        Feature("size_after_loss_delta", lambda s: F.when(F.col("streak_") > 0, F.col("amount") - F.col("before_run_")["m"]), _f("amount"), _f("amount", "net_profit")),
        Feature("has_sl", lambda s: F.col("sl_price").isNotNull(), _f("sl_price")),
        Feature("has_tp", lambda s: F.col("tp_price").isNotNull(), _f("tp_price")),
        Feature("sl_distance_pct", lambda s: F.col("dist_"), _f("sl_price", "open_price")),
        Feature("sl_usage_rate_5", lambda s: _when_seen(F.avg(F.col("sl_price").isNotNull().cast("double")).over(last5()), F.count(F.lit(1)).over(last5())), prior=_f("sl_price")),
        Feature("manual_exit_rate_5", lambda s: _when_seen(F.avg(sure(F.col("exit_type") == "manual").cast("double")).over(last5()), F.count(F.lit(1)).over(last5())), prior=_f("exit_type")),
        Feature("pnl_pct", lambda s: F.col("cum_prev_") / F.lit(s.balance) if s.balance else F.lit(None).cast("double"), prior=_f("net_profit")),
        Feature("dd_from_peak_pct", lambda s: F.col("dd_") / F.lit(s.balance) if s.balance else F.lit(None).cast("double"), prior=_f("net_profit")),
        Feature("cum_pnl_usd", lambda s: F.col("cum_prev_"), prior=_f("net_profit")),
        Feature("dd_from_peak_usd", lambda s: F.col("dd_"), prior=_f("net_profit")),
        Feature("breach_proximity_usd", lambda s: F.lit(s.balance * s.breach_share) - F.col("dd_"), prior=_f("net_profit")),
        Feature("target_proximity_usd", lambda s: F.lit(s.balance * s.target_share) - F.col("cum_prev_"), prior=_f("net_profit")),
        Feature("trade_index", lambda s: F.col("ti_").cast("long")),
        Feature("log_dt_close", lambda s: F.when(F.col("ti_") > 1, F.log1p("gap_")), _f("open_time"), _f("close_time")),
        Feature("entry_gap_sec", lambda s: F.when(F.col("ti_") > 1, F.col("gap_")), _f("open_time"), _f("close_time")),
        Feature("trades_per_hour", lambda s: F.col("ti_") / F.greatest(F.lit(1 / 60), seconds(F.col("open_time"), F.min("open_time").over(upto())) / 3600), _f("open_time"), _f("open_time"), 0),
        Feature("sl_widening_delta", lambda s: _when_seen(F.col("dist_") - F.col("median_"), F.col("dists_")), _f("sl_price", "open_price"), _f("sl_price", "open_price"), late=True),
        Feature("same_direction_reentry", lambda s: sure((F.col("prev_net_") < 0) & (F.col("prev_side_") == F.col("side"))).cast("int"), _f("side"), _f("net_profit", "side")),
        Feature("size_delta_ratio", lambda s: F.when(F.col("prev_amt_") != 0, F.col("amount") / F.col("prev_amt_")), _f("amount"), _f("amount")),
    )
}
#: What may be computed when a position opens: nothing here reads stops, take-profits or the close of the row itself.
ENTRY = tuple(n for n, f in FEATURES.items() if not f.own & (STOP_FIELDS | CLOSE_FIELDS))


#: Every window reads these of its row: they say which rows are earlier.
KEYS = frozenset((*ACCOUNT, *ORDER))
#: What the columns made in Python read.
VOUCHED = {"median_": Reads(prior=frozenset(("sl_price", "open_price"))), "ewm_": Reads(prior=frozenset(("net_profit",)))}


def lint(features: Sequence[Feature], settings: Settings = DEFAULT, schema: StructType | None = None) -> None:
    """Refuses features that look at the row's own close or past the row, by what they declare; and with a schema of positions also by what their plans read, or that read more than they declare."""
    for f in features:
        if f.own & CLOSE_FIELDS:
            raise ValueError(f"{f.name} reads {sorted(f.own & CLOSE_FIELDS)} of the row itself, which are known only when it closes")
        if f.frame > 0 or (f.frame == 0 and f.prior & CLOSE_FIELDS):
            raise ValueError(f"{f.name} reads rows that aren't earlier")
    if schema is not None:
        _traced(tuple(features), settings, schema.json())


@lru_cache(maxsize=64)
def _traced(features: tuple[Feature, ...], settings: Settings, schema: str) -> None:
    spark = SparkSession.active()
    rows = spark.createDataFrame([], StructType.fromJson(json.loads(schema)))
    found = reads(_built(rows, features, settings, ()), VOUCHED)
    for f in features:
        r = found[f.name]
        if bad := r.own & CLOSE_FIELDS:
            raise ValueError(f"{f.name} reads {sorted(bad)} of the row itself, which are known only when it closes")
        if r.any:
            raise ValueError(f"{f.name} reads {sorted(r.any)} of rows that aren't earlier")
        if more := (r.own - f.own - KEYS) | (r.prior - f.prior - f.own - KEYS):
            raise ValueError(f"{f.name} doesn't declare that it reads {sorted(more)}")


def _built(df: DataFrame, chosen: Sequence[Feature], settings: Settings, keep: Sequence[str]) -> DataFrame:
    made = [f for f in chosen if f.name not in keep]
    late = {f.name for f in made if f.late}
    if not late:
        return prepared(df).select(*keep, *[f.build(settings).alias(f.name) for f in made])
    medians = {"median_": "dist_"} if "sl_widening_delta" in late else {}
    averages = {"ewm_": ("net_profit", settings.ewm_alpha, 0.0)} if "pnl_ewm" in late else {}
    early = [f.build(settings).alias(f.name) for f in made if not f.late]
    held = list(dict.fromkeys([*keep, *ACCOUNT, *ORDER, "net_profit"]))
    rows = prepared(dealt(df)).select(*[F.col(c).alias(f"{c}_0") for c in keep], *[c for c in held if c not in keep or c in (*ACCOUNT, *ORDER, "net_profit")], "dist_", "dists_", *[c.alias(f"{f.name}_1") for c, f in zip(early, [f for f in made if not f.late], strict=True)])
    out = folded(rows, medians, averages)
    return out.select(*[F.col(f"{c}_0").alias(c) for c in keep], *[f.build(settings).alias(f.name) if f.late else F.col(f"{f.name}_1").alias(f.name) for f in made])


def features(df: DataFrame, names: Sequence[str] | None = None, settings: Settings = DEFAULT, keep: Sequence[str] = (*ACCOUNT, "position_id")) -> DataFrame:
    """keep and the named features (all by default), one row per position. Null inputs give null features, or false flags. Features whose plans read what isn't known yet are refused."""
    chosen = [FEATURES[n] for n in (names or FEATURES)]
    lint(chosen, settings, df.schema)
    return _built(df, chosen, settings, keep)


def clip_of(entry_gaps: DataFrame, share: float = 0.99) -> float | None:
    """The fitted clip of entry_gap_sec."""
    found = quantiles_of(entry_gaps, "entry_gap_sec", [share])
    return found[0] if found else None


def overlap_histogram(df: DataFrame) -> DataFrame:
    """By how many of the last five positions were still open: open_of_5, n. Shows how much the two readings can differ."""
    last = F.collect_list("close_time").over(last5())
    still = F.size(F.filter(last, lambda c: c >= F.col("open_time")))
    return df.select(still.cast("long").alias("open_of_5"), F.count(F.lit(1)).over(last5()).alias("n_")).filter("n_ > 0").groupBy("open_of_5").agg(F.count(F.lit(1)).alias("n"))
