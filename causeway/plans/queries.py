"""Queries over the adapters, and what each is in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.exprs import account_cluster, challenge, era, exit_type, ip_cluster, loss_per_lot, net_or_parts, normal_tails, number, reverse_per_lot, seconds, sure, trader_cluster
from ..operators import asof, bootstrap, buckets, compare, folds, forensics, history, model, nested, positions, predict, rebuild, state, stats
from ..operators import conditions as cond
from ..operators import features as f
from ..storage import written
from . import adapters as a
from .tables import POSITION, model_rows, states, with_traders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FLAGGED = [(1, 57), (2, 59), (3, 61), (21, 58), (31, 63), (-1, 64), (12, 60)]
CORRELATED = ("loss_streak", "win_streak", "pnl_ewm", "cum_pnl_usd", "dd_from_peak_usd", "trade_index", "trades_per_hour", "amount")


#: Far below the last place kept.
TRIFLE = 3.1e-10


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles as both engines can agree on them: cents make exact halves at the last place, so a trifle is added before rounding; no negative zero is left."""
    return df.select(*[(F.round(F.col(c) + F.lit(TRIFLE), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name. sql: a query whose double columns are rounded here as in rounded()."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = f"WITH {sql[0].strip()} SELECT {sql[1].strip()}" if isinstance(sql, tuple) else sql
        return fn

    return add


def r(*columns: str) -> str:
    """Rounded columns of a SELECT list; `name = expression`, or a name alone."""
    out = []
    for c in columns:
        name, _, expr = (x.strip() for x in c.partition("="))
        out.append(f"round(({expr or name}) + {TRIFLE}, 6) + 0.0 AS {name}")
    return ", ".join(out)


PART = "PARTITION BY campaign_id, account_id ORDER BY open_time, position_id"
UPTO, PREV, LAST5 = (f"OVER ({PART} ROWS BETWEEN {x})" for x in ("UNBOUNDED PRECEDING AND CURRENT ROW", "UNBOUNDED PRECEDING AND 1 PRECEDING", "5 PRECEDING AND 1 PRECEDING"))
SECS = "(epoch_us({}) - epoch_us({})) / 1e6"

PREPARED = f"""
    p1 AS (SELECT *, row_number() OVER ({PART}) AS ti, sum(net_profit) {UPTO} AS cum, coalesce(sum(net_profit) {PREV}, 0) AS cum_prev, avg(amount) {PREV} AS mean_amt,
        count(*) FILTER (net_profit < 0) {UPTO} AS losses, count(*) FILTER (net_profit > 0) {UPTO} AS wins, lag(net_profit) OVER ({PART}) AS prev_net, lag(side) OVER ({PART}) AS prev_side,
        lag(amount) OVER ({PART}) AS prev_amt, lag(exit_type) OVER ({PART}) AS prev_exit, {SECS.format("open_time", f"lag(close_time) OVER ({PART})")} AS raw_gap, abs(open_price - sl_price) / open_price AS dist FROM positions),
    p2 AS (SELECT *, losses - CAST(net_profit < 0 AS INT) - coalesce(max(CASE WHEN net_profit >= 0 THEN losses END) {PREV}, 0) AS loss_streak,
        wins - CAST(net_profit > 0 AS INT) - coalesce(max(CASE WHEN net_profit <= 0 THEN wins END) {PREV}, 0) AS win_streak, greatest(0, coalesce(max(cum) {PREV}, 0)) - cum_prev AS dd FROM p1),
    p3 AS (SELECT *, last_value(CASE WHEN net_profit < 0 AND loss_streak = 0 THEN {{'m': mean_amt}} END IGNORE NULLS) {PREV} AS before_run FROM p2)"""
FEATURE = {
    "loss_streak": "CAST(loss_streak AS BIGINT)", "win_streak": "CAST(win_streak AS BIGINT)", "pnl_ewm": f"coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(net_profit) {PREV}), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 0.0)",
    "lot_zscore": f"CASE WHEN count(amount) {PREV} >= 3 AND min(amount) {PREV} < max(amount) {PREV} THEN (amount - mean_amt) / stddev_pop(amount) {PREV} END",
    "amount": "amount", "size_after_loss_delta": "CASE WHEN loss_streak > 0 THEN amount - before_run.m END", "has_sl": "sl_price IS NOT NULL", "has_tp": "tp_price IS NOT NULL", "sl_distance_pct": "dist",
    "sl_usage_rate_5": f"CASE WHEN count(*) {LAST5} >= 3 THEN avg(CAST(sl_price IS NOT NULL AS INT)) {LAST5} END", "manual_exit_rate_5": f"CASE WHEN count(*) {LAST5} >= 3 THEN avg(CAST(exit_type = 'manual' AS INT)) {LAST5} END",
    "pnl_pct": "cum_prev / 10000", "dd_from_peak_pct": "dd / 10000", "cum_pnl_usd": "cum_prev", "dd_from_peak_usd": "dd", "breach_proximity_usd": "400 - dd", "target_proximity_usd": "800 - cum_prev", "trade_index": "ti",
    "log_dt_close": "CASE WHEN ti > 1 THEN ln(1 + greatest(0, raw_gap)) END", "entry_gap_sec": "CASE WHEN ti > 1 THEN greatest(0, raw_gap) END",
    "trades_per_hour": f"ti / greatest(1 / 60.0::DOUBLE, {SECS.format('open_time', f'min(open_time) {UPTO}')} / 3600)", "sl_widening_delta": f"CASE WHEN count(dist) {PREV} >= 3 THEN dist - quantile_cont(dist, 0.5) {PREV} END",
    "same_direction_reentry": "CAST(coalesce(prev_net < 0 AND prev_side = side, FALSE) AS INTEGER)", "size_delta_ratio": "CASE WHEN prev_amt <> 0 THEN amount / prev_amt END",
}
WHOLE = {"loss_streak", "win_streak", "has_sl", "has_tp", "trade_index", "same_direction_reentry"}
FEATURES = f"features AS (SELECT *, {', '.join(f'{e} AS f_{n}' for n, e in FEATURE.items())} FROM p3)"
BASE = f"{a.POSITIONS}, {PREPARED}, {FEATURES}"
STATE = f"""{BASE},
    grid0 AS (SELECT position_id AS gid, campaign_id, account_id, open_time, position_id, coalesce(side = lag(side) OVER w AND side = lag(side, 2) OVER w AND {SECS.format("open_time", "lag(open_time, 2) OVER w")} <= 30
        AND CASE WHEN side = 'BUY' THEN open_price <= lag(open_price) OVER w AND lag(open_price) OVER w <= lag(open_price, 2) OVER w ELSE open_price >= lag(open_price) OVER w AND lag(open_price) OVER w >= lag(open_price, 2) OVER w END, FALSE) AS hit
        FROM positions WINDOW w AS ({PART})),
    grid AS (SELECT gid, max(hit) OVER ({PART} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS grid_flag FROM grid0),
    st0 AS (SELECT f.*, g.grid_flag, {SECS.format("open_time", "min(open_time) OVER (PARTITION BY campaign_id, account_id)")} / 3600 AS hrs_elapsed,
        {SECS.format("max(close_time) OVER (PARTITION BY campaign_id, account_id)", "min(open_time) OVER (PARTITION BY campaign_id, account_id)")} / 3600 AS span, count(*) OVER (PARTITION BY campaign_id, account_id) - ti AS trades_remaining_est,
        CASE WHEN ti > 1 THEN greatest(max(amount) {PREV}, amount) / least(min(amount) {PREV}, amount) END AS atlsr_ratio_if_filled, -profit / amount AS gross_loss_per_lot FROM features f JOIN grid g ON gid = position_id),
    st AS (SELECT *, CASE WHEN span > 0 THEN least(1.0, hrs_elapsed / span) END AS session_pct, amount / mean_amt AS lot_ratio_vs_avg, coalesce(prev_net < 0 AND raw_gap <= 60, FALSE) AS fast_reentry_after_loss,
        coalesce(prev_exit = 'sl_hit' AND prev_side = side, FALSE) AS same_side_after_sl, f_has_sl AS has_sl, f_pnl_pct AS pnl_pct, f_dd_from_peak_pct AS dd_from_peak_pct, gross_loss_per_lot - 7 AS reverse_profit_per_lot FROM st0)"""
EDGE = "edge AS (SELECT list_sort(list_distinct(quantile_cont(amount, [0.0, 0.25, 0.5, 0.75, 1.0])))[2] AS small FROM positions WHERE campaign_id NOT IN (41, 66) AND campaign_id >= 53)"
MATCHED = f"""{STATE}, {EDGE}, matched AS (SELECT st.*, unnest(list_filter([
        'baseline (all trades)', CASE WHEN NOT has_sl THEN 'no SL set' END, CASE WHEN loss_streak >= 2 THEN 'loss_streak >= 2' END, CASE WHEN loss_streak >= 2 AND amount <= small THEN 'loss_streak>=2 AND small_size_flag' END,
        CASE WHEN loss_streak >= 3 THEN 'loss_streak >= 3' END, CASE WHEN same_side_after_sl THEN 'same side after SL hit' END, CASE WHEN fast_reentry_after_loss THEN 'fast re-entry after loss (<=60s)' END,
        CASE WHEN lot_ratio_vs_avg > 1.5 THEN 'size escalation (lot_ratio > 1.5)' END, CASE WHEN lot_ratio_vs_avg > 2.0 THEN 'near rule-B cliff (lot_ratio > 2.0)' END, CASE WHEN dd_from_peak_pct > 0.02 THEN 'deep drawdown (dd > 2%)' END,
        CASE WHEN session_pct > 0.75 THEN 'late session (session_pct > 0.75)' END, CASE WHEN session_pct > 0.75 AND pnl_pct < 0 THEN 'late + underwater' END, CASE WHEN grid_flag THEN 'grid-flagged' END], lambda x: x IS NOT NULL)) AS condition
    FROM st, edge WHERE campaign_id NOT IN (41, 66) AND campaign_id >= 53)"""


def _primary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    s = states(spark, sf_dir)
    return s.filter(era(F.col("campaign_id"), "primary")), cond.conditions(cond.small_size_edge(a.positions(spark, sf_dir)))


@query((MATCHED, f"""condition, count(*) AS n_trades, count(DISTINCT (campaign_id, account_id)) AS n_accounts, count(DISTINCT campaign_id) AS n_campaigns, {r('mean_loss_per_lot = avg(gross_loss_per_lot)')},
    coalesce(avg(gross_loss_per_lot) > 7, FALSE) AS clears_hurdle, {r('mean_reverse = avg(reverse_profit_per_lot)', 'median_reverse = quantile_cont(reverse_profit_per_lot, 0.5)')} FROM matched GROUP BY condition"""))  # fmt: skip
def condition_table(spark, sf_dir):
    """The headline table: outcomes given each condition, over the primary era."""
    return cond.condition_table(*_primary(spark, sf_dir))


@query((f"{MATCHED}, m AS (SELECT condition, campaign_id, count(*) AS n, avg(gross_loss_per_lot) AS m FROM matched GROUP BY ALL HAVING count(*) >= 10)", f"condition, count(*) AS campaigns, {r('share_clearing = avg(CAST(m > 7 AS INT))', 'median_mean = quantile_cont(m, 0.5)')} FROM m GROUP BY condition"))
def within_campaigns(spark, sf_dir):
    return cond.within_campaigns(*_primary(spark, sf_dir))


@query((f"{a.POSITIONS}, {EDGE}", f"{r('small_size_edge = small')} FROM edge"))
def small_size_edge(spark, sf_dir):
    return spark.createDataFrame([(cond.small_size_edge(a.positions(spark, sf_dir)),)], "small_size_edge double")


@query((BASE, f"campaign_id, account_id, position_id, {', '.join(f'f_{n} AS {n}' if n in WHOLE else r(f'{n} = f_{n}') for n in FEATURE)} FROM features"))
def state_features(spark, sf_dir):
    """Every feature of the registry for every position."""
    return f.features(a.positions(spark, sf_dir))


@query((BASE, f"campaign_id, account_id, position_id, {', '.join(f'f_{n} AS {n}' if n in WHOLE else r(f'{n} = f_{n}') for n in f.ENTRY)} FROM features"))
def entry_features(spark, sf_dir):
    """The subset that reads nothing of the row but what is known when it opens."""
    return f.features(a.positions(spark, sf_dir), f.ENTRY)


STATE_COLUMNS = ("loss_streak", "win_streak", "trade_index", "cum_pnl_usd", "pnl_pct", "dd_from_peak_pct", "dist_to_target", "dist_to_dd_limit", "hrs_elapsed", "hrs_remaining_24h", "session_pct", "trades_remaining_est", "lot_ratio_vs_avg",
                 "atlsr_ratio_if_filled", "rule_b_breach_if_filled", "dt_since_last_close_s", "fast_reentry_after_loss", "same_side_after_sl", "grid_flag", "gross_loss_per_lot", "reverse_profit_per_lot", "clears_hurdle")


@query((STATE, f"""campaign_id, account_id, position_id, f_loss_streak AS loss_streak, f_win_streak AS win_streak, ti AS trade_index, {r('cum_pnl_usd = cum_prev', 'pnl_pct', 'dd_from_peak_pct', 'dist_to_target = 0.08::DOUBLE - cum_prev / 10000',
    'dist_to_dd_limit = 0.04::DOUBLE - dd / 10000', 'hrs_elapsed', 'hrs_remaining_24h = greatest(0, 24 - hrs_elapsed)', 'session_pct')}, trades_remaining_est, {r('lot_ratio_vs_avg', 'atlsr_ratio_if_filled')},
    coalesce(atlsr_ratio_if_filled > 2.5, FALSE) AS rule_b_breach_if_filled, {r('dt_since_last_close_s = raw_gap')}, fast_reentry_after_loss, same_side_after_sl, grid_flag, {r('gross_loss_per_lot', 'reverse_profit_per_lot')}, coalesce(gross_loss_per_lot > 7, FALSE) AS clears_hurdle FROM st"""))  # fmt: skip
def state_vectors(spark, sf_dir):
    return states(spark, sf_dir).select("campaign_id", "account_id", "position_id", *STATE_COLUMNS)


@query((f"RECURSIVE {a.POSITIONS}, o AS (SELECT *, row_number() OVER ({PART}) AS ti FROM positions), fold AS (SELECT campaign_id, account_id, position_id, ti, open_time AS anchor, close_time, side, 1::BIGINT AS idea FROM o WHERE ti = 1 UNION ALL "
        "SELECT o.campaign_id, o.account_id, o.position_id, o.ti, CASE WHEN ok THEN anchor ELSE o.open_time END, o.close_time, o.side, CASE WHEN ok THEN idea ELSE idea + 1 END FROM (SELECT o.*, f.anchor, f.idea, "
        f"{SECS.format('o.open_time', 'f.anchor')} <= 180 AND o.side = f.side AND {SECS.format('o.open_time', 'f.close_time')} <= 180 AS ok FROM o JOIN fold f ON o.campaign_id = f.campaign_id AND o.account_id = f.account_id AND o.ti = f.ti + 1) o)",
        "campaign_id, account_id, position_id, idea AS idea_id FROM fold"))
def trade_ideas(spark, sf_dir):
    return state.ideas(a.positions(spark, sf_dir))


STRICT = f"""{a.POSITIONS}, j AS (SELECT p.campaign_id, p.account_id, p.position_id, p.open_time, p.amount, p.side,
        coalesce(list({{'o': q.open_time, 'c': q.close_time, 'n': q.net_profit, 'a': q.amount, 's': q.side, 'sl': CAST(q.sl_price IS NOT NULL AS INT), 'm': CAST(q.exit_type = 'manual' AS INT)}} ORDER BY q.open_time, q.position_id) FILTER (q.position_id IS NOT NULL), []) AS h
        FROM positions p LEFT JOIN positions q ON p.campaign_id = q.campaign_id AND p.account_id = q.account_id AND q.open_time < p.open_time GROUP BY ALL),
    k AS (SELECT *, list_filter(h, lambda x: x.c < open_time) AS k FROM j),
    l AS (SELECT *, list_transform(k, lambda x: x.n) AS nets, list_transform(h, lambda x: x.a) AS amounts, list_slice(k, -5, -1) AS last5 FROM k),
    m AS (SELECT *, CAST(list_reduce(list_prepend(0.0::DOUBLE, nets), lambda a, x: CASE WHEN x < 0 THEN a + 1 ELSE 0 END) AS BIGINT) AS losses, CAST(list_reduce(list_prepend(0.0::DOUBLE, nets), lambda a, x: CASE WHEN x > 0 THEN a + 1 ELSE 0 END) AS BIGINT) AS wins, coalesce(list_sum(nets), 0) AS total,
        coalesce(greatest(0, list_max(list_transform(range(1, len(nets) + 1), lambda i: list_sum(list_slice(nets, 1, i))))), 0) AS top FROM l)"""


@query((STRICT, f"""campaign_id, account_id, position_id, len(h) AS prior_opened, len(k) AS prior_closed, losses AS loss_streak_strict, wins AS win_streak_strict, {r('cum_pnl_strict = total', 'dd_from_peak_strict = top - total',
    'pnl_ewm_strict = list_reduce(list_prepend(0.0::DOUBLE, nets), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)', "lot_zscore_strict = CASE WHEN len(h) >= 3 AND list_min(amounts) < list_max(amounts) THEN (amount - list_avg(amounts)) / list_aggregate(amounts, 'stddev_pop') END",
    'size_after_loss_delta_strict = CASE WHEN losses > 0 THEN amount - list_avg(list_transform(list_filter(h, lambda x: x.o < k[len(k) - losses + 1].o), lambda x: x.a)) END',
    'sl_usage_rate_5_strict = CASE WHEN len(k) >= 3 THEN list_avg(list_transform(last5, lambda x: x.sl)) END', 'manual_exit_rate_5_strict = CASE WHEN len(k) >= 3 THEN list_avg(list_transform(last5, lambda x: x.m)) END')}, len(h) + 1 AS trade_index_strict,
    {r('log_dt_close_strict = CASE WHEN len(k) > 0 THEN ln(1 + greatest(0, ' + SECS.format('open_time', 'k[len(k)].c') + ')) END', 'trades_per_hour_strict = (len(h) + 1) / CASE WHEN len(h) > 0 THEN greatest(1 / 60.0::DOUBLE, ' + SECS.format('open_time', 'h[1].o') + ' / 3600) ELSE 1 / 60.0::DOUBLE END')},
    CAST(coalesce(k[len(k)].n < 0 AND h[len(h)].s = side, FALSE) AS INTEGER) AS same_direction_reentry_strict, {r('size_delta_ratio_strict = amount / nullif(h[len(h)].a, 0)')} FROM m"""))  # fmt: skip
def strict_features(spark, sf_dir):
    """Features under the strict reading: outcomes only of what had closed before."""
    return asof.strict_features(a.positions(spark, sf_dir))


@query((f"{a.POSITIONS}, h AS (SELECT open_time, list(close_time) {LAST5} AS l FROM positions)", "CAST(len(list_filter(l, lambda c: c >= open_time)) AS BIGINT) AS open_of_5, count(*) AS n FROM h WHERE l IS NOT NULL GROUP BY 1"))
def overlap_histogram(spark, sf_dir):
    return f.overlap_histogram(a.positions(spark, sf_dir))


@query((a.FILLS, f"""campaign_id, position_id, arg_min(account_id, ord) AS account_id, arg_min(open_time, ord) AS open_time, {r('open_price = arg_min(open_price, ord)')}, arg_min(side, ord) AS side,
    {r('sl_price = arg_min(sl_price, ord)', 'tp_price = arg_min(tp_price, ord)')}, max(close_time) AS close_time, {r('amount = sum(amount)', 'profit = sum(profit)', 'commission = sum(commission)')}, count(*) AS n_fills,
    {r('close_price = sum(close_price * amount) / sum(amount)', 'duration_sec = ' + SECS.format('max(close_time)', 'arg_min(open_time, ord)'))} FROM fills GROUP BY campaign_id, position_id"""))  # fmt: skip
def position_collapse(spark, sf_dir):
    """Fills to positions."""
    return positions.to_positions(a.fills(spark, sf_dir))


@query((f"{a.FILLS}, g AS (SELECT campaign_id, position_id, arg_min({{'v': sl_price}}, ord).v AS literal_first, arg_min(sl_price, ord) AS first_known, arg_max(sl_price, ord) AS last_known FROM fills GROUP BY ALL)", f"campaign_id, position_id, {r('literal_first', 'first_known', 'last_known')}, literal_first IS NULL AND first_known IS NOT NULL AS leaks, coalesce(first_known <> last_known, FALSE) AS changed FROM g"))
def first_fill_audit(spark, sf_dir):
    """Where the first known stop isn't that of the first fill."""
    return positions.first_fill_audit(a.fills(spark, sf_dir), "sl_price")


@query((f"{a.FILLS}, g AS (SELECT position_id, campaign_id, sum(close_price * amount) / sum(amount) AS c, arg_min(sl_price, ord) AS s, arg_min(tp_price, ord) AS t, max(profit) AS profit, sum(commission) AS commission FROM fills GROUP BY ALL)", f"campaign_id, position_id, CASE WHEN abs(c - s) <= 1 THEN 'sl_hit' WHEN abs(c - t) <= 1 THEN 'tp_hit' ELSE 'manual' END AS exit_type, {r('net = profit + commission')} FROM g"))
def exit_types(spark, sf_dir):
    p = positions.to_positions(a.fills(spark, sf_dir))
    largest = a.fills(spark, sf_dir).groupBy("campaign_id", "position_id").agg(F.max("profit").alias("p"))
    j = p.join(largest, ["campaign_id", "position_id"])
    return j.select("campaign_id", "position_id", exit_type(F.col("close_price"), F.col("sl_price"), F.col("tp_price")).alias("exit_type"), net_or_parts(F.lit(None).cast("double"), F.col("p"), F.col("commission"), F.lit(None).cast("double")).alias("net"))


@query((f"{a.POSITIONS}, {a.BARS}", f"position_id, {r('gold_vol_prev_day = (high - low) / nullif(close, 0)')} FROM positions LEFT JOIN bars ON date = campaign_date - 1"))
def previous_day_range(spark, sf_dir):
    """The equi-join on the calendar day before."""
    return positions.previous_day(a.positions(spark, sf_dir), a.daily_bars(spark, sf_dir)).select("position_id", "gold_vol_prev_day")


@query((a.BARS, f"date, {r('open', 'high', 'low', 'close')} FROM bars"))
def daily_bars(spark, sf_dir):
    return a.daily_bars(spark, sf_dir)


@query((a.POSITIONS, f"campaign_id, account_id, min(open_time) AS first_open, max(close_time) AS last_close, count(*) AS n, {r('hours = ' + SECS.format('max(close_time)', 'min(open_time)') + ' / 3600')} FROM positions GROUP BY 1, 2"))
def account_spans(spark, sf_dir):
    return positions.account_spans(a.positions(spark, sf_dir))


@query((f"{a.POSITIONS}", "position_id, count(DISTINCT campaign_id) AS campaigns FROM (SELECT campaign_id, CAST(CAST(9000000000000000000 + position_id * 64 AS BIGINT) AS DOUBLE) AS position_id FROM positions) GROUP BY 1 HAVING count(DISTINCT campaign_id) > 1"))
def merged_ids(spark, sf_dir):
    """Ids of 19 digits read as doubles: neighbours become one, and some then occur in several campaigns."""
    p = a.positions(spark, sf_dir).select("campaign_id", (F.lit(9_000_000_000_000_000_000) + F.col("position_id") * 64).cast("double").alias("position_id"))
    return p.groupBy("position_id").agg(F.count_distinct("campaign_id").alias("campaigns")).filter("campaigns > 1")


@query((f"{BASE}, {a.REGISTRATIONS}, h0 AS (SELECT f.*, trader_key FROM features f LEFT JOIN registrations USING (campaign_id, account_id))",
        f"trader_key, campaign_id, {r('tilt = avg(CASE WHEN loss_streak >= 2 THEN -profit / amount END)')}, count(*) FILTER (loss_streak >= 2) AS n_tilt, {r('sl_sum = sum(dist)')}, count(dist) AS n_sl, count(*) AS n, {r('span_hours = ' + SECS.format('max(close_time)', 'min(open_time)') + ' / 3600')} FROM h0 WHERE trader_key IS NOT NULL GROUP BY 1, 2"))
def campaign_summary(spark, sf_dir):
    return history.campaign_summary(_with_streak(spark, sf_dir))


def _with_streak(spark, sf_dir):
    p = a.positions(spark, sf_dir)
    return with_traders(f.features(p, ["loss_streak"], keep=p.columns), spark, sf_dir)


POPULATION = f"""{BASE}, {a.REGISTRATIONS}, h0 AS (SELECT f.*, trader_key FROM features f LEFT JOIN registrations USING (campaign_id, account_id)), train AS (SELECT * FROM h0 WHERE campaign_id <= 56),
    spans AS (SELECT campaign_id, coalesce(CAST(trader_key AS VARCHAR), campaign_id || '_' || account_id) AS who, {SECS.format('max(close_time)', 'min(open_time)')} / 3600 / 1.99::DOUBLE AS survival FROM train GROUP BY 1, 2),
    pop AS (SELECT (SELECT avg(CASE WHEN loss_streak >= 2 THEN -profit / amount END) FROM train) AS pop_tilt, (SELECT avg(dist) FROM train) AS pop_sl, (SELECT avg(survival) FROM spans) AS pop_survival)"""


@query((POPULATION, f"{r('pop_tilt', 'pop_sl', 'pop_survival')} FROM pop"))
def population_priors(spark, sf_dir):
    """Fitted on the first campaigns only."""
    return history.population(_with_streak(spark, sf_dir).filter("campaign_id <= 56"))


@query((f"""{POPULATION}, summ AS (SELECT trader_key, campaign_id, avg(CASE WHEN loss_streak >= 2 THEN -profit / amount END) AS tilt, count(*) FILTER (loss_streak >= 2) AS n_tilt, sum(dist) AS sl_sum, count(dist) AS n_sl, count(*) AS n,
        {SECS.format('max(close_time)', 'min(open_time)')} / 3600 AS span FROM h0 WHERE trader_key IS NOT NULL GROUP BY 1, 2),
    mem AS (SELECT trader_key, campaign_id, row_number() OVER w - 1 AS prior, list_reduce(CASE WHEN count(tilt) OVER v > 0 THEN list_filter(list(tilt) OVER v, lambda x: x IS NOT NULL) ELSE [NULL] END, lambda a, x: (1 - 0.5::DOUBLE ** 0.5) * x + 0.5::DOUBLE ** 0.5 * a) AS tilt_raw, coalesce(sum(n_tilt) OVER v, 0) AS nt,
        sum(sl_sum) OVER v / nullif(sum(n_sl) OVER v, 0) AS sl_raw, coalesce(sum(n_sl) OVER v, 0) AS ns, avg(span) OVER v / 1.99::DOUBLE AS surv_raw, coalesce(sum(n) OVER v, 0) AS np FROM summ
        WINDOW w AS (PARTITION BY trader_key ORDER BY campaign_id), v AS (PARTITION BY trader_key ORDER BY campaign_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    j AS (SELECT h0.*, coalesce(prior, 0) AS prior, tilt_raw, coalesce(nt, 0) AS nt, sl_raw, coalesce(ns, 0) AS ns, surv_raw, coalesce(np, 0) AS np FROM h0 LEFT JOIN mem ON h0.trader_key = mem.trader_key AND h0.campaign_id = mem.campaign_id)""",
        f"""campaign_id, account_id, position_id, CAST(prior AS BIGINT) AS prior_campaigns, CAST(prior * CAST(loss_streak >= 2 AS INT) AS BIGINT) AS prior_campaigns_x_loss_streak_ge_2,
    {r(*[f'{n} = CASE WHEN {p} IS NULL THEN {x} WHEN {k} = 0 OR {x} IS NULL THEN {p} ELSE {k} / ({k} + 5.0::DOUBLE) * {x} + (1 - {k} / ({k} + 5.0::DOUBLE)) * {p} END' for n, x, k, p in (('trader_prior_tilt', 'tilt_raw', 'nt', 'pop_tilt'), ('trader_prior_sl_discipline', 'sl_raw', 'ns', 'pop_sl'), ('trader_prior_survival', 'surv_raw', 'np', 'pop_survival'))])},
    prior = 0 AS is_cold_start FROM j, pop"""))  # fmt: skip
def trader_history(spark, sf_dir):
    rows = _with_streak(spark, sf_dir)
    return history.trader_history(rows, history.population(rows.filter("campaign_id <= 56")))


UNIVARIATE = ("loss_streak", "amount", "cum_pnl_usd", "trades_per_hour", "pnl_ewm")


@query((f"{STATE}, u AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, CAST(f_{c} AS DOUBLE) AS value, reverse_profit_per_lot AS y FROM st''' for c in UNIVARIATE)}), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM u GROUP BY 1)",
        f"feature, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < value)) AS INTEGER) AS bucket, count(*) AS n, {r('mean_target = avg(y)')} FROM u JOIN e USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2"))
def univariate_buckets(spark, sf_dir):
    p = a.positions(spark, sf_dir)
    rows = f.features(p, UNIVARIATE, keep=["position_id", "profit", "amount"]).withColumn("y", reverse_per_lot(F.col("profit"), F.col("amount")))
    return buckets.univariate(rows, UNIVARIATE, "y")


@query((f"{STATE}", f"CASE WHEN loss_streak = 0 THEN '0' WHEN loss_streak = 1 THEN '1' ELSE '>=2' END AS streak, count(*) AS n, {r('sl_rate = avg(CAST(has_sl AS INT))')} FROM st GROUP BY 1"))
def streak_stop_rate(spark, sf_dir):
    level = F.when(F.col("loss_streak") == 0, "0").when(F.col("loss_streak") == 1, "1").otherwise(">=2")
    return states(spark, sf_dir).groupBy(level.alias("streak")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("has_sl").cast("double")).alias("sl_rate"))


@query((f"{STATE}, {EDGE}", f"amount <= small AS small_size, coalesce(lot_ratio_vs_avg > 1.5, FALSE) AS escalated, count(*) AS n, {r('mean_loss = avg(gross_loss_per_lot)')} FROM st, edge GROUP BY 1, 2"))
def size_by_ratio(spark, sf_dir):
    small = cond.small_size_edge(a.positions(spark, sf_dir))
    return states(spark, sf_dir).groupBy((F.col("amount") <= small).alias("small_size"), sure(F.col("lot_ratio_vs_avg") > 1.5).alias("escalated")).agg(F.count(F.lit(1)).alias("n"), F.avg("gross_loss_per_lot").alias("mean_loss"))


@query((f"{a.POSITIONS}, {a.REGISTRATIONS}, k AS (SELECT ip_cluster_id, count(DISTINCT account_id) AS n FROM registrations GROUP BY 1), l AS (SELECT unnest(['1', '2-10', '11-50', '51+']) AS bin)",
        "bin, (SELECT count(*) FROM k WHERE n > 0 AND CASE WHEN n <= 1 THEN '1' WHEN n <= 10 THEN '2-10' WHEN n <= 50 THEN '11-50' ELSE '51+' END = l.bin) AS n FROM l"))
def cluster_sizes(spark, sf_dir):
    """A fixed-edge histogram that keeps empty bins."""
    k = a.registrations(spark, sf_dir).groupBy("ip_cluster_id").agg(F.count_distinct("account_id").cast("double").alias("n"))
    return buckets.histogram(k, "n", [1, 10, 50, float("inf")], ["1", "2-10", "11-50", "51+"], 0)


@query((f"{a.POSITIONS}, {a.REGISTRATIONS}", "challenge_type, " + ", ".join(f"count(*) FILTER (campaign_id = {c}) AS \"{c}\"" for c in range(52, 67)) + " FROM registrations GROUP BY 1"))
def challenge_by_campaign(spark, sf_dir):
    rows = a.registrations(spark, sf_dir).withColumn("challenge_type", challenge(F.col("challenge_type_id")))
    return buckets.crosstab(rows, "challenge_type", "campaign_id", range(52, 67))


@query((f"{a.POSITIONS}, {a.REGISTRATIONS}, act AS (SELECT campaign_id, count(DISTINCT account_id) AS active FROM positions WHERE side = 'BUY' GROUP BY 1)", f"campaign_id, count(*) AS registrants, any_value(active) AS active, {r('rate = any_value(active) / CAST(count(*) AS DOUBLE)')} FROM registrations JOIN act USING (campaign_id) GROUP BY 1"))
def activation(spark, sf_dir):
    return forensics.activation(a.registrations(spark, sf_dir), a.positions(spark, sf_dir).filter("side = 'BUY'"))


@query((f"""{a.POSITIONS}, {a.REGISTRATIONS}, k AS (SELECT * FROM registrations WHERE ip_cluster_id <> -1), t AS (SELECT DISTINCT campaign_id, account_id FROM positions WHERE side = 'BUY'),
    c AS (SELECT ip_cluster_id, campaign_id, count(DISTINCT account_id) AS reg, count(DISTINCT t.account_id) AS act FROM k LEFT JOIN t USING (campaign_id, account_id) GROUP BY 1, 2),
    w AS (SELECT ip_cluster_id, count(DISTINCT account_id) AS accounts FROM k GROUP BY 1)""",
        "ip_cluster_id, any_value(accounts) AS accounts, count(*) AS campaigns, min(campaign_id) AS first_campaign, max(campaign_id) AS last_campaign, max(reg) AS most_registered, max(act) AS most_trading, CASE WHEN any_value(accounts) = 1 THEN 'single' WHEN max(act) >= 2 THEN 'parallel' ELSE 'serial' END AS kind FROM c JOIN w USING (ip_cluster_id) GROUP BY 1"))
def address_clusters(spark, sf_dir):
    return forensics.ip_clusters(a.registrations(spark, sf_dir), a.positions(spark, sf_dir).filter("side = 'BUY'"))


@query((f"{a.POSITIONS}, {a.REGISTRATIONS}, w AS (SELECT ip_cluster_id, campaign_id, time_bucket(INTERVAL 5 MINUTE, open_time) AS b, count(*) AS n, count(DISTINCT account_id) AS a FROM positions JOIN registrations USING (campaign_id, account_id) GROUP BY 1, 2, 3)", f"ip_cluster_id, campaign_id, CAST(sum(n) AS BIGINT) AS n_opens, {r('share_in_step = sum(CASE WHEN a >= 2 THEN n ELSE 0 END) / sum(n)')} FROM w GROUP BY 1, 2"))
def opens_in_step(spark, sf_dir):
    return forensics.in_step(with_traders(a.positions(spark, sf_dir), spark, sf_dir), "ip_cluster_id")


@query((f"{a.POSITIONS}, n AS (SELECT CAST(ceil(count(*) * 0.05) AS BIGINT) AS k, sum(-profit) AS t FROM positions)", f"any_value(k) AS n_top, {r('tail_share = sum(v) / any_value(t)')} FROM n, (SELECT -profit AS v, row_number() OVER (ORDER BY -profit DESC) AS rn FROM positions) WHERE rn <= k"))
def tail_share(spark, sf_dir):
    return buckets.tail_share(a.positions(spark, sf_dir).select((-F.col("profit")).alias("loss")), "loss")


@query((f"{STATE}", "CASE WHEN win_streak > 1 THEN 'winning' WHEN f_trades_per_hour > 60 THEN 'too fast' WHEN NOT has_sl THEN 'no stop' WHEN gross_loss_per_lot <= 7 THEN 'below hurdle' ELSE 'passed' END AS gate, count(*) AS n FROM st GROUP BY 1"))
def gate_waterfall(spark, sf_dir):
    p = a.positions(spark, sf_dir)
    rows = f.features(p, ["win_streak", "trades_per_hour", "has_sl"], keep=["profit", "amount"])
    return cond.gate_waterfall(rows, [("winning", F.col("win_streak") > 1), ("too fast", F.col("trades_per_hour") > 60), ("no stop", ~F.col("has_sl")), ("below hurdle", loss_per_lot(F.col("profit"), F.col("amount")) <= DEFAULT.hurdle)])


@query((f"{a.POSITIONS}, c AS (SELECT -((-profit / amount - 7) + profit) AS v FROM positions)", f"count(v) AS n, {r('mean = avg(v)', 'std = stddev_samp(v)', 'min = min(v)', *[f'p{q} = quantile_cont(v, {q / 100})' for q in (10, 25, 50, 75, 90)], 'max = max(v)')} FROM c"))
def cost_description(spark, sf_dir):
    return stats.describe(a.positions(spark, sf_dir).select((-(reverse_per_lot(F.col("profit"), F.col("amount")) + F.col("profit"))).alias("cost")), "cost")


def _rank_sql(x: str, y: str, a_: str, b_: str, source: str) -> str:
    half = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{a_}' AS a, '{b_}' AS b, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {half.format('x')} AS rx, {half.format('y')} AS ry FROM (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"


PAIRS = [(x, y) for i, x in enumerate(CORRELATED) for y in CORRELATED[i + 1 :]]
RHO = f"{BASE}, rho AS ({' UNION ALL '.join(_rank_sql('f_' + x, 'f_' + y, x, y, 'features') for x, y in PAIRS)})"


@query((RHO, f"a, b, {r('rho')}, n FROM rho"))
def rank_correlation(spark, sf_dir):
    return stats.spearman(written(f.features(a.positions(spark, sf_dir), CORRELATED), "features"), CORRELATED)


@query((RHO, f"a, b, {r('rho')}, n FROM rho WHERE abs(rho) > 0.7"))
def correlated_pairs(spark, sf_dir):
    return rank_correlation(spark, sf_dir).filter(F.abs("rho") > 0.7)


@query()
def correlation_prune(spark, sf_dir):
    """Which of the correlated features go (a sequential rule over the collected pairs)."""
    rows = written(f.features(a.positions(spark, sf_dir), CORRELATED), "features")
    pairs = [(x["a"], x["b"], x["rho"]) for x in stats.spearman(rows, CORRELATED).collect() if x["rho"] is not None]
    cover = {x["feature"]: x["coverage"] for x in stats.coverage(rows, CORRELATED).collect()}
    return spark.createDataFrame(stats.prune(pairs, cover, at=0.74), "dropped string, kept string, rho double")


@query((BASE, "feature, round(coverage, 6) + 0.0 AS coverage FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST(f_{c} IS NOT NULL AS INT)) AS coverage FROM features" for c in f.ENTRY) + ")"))
def feature_coverage(spark, sf_dir):
    return stats.coverage(f.features(a.positions(spark, sf_dir), f.ENTRY), f.ENTRY)


ICC = """c AS (SELECT k, count(*) AS n, avg(y) AS m, sum(y) AS s FROM w GROUP BY 1), g AS (SELECT avg(y) AS g, count(*) AS nt FROM w), t AS (SELECT CAST(any_value(nt) AS BIGINT) AS n_rows, count(*) AS n_clusters, sum(n * (m - g) * (m - g)) AS ssb, sum(n * n) AS n2 FROM c, g),
    ww AS (SELECT sum((y - m) * (y - m)) AS ssw FROM w JOIN c USING (k)), v AS (SELECT *, ssb / (n_clusters - 1) AS ms_between, ssw / (n_rows - n_clusters) AS ms_within, (n_rows - n2 / CAST(n_rows AS DOUBLE)) / (n_clusters - 1) AS m0 FROM t, ww),
    i AS (SELECT *, (ms_between - ms_within) / (ms_between + (m0 - 1) * ms_within) AS icc FROM v)"""
OUTCOME = f"{a.POSITIONS}, {a.REGISTRATIONS}, o AS (SELECT p.*, trader_key, ip_cluster_id, -profit / amount - 7 AS y FROM positions p LEFT JOIN registrations USING (campaign_id, account_id))"


def _outcomes(spark, sf_dir):
    return with_traders(a.positions(spark, sf_dir), spark, sf_dir).withColumn("y", reverse_per_lot(F.col("profit"), F.col("amount")))


@query((f"{OUTCOME}, w AS (SELECT y, coalesce(CAST(trader_key AS VARCHAR), campaign_id || '_' || account_id) AS k FROM o), {ICC}", f"n_rows, n_clusters, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('ms_between', 'ms_within'))}, {r('m0', 'icc', 'deff = 1 + (n_rows / CAST(n_clusters AS DOUBLE) - 1) * icc')} FROM i"))
def icc_by_trader(spark, sf_dir):
    out = stats.icc(_outcomes(spark, sf_dir), "y", trader_cluster(F.col("trader_key"), F.col("campaign_id"), F.col("account_id")))
    return out.withColumns({c: F.round(c, 4) for c in ("ms_between", "ms_within")})


@query((f"{OUTCOME}, w AS (SELECT y, CASE WHEN ip_cluster_id <> -1 THEN 'ip_' || ip_cluster_id ELSE 'acct_' || campaign_id || '_' || account_id END AS k FROM o), {ICC}", f"n_rows, n_clusters, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('ms_between', 'ms_within'))}, {r('m0', 'icc', 'deff = 1 + (n_rows / CAST(n_clusters AS DOUBLE) - 1) * icc')} FROM i"))
def icc_by_address(spark, sf_dir):
    out = stats.icc(_outcomes(spark, sf_dir), "y", ip_cluster(F.col("ip_cluster_id"), F.col("campaign_id"), F.col("account_id")))
    return out.withColumns({c: F.round(c, 4) for c in ("ms_between", "ms_within")})


@query((f"{OUTCOME}, b AS (SELECT quantile_cont(y, [0.01, 0.99]) AS q FROM o), z AS (SELECT greatest(q[1], least(q[2], y)) AS z, y FROM o, b)", "round(stddev_samp(y), 4) + 0.0 AS sigma_raw, round(stddev_samp(z), 4) + 0.0 AS sigma_winsorised FROM z"))
def sigmas(spark, sf_dir):
    return stats.winsorised(_outcomes(spark, sf_dir), "y").agg(F.round(F.stddev_samp("y"), 4).alias("sigma_raw"), F.round(F.stddev_samp("y_w"), 4).alias("sigma_winsorised"))


#: ICC for several groups of rows at once: w has a column g_ beside y and k.
GROUPED_ICC = """c AS (SELECT g_, k, count(*) AS n, avg(y) AS m FROM w GROUP BY 1, 2), g AS (SELECT g_, avg(y) AS g, count(*) AS nt FROM w GROUP BY 1),
    t AS (SELECT g_, CAST(any_value(nt) AS BIGINT) AS n_rows, count(*) AS n_clusters, sum(n * (m - g) * (m - g)) AS ssb, sum(n * n) AS n2 FROM c JOIN g USING (g_) GROUP BY 1),
    ww AS (SELECT g_, sum((y - m) * (y - m)) AS ssw FROM w JOIN c USING (g_, k) GROUP BY 1),
    v AS (SELECT *, ssb / nullif(n_clusters - 1, 0) AS b, ssw / nullif(n_rows - n_clusters, 0) AS i, (n_rows - n2 / CAST(n_rows AS DOUBLE)) / nullif(n_clusters - 1, 0) AS m0 FROM t JOIN ww USING (g_)),
    e AS (SELECT g_, n_rows, 1 + (n_rows / CAST(n_clusters AS DOUBLE) - 1) * coalesce((b - i) / nullif(b + (m0 - 1) * i, 0), 0) AS deff FROM v)"""


@query((f"""{OUTCOME}, q AS (SELECT quantile_cont(y, [0.01, 0.99]) AS q FROM o), z AS (SELECT greatest(q[1], least(q[2], y)) AS z, y FROM o, q),
    sd AS (SELECT 'sigma_raw' AS sigma, round(stddev_samp(y), 4) AS s FROM z UNION ALL SELECT 'sigma_winsorised', round(stddev_samp(z), 4) FROM z),
    w AS (SELECT 'trader' AS g_, y, coalesce(CAST(trader_key AS VARCHAR), campaign_id || '_' || account_id) AS k FROM o UNION ALL SELECT 'address', y, CASE WHEN ip_cluster_id <> -1 THEN 'ip_' || ip_cluster_id ELSE 'acct_' || campaign_id || '_' || account_id END FROM o), {GROUPED_ICC}""",
        f"sigma, g_ AS scheme, delta, round(2 * {stats.Z_SUM}::DOUBLE ** 2 * s ** 2 / delta ** 2 * deff, 3) + 0.0 AS n_per_arm, {r(f'least_effect_of_1000 = {stats.Z_SUM}::DOUBLE * s * sqrt(deff / 1000)')} FROM sd, e, (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (40.0::DOUBLE)) x(delta)"))
def sample_sizes(spark, sf_dir):
    """Rows per arm for three effects, two spreads and two clusterings."""
    s, out = sigmas(spark, sf_dir).first(), []
    for scheme, q in (("trader", icc_by_trader), ("address", icc_by_address)):
        deff = q(spark, sf_dir).first()["deff"]
        out += [(k, scheme, d, round(stats.per_arm(s[k], deff, d), 3), stats.least_effect(s[k], 1000, deff)) for k in ("sigma_raw", "sigma_winsorised") for d in (10.0, 20.0, 40.0)]
    return spark.createDataFrame(out, "sigma string, scheme string, delta double, n_per_arm double, least_effect_of_1000 double")


@query((f"{BASE}", f"{r('slope = regr_slope(-profit / amount, f_amount)', 'intercept = regr_intercept(-profit / amount, f_amount)', 'r2 = regr_r2(-profit / amount, f_amount)')}, count(*) AS n FROM features"))
def loss_on_size(spark, sf_dir):
    return stats.least_squares(a.positions(spark, sf_dir).withColumn("y", loss_per_lot(F.col("profit"), F.col("amount"))), "y", "amount")


@query((f"{BASE}, t AS (SELECT count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (NOT x AND y) AS n01, count(*) FILTER (NOT x AND NOT y) AS n00 FROM (SELECT loss_streak >= 2 AS x, NOT f_has_sl AS y FROM features))",
        f"n11, n10, n01, n00, {r('chi2 = (n11+n10+n01+n00)::DOUBLE * (n11*n00 - n10*n01)::DOUBLE * (n11*n00 - n10*n01) / ((n11+n10)::DOUBLE * (n01+n00) * (n11+n01) * (n10+n00))', 'z = (n11/(n11+n10)::DOUBLE - n01/(n01+n00)::DOUBLE) / sqrt(((n11+n01)/(n11+n10+n01+n00)::DOUBLE) * (1 - (n11+n01)/(n11+n10+n01+n00)::DOUBLE) * (1/(n11+n10)::DOUBLE + 1/(n01+n00)::DOUBLE))')} FROM t"))
def streak_and_stop(spark, sf_dir):
    rows = f.features(a.positions(spark, sf_dir), ["loss_streak", "has_sl"])
    return stats.two_by_two(rows, F.col("loss_streak") >= 2, ~F.col("has_sl"))


@query((f"{OUTCOME}, g AS (SELECT campaign_id, sum(y) AS s, count(*) AS n FROM o GROUP BY 1)", f"campaign_id, CAST((SELECT sum(n) FROM g) - n AS BIGINT) AS n_rest, {r('mean_rest = ((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n)')} FROM g"))
def leave_one_campaign_out(spark, sf_dir):
    return stats.leave_one_out(_outcomes(spark, sf_dir), "campaign_id", "y")


SHIFTED = ("loss_streak", "amount", "lot_zscore", "sl_usage_rate_5")


@query((BASE, "feature, " + r("mean_old", "coverage_old", "mean_new", "coverage_new") + ", coverage_old - coverage_new >= 0.1 AS collapsed FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(f_{c}) FILTER (campaign_id <= 58) AS mean_old, avg(CAST(f_{c} IS NOT NULL AS INT)) FILTER (campaign_id <= 58) AS coverage_old, avg(f_{c}) FILTER (campaign_id > 58) AS mean_new, avg(CAST(f_{c} IS NOT NULL AS INT)) FILTER (campaign_id > 58) AS coverage_new FROM features" for c in SHIFTED) + ")"))
def feature_shift(spark, sf_dir):
    rows = f.features(a.positions(spark, sf_dir), SHIFTED)
    return stats.shift(rows.filter("campaign_id <= 58"), rows.filter("campaign_id > 58"), SHIFTED)


#: Two normal tails by Simpson's rule over 2,000 steps from 0 to z: not the series that the operator sums.
TAILS = "1 - sqrt(2 / pi()) * z / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * z / 2000) * (i * z / 2000) / 2)))"


@query((f"{OUTCOME}, z AS (SELECT campaign_id AS test, abs(avg(y)) / (stddev_samp(y) / sqrt(count(*))) AS z FROM o GROUP BY 1), t AS (SELECT test, greatest(0, {TAILS}) AS p FROM z), q AS (SELECT test, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, test) AS q_ FROM t)",
        f"test, {r('p', 'q = least(1.0, min(q_) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING))')} FROM q"))
def false_discovery(spark, sf_dir):
    """q-values of a test per campaign, of the mean against 0 by the normal distribution."""
    z = F.avg("y") / (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1))))
    t = _outcomes(spark, sf_dir).groupBy(F.col("campaign_id").alias("test")).agg(z.alias("z")).select("test", normal_tails(F.col("z")).alias("p"))
    return stats.benjamini_hochberg(t, "p")


FOLD_SQL = "VALUES " + ", ".join(f"({i}, {c}, '{role}')" for i, (tr, va) in enumerate(folds.windows(range(53, 66), 4, 4), 1) for role, cs in (("train", tr), ("validate", va)) for c in cs)


@query((f"""{OUTCOME}, roles(fold, campaign_id, role) AS ({FOLD_SQL}), x AS (SELECT * FROM o JOIN roles USING (campaign_id)), pairs(ip, c) AS (VALUES {', '.join(map(str, FLAGGED))}),
    v AS (SELECT x.*, role = 'validate' AND coalesce(trader_key IN (SELECT trader_key FROM x t WHERE t.role = 'train' AND t.fold = x.fold AND trader_key IS NOT NULL), FALSE) AS t, role = 'validate' AND ip_cluster_id IN (SELECT ip_cluster_id FROM x t WHERE t.role = 'train' AND t.fold = x.fold) AS i,
        EXISTS (SELECT 1 FROM pairs WHERE ip = x.ip_cluster_id AND c = x.campaign_id) AS fl FROM x)""",
        f"""CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'validate') AS raw_val_rows, count(*) FILTER (role = 'validate' AND NOT (t OR i AND fl)) AS purged_val_rows, count(*) FILTER (t OR i AND fl) AS rows_removed,
    count(*) FILTER (t AND NOT i) AS trader_only_rows, count(*) FILTER (i AND NOT t) AS ip_only_rows, count(*) FILTER (t AND i) AS both_rows, count(*) FILTER (t OR i) AS broad_rows_removed, count(*) FILTER (i AND fl AND NOT t) AS targeted_ip_only_rows, count(*) FILTER (i AND fl AND t) AS targeted_both_rows,
    count(DISTINCT account_id) FILTER (role = 'train') AS train_accounts, count(DISTINCT account_id) FILTER (role = 'validate') AS raw_val_accounts, count(DISTINCT account_id) FILTER (role = 'validate' AND NOT (t OR i AND fl)) AS purged_val_accounts, {r("attrition = count(*) FILTER (t OR i AND fl) / CAST(count(*) FILTER (role = 'validate') AS DOUBLE)")} FROM v GROUP BY 1"""))  # fmt: skip
def fold_attrition(spark, sf_dir):
    return folds.attrition(folds.fold_rows(_outcomes(spark, sf_dir), "A", FLAGGED))


@query((f"{OUTCOME}, roles(fold, campaign_id, role) AS ({FOLD_SQL})", "CAST(fold AS INTEGER) AS fold, role, count(*) AS n, count(DISTINCT campaign_id) AS campaigns FROM o JOIN roles USING (campaign_id) GROUP BY 1, 2"))
def fold_sizes_unpurged(spark, sf_dir):
    rows = folds.fold_rows(_outcomes(spark, sf_dir), "B").filter("NOT purged")
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("campaign_id").alias("campaigns"))


@query()
def bootstrap_conditions(spark, sf_dir):
    """Intervals of the condition means, traders drawn."""
    rows, named = _primary(spark, sf_dir)
    return bootstrap.bootstrap_conditions(with_traders(rows, spark, sf_dir), trader_cluster(F.col("trader_key"), F.col("campaign_id"), F.col("account_id")), named)


@query()
def bootstrap_by_address(spark, sf_dir):
    """The two key triggers, addresses drawn."""
    rows, named = _primary(spark, sf_dir)
    keys = {k: named[k] for k in ("loss_streak >= 2", "same side after SL hit")}
    return bootstrap.bootstrap_conditions(with_traders(rows, spark, sf_dir), ip_cluster(F.col("ip_cluster_id"), F.col("campaign_id"), F.col("account_id"), minus_one_is_missing=False), keys)


@query()
def bootstrap_bins(spark, sf_dir):
    """Intervals of the mean in each quartile of amount."""
    rows, _ = _primary(spark, sf_dir)
    found = buckets.edges(rows, "amount", 4)
    named = {f"amount bin {i}": buckets.bucket(F.col("amount"), found) == i for i in range(len(found) - 1)}
    return bootstrap.bootstrap_conditions(with_traders(rows, spark, sf_dir), trader_cluster(F.col("trader_key"), F.col("campaign_id"), F.col("account_id")), named)


@query()
def bootstrap_poisson(spark, sf_dir):
    """An interval whose clusters never leave Spark."""
    return bootstrap.poisson_bootstrap(_outcomes(spark, sf_dir), account_cluster(F.col("account_id"), F.col("position_id")), "y")


@query((f"{OUTCOME}", f"campaign_id, {r('weight = regr_sxy(y, amount) / (regr_sxx(y, amount) + 10)', 'intercept = avg(y) - regr_sxy(y, amount) / (regr_sxx(y, amount) + 10) * avg(amount)')} FROM o GROUP BY 1"))
def ridge_by_campaign(spark, sf_dir):
    """A one-feature ridge per campaign from Gram sums, whose closed form SQL can state."""
    g = model.gram(_outcomes(spark, sf_dir), [F.col("amount")], F.col("y"), "campaign_id")
    return spark.createDataFrame([(c, float(w[0]), b) for c, x in g.items() for b, w in [model.ridge(x, 10.0)]], "campaign_id int, weight double, intercept double")


NUMERIC = ("loss_streak", "win_streak", "pnl_ewm", "lot_zscore", "cum_pnl_usd", "dd_from_peak_usd", "trade_index", "log_dt_close", "trades_per_hour", "size_delta_ratio", "amount", "gold_vol_prev_day", "same_direction_reentry")
CATEGORICAL = ("challenge_type", "shared_ip")


def _artifact(spark, sf_dir, upto: int = 56):
    rows = written(model_rows(spark, sf_dir), "model_rows")  # read by every step of the fit
    return model.fit_all(rows.filter(F.col("campaign_id") <= upto), NUMERIC, CATEGORICAL), rows


INNER = f"""{OUTCOME}, t AS (SELECT trader_key, min(campaign_id) AS c0 FROM o WHERE trader_key IS NOT NULL GROUP BY 1), i AS (SELECT ip_cluster_id, min(campaign_id) AS c1 FROM o WHERE ip_cluster_id IS NOT NULL GROUP BY 1),
    pairs(ip, c) AS (VALUES {', '.join(map(str, FLAGGED))}),
    m AS (SELECT o.*, coalesce(c0 < campaign_id, FALSE) OR coalesce(c1 < campaign_id, FALSE) AND EXISTS (SELECT 1 FROM pairs WHERE ip = o.ip_cluster_id AND c = o.campaign_id) AS purged FROM o LEFT JOIN t USING (trader_key) LEFT JOIN i USING (ip_cluster_id)),
    cs AS (SELECT campaign_id AS val, row_number() OVER (ORDER BY campaign_id) - 2 AS inner_fold FROM (SELECT DISTINCT campaign_id FROM m))"""


@query((INNER, "CAST(inner_fold AS INTEGER) AS inner_fold, (SELECT count(*) FROM m WHERE campaign_id < val) AS train_rows, (SELECT count(*) FROM m WHERE campaign_id = val) AS raw_val_rows, (SELECT count(*) FROM m WHERE campaign_id = val AND NOT purged) AS val_rows FROM cs WHERE inner_fold > 0"))
def inner_fold_sizes(spark, sf_dir):
    """Rows of the purged inner folds."""
    return nested.inner_sizes(nested.inner_purged(_outcomes(spark, sf_dir), "A", FLAGGED))


@query((f"""{INNER}, f AS (SELECT inner_fold, val, regr_sxy(y, amount) / (regr_sxx(y, amount) + 10) AS weight, avg(y) - regr_sxy(y, amount) / (regr_sxx(y, amount) + 10) * avg(amount) AS intercept, count(*) AS train_rows
        FROM cs JOIN m ON campaign_id < val AND NOT purged WHERE inner_fold > 0 AND y IS NOT NULL GROUP BY 1, 2)""",
        f"CAST(inner_fold AS INTEGER) AS inner_fold, train_rows, (SELECT count(*) FROM m WHERE campaign_id = val AND NOT purged AND y IS NOT NULL) AS val_rows, {r('weight', 'intercept')}, round((SELECT avg((intercept + weight * amount - y) ** 2) FROM m WHERE campaign_id = val AND NOT purged), 3) + 0.0 AS mse FROM f"))
def purged_inner_ridge(spark, sf_dir):
    """A ridge per inner fold, purged rows taken off the sums of training and validation; no row is read again."""
    rows = nested.inner_purged(_outcomes(spark, sf_dir), "A", FLAGGED)
    fits = nested.inner_fits(rows, [F.col("amount")], "y", [10.0], purge_training=True)
    return spark.createDataFrame([(i, n, m, w[0], b, None if e is None else round(e, 3)) for i, _, n, m, b, w, e in fits], "inner_fold int, train_rows long, val_rows long, weight double, intercept double, mse double")


@query()
def fold_artifacts(spark, sf_dir):
    """The frozen artifact of every walk-forward fold, all folds from the same passes: fold, name, value."""
    rows = written(nested.inner_purged(model_rows(spark, sf_dir).filter(F.col("campaign_id").between(DEFAULT.primary_from, DEFAULT.primary_to)), "A", FLAGGED), "model_rows")
    campaigns = [x[0] for x in rows.select("campaign_id").distinct().collect()]
    arts = nested.fit_folds(rows, [train for train, _ in folds.windows(campaigns, DEFAULT.fold_count, DEFAULT.least_train_campaigns)], NUMERIC, CATEGORICAL)
    told = [(f, n, float(v)) for f, art in arts.items() for n, v in (*zip(art["columns"], art["weights"], strict=True), ("intercept", art["intercept"]), ("alpha", art["alpha"]), ("threshold", art["threshold"]), ("score_scale", art["score_scale"]))]
    return spark.createDataFrame(told, "fold int, name string, value double")


@query()
def fitted_weights(spark, sf_dir):
    """The frozen artifact: a row per transformed column."""
    art, _ = _artifact(spark, sf_dir)
    return spark.createDataFrame([*zip(art["columns"], art["weights"], strict=True), ("intercept", art["intercept"]), ("alpha", art["alpha"]), ("threshold", art["threshold"])], "name string, value double")


@query()
def fitted_decisions(spark, sf_dir):
    """Decisions on later campaigns by an artifact fitted on earlier ones."""
    art, rows = _artifact(spark, sf_dir)
    return model.decide(rows.filter("campaign_id > 56"), art).select("position_id", "decision", "score", "expected_absolute", "confidence", "triggering_features")


@query()
def policy_backtest(spark, sf_dir):
    """The fitted policy against acting on all and on none, with account intervals."""
    art, rows = _artifact(spark, sf_dir)
    d = model.decide(rows.filter("campaign_id > 56"), art)
    out = None
    for label, on in (("model", F.col("decision") == "FADE"), ("act on all", F.lit(True)), ("do nothing", F.lit(False))):
        lo, hi = bootstrap.selected_interval(d, on, account_cluster(F.col("account_id"), F.col("position_id")), "reverse_profit_per_lot")
        one = model.policy(d, on, label).withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
        out = one if out is None else out.unionByName(one)
    return out


FIXED = model.artifact(model.Design(["loss_streak", "cum_pnl_usd", "amount"], {"side": ["BUY", "SELL"]}, {"loss_streak": 0.0, "cum_pnl_usd": 0.0, "amount": 0.25}, {"loss_streak": 1.0, "cum_pnl_usd": 0.0, "amount": 0.25}, {"loss_streak": 2.0, "cum_pnl_usd": 50.0, "amount": 0.2}), 3.0, [5.0, -2.0, 1.5, -0.5, 0.75], 1.0, -10.0, 10.0)
SCORE = f"""{BASE}, s AS (SELECT *, 5.0::DOUBLE * ((loss_streak - 1) / 2.0::DOUBLE) AS c1, -2.0::DOUBLE * (cum_prev / 50.0::DOUBLE) AS c2, 1.5::DOUBLE * ((amount - 0.25::DOUBLE) / 0.2::DOUBLE) AS c3, CASE WHEN side = 'BUY' THEN -0.5 ELSE 0 END::DOUBLE AS c4, CASE WHEN side = 'SELL' THEN 0.75 ELSE 0 END::DOUBLE AS c5 FROM features),
    z AS (SELECT *, 3.0::DOUBLE + c1 + c2 + c3 + c4 + c5 AS score FROM s), d AS (SELECT *, score > 0 AND NOT coalesce(win_streak > 1 OR f_trades_per_hour > 60, FALSE) AS fade, -profit / amount - 7 AS y FROM z)"""


def _fixed(spark, sf_dir):
    p = a.positions(spark, sf_dir)
    rows = f.features(p, ["loss_streak", "win_streak", "cum_pnl_usd", "trades_per_hour"], keep=[*POSITION, "amount", "side", "profit"])
    return model.decide(rows, FIXED).withColumn("y", reverse_per_lot(F.col("profit"), F.col("amount")))


RAW = {"campaign_id": "campaignId", "account_id": "accountId", "position_id": "positionId", "open_time": "openDateTime", "close_time": "closeTime", "net_profit": "netProfit", "sl_price": "slPrice", "tp_price": "tpPrice", "exit_type": "exitType"}


@query((f"""{a.POSITIONS}, j AS (SELECT p.*, coalesce(list(q.net_profit ORDER BY q.open_time, q.position_id) FILTER (q.position_id IS NOT NULL), []) AS nets, min(q.open_time) AS first_open FROM positions p LEFT JOIN positions q
        ON p.campaign_id = q.campaign_id AND p.account_id = q.account_id AND (q.open_time, q.position_id) < (p.open_time, p.position_id) AND q.position_id % 7 <> 0 GROUP BY ALL),
    k AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, nets), lambda a, x: CASE WHEN x < 0 THEN a + 1 ELSE 0 END) AS loss_streak, list_reduce(list_prepend(0.0::DOUBLE, nets), lambda a, x: CASE WHEN x > 0 THEN a + 1 ELSE 0 END) AS wins, coalesce(list_sum(nets), 0) AS cum,
        (len(nets) + 1) / CASE WHEN first_open IS NULL THEN 1 / 60.0::DOUBLE ELSE greatest(1 / 60.0::DOUBLE, {SECS.format('open_time', 'first_open')} / 3600) END AS per_hour FROM j),
    z AS (SELECT *, 3.0::DOUBLE + 5.0::DOUBLE * ((loss_streak - 1) / 2.0::DOUBLE) - 2.0::DOUBLE * (cum / 50.0::DOUBLE) + 1.5::DOUBLE * ((amount - 0.25::DOUBLE) / 0.2::DOUBLE) + CASE WHEN side = 'BUY' THEN -0.5 WHEN side = 'SELL' THEN 0.75 ELSE 0 END::DOUBLE AS score FROM k),
    d AS (SELECT *, score > 0 AND wins <= 1 AND per_hour <= 60 AS fade FROM z)""",
        f"campaign_id || '::' || position_id AS position_key, CASE WHEN fade THEN 'FADE' ELSE 'ABSTAIN' END AS decision, {r('score', 'expected_absolute = score * amount', 'confidence = CASE WHEN fade THEN 1 / (1 + exp(-score / 10)) ELSE 0 END')} FROM d"))
def predicted_trades(spark, sf_dir):
    """Raw trades, a seventh of them still open, decided on in one call by the fixed artifact."""
    p = a.positions(spark, sf_dir).withColumnsRenamed(RAW)
    open_still = F.col("positionId") % 7 == 0
    raw = p.withColumns({"closeTime": F.when(~open_still, F.col("closeTime")), "netProfit": F.when(~open_still, F.col("netProfit")), "profit": F.when(~open_still, F.col("profit"))})
    return predict.predict(raw, FIXED).select("position_key", "decision", "score", "expected_absolute", "confidence")


@query((SCORE, f"position_id, CASE WHEN fade THEN 'FADE' ELSE 'ABSTAIN' END AS decision, {r('score', 'expected_absolute = score * amount', 'confidence = CASE WHEN fade THEN 1 / (1 + exp(-score / 10)) ELSE 0 END')} FROM d"))
def fixed_decisions(spark, sf_dir):
    """The decision rule under a fixed artifact, which SQL can state."""
    return _fixed(spark, sf_dir).select("position_id", "decision", "score", "expected_absolute", "confidence")


@query((f"{SCORE}, g AS (SELECT -100.0::DOUBLE + i AS threshold FROM range(601) t(i))", f"threshold, (SELECT count(*) FROM d WHERE score > threshold) AS n, {r('coverage = (SELECT count(*) FROM d WHERE score > threshold) / (SELECT count(*) FROM d)::DOUBLE')}, round((SELECT avg(y) FROM d WHERE score > threshold), 4) + 0.0 AS mean_actual FROM g"))
def threshold_sweep(spark, sf_dir):
    return model.threshold_sweep(_fixed(spark, sf_dir), "score", "y").withColumn("mean_actual", F.round("mean_actual", 4))


@query((SCORE, f"'fixed' AS policy, count(*) FILTER (fade) AS n, {r('coverage = count(*) FILTER (fade) / count(*)::DOUBLE', 'mean = avg(y) FILTER (fade)', 'size_weighted_mean = sum(y * amount) FILTER (fade) / sum(amount) FILTER (fade)')}, round(sum(y * amount) FILTER (fade), 4) + 0.0 AS total FROM d"))
def policy_metrics(spark, sf_dir):
    return model.policy(_fixed(spark, sf_dir), F.col("decision") == "FADE", "fixed", "y").withColumn("total", F.round("total", 4))


SHARES = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


@query((f"""{SCORE}, ordered AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM d), shares AS (SELECT unnest({list(SHARES)}::DOUBLE[]) AS share),
    cuts AS (SELECT share, CASE WHEN t.k >= t.n THEN t.score - 1e-12::DOUBLE ELSE (t.score + u.score) / 2 END AS cutoff FROM shares JOIN ordered t ON t.k = greatest(1, CAST(round_even(share * t.n, 0) AS BIGINT)) LEFT JOIN ordered u ON u.k = t.k + 1)""",
        f"share, {r('cutoff')}, (SELECT count(*) FROM d WHERE score > cutoff) AS n, {r('mean = (SELECT avg(y) FROM d WHERE score > cutoff)')} FROM cuts"))
def power_frontier(spark, sf_dir):
    return model.frontier(written(_fixed(spark, sf_dir), "decided"), "score", SHARES, "y")


@query((f"""{SCORE}, ordered AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM d), shares AS (SELECT unnest({list(SHARES)}::DOUBLE[]) AS share),
    cuts AS (SELECT share, CASE WHEN t.k >= t.n THEN t.score - 1e-12::DOUBLE ELSE (t.score + u.score) / 2 END AS cutoff FROM shares JOIN ordered t ON t.k = greatest(1, CAST(round_even(share * t.n, 0) AS BIGINT)) LEFT JOIN ordered u ON u.k = t.k + 1),
    w AS (SELECT share AS g_, y, account_id AS k FROM d JOIN cuts ON score > cutoff), {GROUPED_ICC}, sd AS (SELECT stddev_samp(y) AS s FROM d), a AS (SELECT g_, avg(y) AS m FROM w GROUP BY 1)""",
        f"share, {r('cutoff')}, e.n_rows AS n, {r('mean = m', 'deff', f'mde = {stats.Z_SUM}::DOUBLE * s * sqrt(greatest(deff, 0) / e.n_rows)', f'mde_floored = {stats.Z_SUM}::DOUBLE * s * sqrt(greatest(deff, 1) / e.n_rows)')} FROM cuts JOIN e ON e.g_ = share JOIN a ON a.g_ = share, sd"))
def frontier_effects(spark, sf_dir):
    """The frontier with design effects of accounts and the effects that its selections could show."""
    rows = written(_fixed(spark, sf_dir), "decided")
    return model.frontier(rows, "score", SHARES, "y", account_cluster(F.col("account_id"), F.col("position_id")))


@query((a.POSITIONS, "count(*) FILTER (campaign_id <= 52) AS training, count(*) FILTER (campaign_id > 52) AS evaluation, count(*) FILTER (campaign_id > 52 AND campaign_id NOT IN (41, 66)) AS economic FROM positions"))
def mandated_counts(spark, sf_dir):
    """The literal split by campaign, its rows counted."""
    parts = zip(("training", "evaluation", "economic"), compare.mandated_split(a.positions(spark, sf_dir)), strict=True)
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in parts]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


@query((f"""{a.POSITIONS}, o AS (SELECT *, row_number() OVER ({PART}) AS ti, count(*) OVER (PARTITION BY campaign_id, account_id) AS n FROM positions), k AS (SELECT *, ti > ceil(n / 2.0) AS later FROM o),
        c AS (SELECT *, sum(CASE WHEN later THEN net_profit ELSE 0 END) {PREV} AS moved FROM k)""", "count(*) FILTER (NOT later) AS checked, 0::BIGINT AS flipped_differ, 0::BIGINT AS prefix_differ, count(*) FILTER (abs(moved) > 1e-6) AS later_differ FROM c"))  # fmt: skip
def causal_rebuild(spark, sf_dir):
    """The first half of every account's positions is rebuilt twice: with the outcomes of the account's later positions changed, and without these positions. No feature may differ.

    later_differ counts positions of the second half whose running profit does follow the change, so that it is one.
    """
    p = a.positions(spark, sf_dir)
    own = p.withColumns({"ti": F.row_number().over(f.by_account()), "n": F.count(F.lit(1)).over(Window.partitionBy(*positions.ACCOUNT))})
    own = own.withColumn("later", F.col("ti") > F.ceil(F.col("n") / 2))
    closed = {"net_profit": F.when(F.col("later"), F.col("net_profit") * -3).otherwise(F.col("net_profit")), "exit_type": F.when(F.col("later"), F.lit("sl_hit")).otherwise(F.col("exit_type")), "close_time": F.when(F.col("later"), F.timestamp_add("HOUR", F.lit(5), F.col("close_time"))).otherwise(F.col("close_time"))}
    key = (*positions.ACCOUNT, "position_id")
    names = [n for n in f.FEATURES if n not in key]

    def hashed(df, name):
        """A digest of every feature, and the running profit, per position."""
        out = f.features(df, keep=(*key, "later"))
        return out.select(*key, "later", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias(name), F.round("cum_pnl_usd", 6).alias(f"{name}_cum"))

    whole, flipped, prefix = hashed(own, "whole"), hashed(own.withColumns(closed), "flipped").drop("later"), hashed(own.filter("NOT later"), "prefix").drop("later")
    both = whole.join(flipped, list(key), "left").join(prefix, list(key), "left")
    differ = lambda c: F.count_if(~F.col("later") & ~F.col("whole").eqNullSafe(F.col(c)))
    return both.agg(F.count_if(~F.col("later")).alias("checked"), differ("flipped").alias("flipped_differ"), differ("prefix").alias("prefix_differ"), F.count_if(F.abs(F.col("whole_cum") - F.col("flipped_cum")) > 1e-6).alias("later_differ"))


@query()
def prefix_rebuild(spark, sf_dir):
    """Sampled positions rebuilt from what they may know, by class of fields."""
    return rebuild.prefix_rebuild(a.positions(spark, sf_dir))


@query(("c AS (SELECT c_custkey, upper(' ' || c_name || '@example.invalid ') AS email, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '192.0.2.' || (c_custkey % 200) END AS ip FROM customer), k AS (SELECT ip, count(DISTINCT c_custkey) > 1 AS shared, row_number() OVER (ORDER BY min(c_custkey), ip) - 1 AS n FROM c WHERE ip IS NOT NULL GROUP BY 1)",
        "c_custkey, substr(sha256(lower(trim(email))), 1, 12) AS trader_key, coalesce(shared, FALSE) AS shared, CAST(coalesce(n, -1) AS INTEGER) AS ip_cluster FROM c LEFT JOIN k USING (ip)"))
def sanitised_registrations(spark, sf_dir):
    """Personal columns (made of customer names and documentation addresses) hashed, numbered and dropped."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.upper(F.concat(F.lit(" "), "c_name", F.lit("@example.invalid "))).alias("email"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("192.0.2."), (F.col("c_custkey") % 200).cast("string"))).alias("ip_address"))
    return forensics.sanitised(forensics.shared_addresses(c, "c_custkey", "ip_address", "c_custkey"))


@query((f"{a.POSITIONS}", f"campaign_id, count(*) AS n, count(DISTINCT account_id) AS accounts, {r('net = sum(net_profit)', 'mean_hours = avg(' + SECS.format('close_time', 'open_time') + ' / 3600)')} FROM positions WHERE campaign_id NOT IN (41, 66) GROUP BY 1"))
def campaign_counts(spark, sf_dir):
    p = a.positions(spark, sf_dir).filter(era(F.col("campaign_id"), "all"))
    return p.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("accounts"), F.sum("net_profit").alias("net"), F.avg(seconds(F.col("close_time"), F.col("open_time")) / 3600).alias("mean_hours"))


@query(("c AS (SELECT event_id, try_cast(CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events)", f"event_id, {r('value = CASE WHEN NOT isnan(x) THEN x END')} FROM c"))
def numeric_coercion(spark, sf_dir):
    """Text that isn't a number is missing, and so is NaN."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 13 == 0, "n/a").when(F.col("event_id") % 17 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return e.select("event_id", number(text).alias("value"))


@query((f"{OUTCOME}, g AS (SELECT campaign_id, sum(y) AS s, count(*) AS n FROM o GROUP BY 1), b AS (SELECT * FROM g ORDER BY s DESC, campaign_id DESC LIMIT 1)", f"(SELECT campaign_id FROM b) AS best, round(sum(s), 4) + 0.0 AS total, round(sum(s) - (SELECT s FROM b), 4) + 0.0 AS total_without, {r('mean_without = (sum(s) - (SELECT s FROM b)) / (sum(n) - (SELECT n FROM b))')} FROM g"))
def best_campaign_removed(spark, sf_dir):
    out = compare.best_group_removed(_outcomes(spark, sf_dir), "campaign_id", "y")
    return out.withColumns({c: F.round(c, 4) for c in ("total", "total_without")})


@query((SCORE, f"CASE WHEN fade AND loss_streak >= 2 THEN 'both' WHEN fade THEN 'first only' WHEN loss_streak >= 2 THEN 'second only' ELSE 'neither' END AS selected, count(*) AS n, {r('mean = avg(y)')} FROM d GROUP BY 1"))
def selection_overlap(spark, sf_dir):
    return compare.selection_overlap(_fixed(spark, sf_dir), F.col("decision") == "FADE", F.col("loss_streak") >= 2, "y")


@query(("g AS (SELECT count(*) AS n, count(DISTINCT l_partkey) > 1 AS p, count(DISTINCT l_shipdate) > 1 AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", "count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) FILTER (p) AS l_partkey_differs, count(*) FILTER (s) AS l_shipdate_differs FROM g"))
def duplicate_probe(spark, sf_dir):
    """Candidate keys that repeat, and which cells differ then."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return compare.duplicate_groups(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_shipdate"])


@query((f"{BASE}, b AS (SELECT floor(f_dd_from_peak_usd / 25) AS bin, count(*) AS n FROM features GROUP BY 1)", f"b.bin * 25 AS from_value, b.n, {r('drop = b.n / greatest(coalesce(c.n, 0), 1)::DOUBLE')} FROM b LEFT JOIN b c ON c.bin = b.bin + 1"))
def drawdown_cliff(spark, sf_dir):
    return compare.cliff(f.features(a.positions(spark, sf_dir), ["dd_from_peak_usd"]), "dd_from_peak_usd")


@query((f"""{STATE}, roles(fold, campaign_id, role) AS ({FOLD_SQL}), g AS (SELECT fold, role, least(loss_streak, 4) AS bucket, count(*) AS n, avg(reverse_profit_per_lot) AS m FROM st JOIN roles USING (campaign_id) GROUP BY ALL),
    b AS (SELECT fold, arg_max(bucket, (round(m, 9), bucket)) AS bucket, max(m) AS train_mean FROM g WHERE role = 'train' AND n >= 30 GROUP BY 1)""",
        f"CAST(b.fold AS INTEGER) AS fold, CAST(b.bucket AS BIGINT) AS bucket, {r('train_mean')}, coalesce(v.n, 0) AS val_n, {r('val_mean = v.m')} FROM b LEFT JOIN g v ON v.fold = b.fold AND v.bucket = b.bucket AND v.role = 'validate'"))
def streak_chosen_in_training(spark, sf_dir):
    rows = folds.fold_rows(model_rows(spark, sf_dir), "B")
    return compare.select_then_validate(rows, F.least(F.col("loss_streak"), F.lit(4)).cast("long"), "reverse_profit_per_lot")


@query((f"{STATE}", " UNION ALL ".join(f"SELECT '{x} & {y}' AS state, count(*) AS n, {r('mean = avg(gross_loss_per_lot)', 'se = stddev_samp(gross_loss_per_lot) / sqrt(count(*))')} FROM st WHERE {p} AND {q} HAVING count(*) >= 30" for x, p in (("streak>=1", "loss_streak >= 1"), ("streak>=2", "loss_streak >= 2")) for y, q in (("no stop", "NOT has_sl"), ("grid", "grid_flag"), ("escalated", "lot_ratio_vs_avg > 1.5"))).removeprefix("SELECT ")))
def grid_of_states(spark, sf_dir):
    first = [(f"streak>={n}", F.col("loss_streak") >= n) for n in (1, 2)]
    return compare.grid_states(states(spark, sf_dir), first, [("no stop", ~F.col("has_sl")), ("grid", F.col("grid_flag")), ("escalated", F.col("lot_ratio_vs_avg") > 1.5)], "gross_loss_per_lot")


@query()
def random_in_step(spark, sf_dir):
    """The largest address groups against random accounts of the same campaigns."""
    return compare.random_in_step(with_traders(a.positions(spark, sf_dir), spark, sf_dir), "ip_cluster_id")


@query()
def model_comparison(spark, sf_dir):
    """Two feature sets over purged walk-forward folds and pooled."""
    rows = written(folds.fold_rows(model_rows(spark, sf_dir), "A", FLAGGED), "fold_rows")
    return compare.compare_models(rows, {"size": ["amount", "trade_index"], "streaks": ["amount", "trade_index", "loss_streak", "pnl_ewm", "cum_pnl_usd"]}, "reverse_profit_per_lot")


@query()
def include_decision(spark, sf_dir):
    """Whether streaks and running profit are worth including beside sizes, over walk-forward folds of both tracks, with paired intervals."""
    rows = written(model_rows(spark, sf_dir).filter(F.col("campaign_id").between(DEFAULT.primary_from, DEFAULT.primary_to)), "model_rows")
    splits = folds.windows([x[0] for x in rows.select("campaign_id").distinct().collect()], DEFAULT.fold_count, DEFAULT.least_train_campaigns)
    sizes = ["amount", "trade_index", "size_delta_ratio"]
    cluster = trader_cluster(F.col("trader_key"), F.col("campaign_id"), F.col("account_id"))
    return compare.include_rule(rows, splits, (sizes, ["challenge_type"]), ([*sizes, "loss_streak", "pnl_ewm", "cum_pnl_usd"], ["challenge_type"]), cluster, pairs=FLAGGED)


@query((SCORE, f"decision, name AS \"column\", {r('mean_abs = avg(v)')} FROM (SELECT CASE WHEN fade THEN 'FADE' ELSE 'ABSTAIN' END AS decision, unnest(['num__loss_streak', 'num__cum_pnl_usd', 'num__amount', 'cat__side=BUY', 'cat__side=SELL']) AS name, unnest([abs(c1), abs(c2), abs(c3), abs(c4), abs(c5)]) AS v FROM d) GROUP BY ALL"))
def mean_contributions(spark, sf_dir):
    return compare.mean_contributions(_fixed(spark, sf_dir), FIXED, "decision")
