"""Trade queries: bars from events, horizons, bracket trades, backtests and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.config import Grid
from bidsmith.operators import trades as T
from bidsmith.plans.registry import query, table

#: The market caps of the given tables are about a 400th of real ones.
VALUES = Grid(max_market_cap=tuple(c / 400 for c in Grid().max_market_cap))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return T.daily_bars(table(spark, d, "events"), "user_id", "ts", "value", "event_id")


BARS = "bars AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2)"


@query(f"WITH {BARS} SELECT * FROM bars")
def ohlc_daily(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


def horizon(spark: SparkSession, d: str) -> DataFrame:
    """Awards are purchases; the score stands for the award's total, the cap for the company's."""
    own = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("posted"), (F.col("event_id") % 101).cast("int").alias("score_total"), ((F.col("user_id") % 50 + 1) * 100_000.0).alias("market_cap"))
    return T.horizons(own, bars(spark, d), "event_id", "user_id", "posted")


NUMBERED = f"""WITH {BARS}, own AS (SELECT event_id, user_id, CAST(ts AS DATE) AS posted, CAST(event_id % 101 AS INT) AS score_total, (user_id % 50 + 1) * 100000.0::DOUBLE AS market_cap FROM events WHERE event_type = 'purchase'),
 met AS (SELECT o.*, b.trade_date, b.open, b.high, b.low, b.close, row_number() OVER (PARTITION BY o.event_id ORDER BY b.trade_date) - 1 AS k FROM own o JOIN bars b ON o.user_id = b.ticker AND b.trade_date >= o.posted AND b.trade_date < o.posted + 22), h AS (SELECT * FROM met WHERE k < 8)"""


@query(NUMBERED + " SELECT o.event_id, " + ", ".join(f"round(max(CASE WHEN k = {k} THEN {n} END), 4) AS {n}_t{k}" for k in range(8) for n in ("open", "high", "low", "close")) + " FROM own o LEFT JOIN h ON o.event_id = h.event_id GROUP BY 1")
def ohlc_horizon_pivot(spark: SparkSession, d: str) -> DataFrame:
    return T.wide(horizon(spark, d)).drop("user_id", "posted", "score_total", "market_cap")


def _simulated(keys: str = "", tp: str = "0.20", sl: str = "0.06", hold: str = "3", where: str = "TRUE", source: str = "own") -> str:
    """CTEs that give `sim`: one row a trade, with exit_day, outcome and gain."""
    k = f", {keys}" if keys else ""
    j = "".join(f" AND h.{x} = e.{x}" for x in keys.split(", ") if x)
    return f"""{NUMBERED}, {source if source != "own" else "cand AS (SELECT * FROM own)"}, e AS (SELECT c.event_id{k}, c.score_total, b.open AS entry, b.n FROM cand c JOIN (SELECT event_id, max(CASE WHEN k = 0 THEN open END) AS open, count(*) AS n FROM h GROUP BY 1) b ON b.event_id = c.event_id WHERE {where} AND b.n >= 2 AND b.open > 0),
 m AS (SELECT e.*, h.k, h.close, CASE WHEN h.low <= e.entry * (1 - {sl}) THEN 'SL' WHEN h.high >= e.entry * (1 + {tp}) THEN 'TP' END AS mark FROM e JOIN h ON h.event_id = e.event_id AND h.k BETWEEN 1 AND {hold}),
 s AS (SELECT event_id{k}, any_value(entry) AS entry, min(CASE WHEN mark IS NOT NULL THEN k END) AS hit, arg_min(mark, k) FILTER (mark IS NOT NULL) AS mark, max(k) AS last_k, arg_max(close, k) AS last_close FROM m GROUP BY event_id{k}),
 sim AS (SELECT event_id{k}, coalesce(hit, last_k) AS exit_day, coalesce(mark, 'TIME') AS outcome, round(CASE mark WHEN 'SL' THEN -CAST({sl} AS DOUBLE) WHEN 'TP' THEN CAST({tp} AS DOUBLE) ELSE (last_close - entry) / entry END * 100, 4) AS pnl_pct FROM s)"""


#: Gains have four decimals, so their sum is a whole number of ten-thousandths, and a half is rounded up exactly.
_HALF_UP = "CAST(sign(round(sum(pnl_pct) * 10000)) * ((2 * abs(CAST(round(sum(pnl_pct) * 10000) AS BIGINT)) + {n}) // (2 * {n})) AS DOUBLE) / {d}"
SUMMARY = f"""count(*) AS n_trades, count(*) FILTER (pnl_pct > 0) AS n_wins, round(count(*) FILTER (pnl_pct > 0) * 100.0::DOUBLE / count(*), 2) AS win_rate, {_HALF_UP.format(n='100', d='100.0')} AS total_pnl, {_HALF_UP.format(n='count(*)', d='10000.0')} AS avg_pnl,
 round(avg(pnl_pct) / nullif(stddev_pop(pnl_pct), 0) * sqrt(252.0::DOUBLE / count(*)), 4) AS sharpe, count(*) FILTER (outcome = 'TP') AS exits_tp, count(*) FILTER (outcome = 'SL') AS exits_sl, count(*) FILTER (outcome = 'TIME') AS exits_time"""


@query(_simulated() + " SELECT event_id, CAST(exit_day AS INT) AS exit_day, outcome, pnl_pct FROM sim")
def bracket_sim(spark: SparkSession, d: str) -> DataFrame:
    return T.simulated(horizon(spark, d), 0.20, 0.06, 3).select("event_id", "exit_day", "outcome", "pnl_pct")


@query(_simulated(where="c.score_total >= 30 AND c.market_cap <= 2000000") + f" SELECT {SUMMARY} FROM sim")
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    picked = horizon(spark, d).where("score_total >= 30 and market_cap <= 2000000")
    return T.summary(T.simulated(picked, 0.20, 0.06, 3))


@query(_simulated() + " SELECT outcome, CAST(exit_day AS INT) AS exit_day, count(*) AS n, round(avg(pnl_pct), 4) AS avg_pnl FROM sim GROUP BY 1, 2")
def exit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return T.simulated(horizon(spark, d), 0.20, 0.06, 3).groupBy("outcome", "exit_day").agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl"))


@query(_simulated() + """, r AS (SELECT o.user_id, sim.event_id, sum(pnl_pct) OVER w AS equity FROM sim JOIN own o ON o.event_id = sim.event_id WINDOW w AS (PARTITION BY o.user_id ORDER BY sim.event_id)),
 q AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY user_id ORDER BY event_id)) AS peak FROM r) SELECT user_id, round(min(equity - peak), 2) AS max_drawdown, round(arg_max(equity, event_id), 2) AS final FROM q GROUP BY 1""")
def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    run = T.drawdowns(T.simulated(horizon(spark, d), 0.20, 0.06, 3), "user_id", ["event_id"])
    return run.groupBy("user_id").agg(F.round(F.min("drawdown"), 2).alias("max_drawdown"), F.round(F.max_by("equity", "event_id"), 2).alias("final"))


_LIST = lambda v: "(VALUES " + ", ".join(f"({x})" for x in v) + ")"
GRID = f"""cand AS (SELECT own.*, tp, sl, hold, threshold, max_mcap FROM own, {_LIST(VALUES.take_profit)} a(tp), {_LIST(VALUES.stop_loss)} b(sl), {_LIST(VALUES.hold)} c(hold), {_LIST(VALUES.threshold)} t(threshold), {_LIST(VALUES.max_market_cap)} x(max_mcap))"""


@query(_simulated("tp, sl, hold, threshold, max_mcap", "e.tp", "e.sl", "e.hold", "c.score_total >= c.threshold AND c.market_cap <= c.max_mcap", GRID).replace("-CAST(e.sl AS DOUBLE)", "-CAST(sl AS DOUBLE)").replace("THEN CAST(e.tp AS DOUBLE)", "THEN CAST(tp AS DOUBLE)") + f" SELECT CAST(tp AS DOUBLE) AS tp, CAST(sl AS DOUBLE) AS sl, hold, threshold, CAST(max_mcap AS DOUBLE) AS max_mcap, {SUMMARY} FROM sim GROUP BY ALL")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    return T.searched(horizon(spark, d), VALUES)


QUOTE = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice / 8 END AS ask, p_retailprice / 8 - 1 AS bid FROM part"


@query(f"SELECT p_partkey, price, CAST(greatest(1, floor(200 / price)) AS BIGINT) AS qty, CAST(CAST(CAST(price * (1 + 0.08::DOUBLE) AS VARCHAR) AS DECIMAL(18, 2)) AS DOUBLE) AS take_profit, CAST(CAST(CAST(price * (1 - 0.07::DOUBLE) AS VARCHAR) AS DECIMAL(18, 2)) AS DOUBLE) AS stop_loss FROM (SELECT p_partkey, CASE WHEN ask > 0 THEN ask ELSE bid END AS price FROM ({QUOTE})) WHERE price > 0 AND price <= 200")
def position_sizing(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice") / 8
    quotes = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise(p).alias("ask"), (p - 1).alias("bid"))
    return T.sized(quotes).select("p_partkey", "price", "qty", "take_profit", "stop_loss")


def cents(x: Column) -> Column:
    """x to two places, as SQL rounds a double: the product with 100 is rounded, so 264.025, which is a little less in binary, goes down."""
    return F.round(x * 100, 0) / 100


def positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    held = o.select(F.col("o_orderkey").alias("position_id"), F.when(F.col("o_orderstatus") == "F", "closed_auto").otherwise("open").alias("status"), F.to_date("o_orderdate").alias("exit_by"), cents(F.col("o_totalprice") / 1000).alias("entry"), (F.col("o_custkey") % 9 + 1).alias("qty"))
    fills = line.select(F.col("l_orderkey").alias("position_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("leg"), F.when(F.col("l_returnflag") == "R", "filled").otherwise("new").alias("status"), cents(F.col("l_extendedprice") / 200).alias("fill_price"), cents(F.col("l_extendedprice") / 190).alias("limit_price"))
    return held, fills


@query("""WITH p AS (SELECT o_orderkey AS position_id, CASE WHEN o_orderstatus = 'F' THEN 'closed_auto' ELSE 'open' END AS status, CAST(o_orderdate AS DATE) AS exit_by, round(o_totalprice / 1000, 2) AS entry, o_custkey % 9 + 1 AS qty FROM orders),
 f AS (SELECT l_orderkey AS position_id, arg_min(round(l_extendedprice / 200, 2), l_linenumber * 1000000 + l_partkey) AS fill, arg_min(round(l_extendedprice / 190, 2), l_linenumber * 1000000 + l_partkey) AS lim FROM lineitem WHERE l_returnflag = 'R' AND round(l_extendedprice / 200, 2) > 0 GROUP BY 1),
 j AS (SELECT p.*, fill, lim, status = 'open' AND exit_by <= DATE '1998-06-01' AS due FROM p LEFT JOIN f ON f.position_id = p.position_id)
 SELECT position_id, CASE WHEN due AND fill IS NOT NULL THEN 'closed_auto' WHEN due THEN 'closed_time' ELSE status END AS status, CASE WHEN NOT due THEN NULL WHEN fill IS NULL THEN 'auto_closed_unknown' WHEN lim > entry THEN 'take_profit' ELSE 'stop_loss' END AS reason,
 CASE WHEN due AND fill IS NOT NULL THEN fill WHEN due THEN 0.0 END AS exit_price FROM j""")
def position_transition(spark: SparkSession, d: str) -> DataFrame:
    held, fills = positions(spark, d)
    return T.stepped(held, fills, F.to_date(F.lit("1998-06-01"))).select("position_id", "status", "reason", "exit_price")


@query("""WITH p AS (SELECT o_orderkey AS position_id, CASE WHEN o_orderstatus = 'F' THEN 'closed_auto' ELSE 'open' END AS status, CAST(o_orderdate AS DATE) AS exit_by, round(o_totalprice / 1000, 2) AS entry, o_custkey % 9 + 1 AS qty FROM orders),
 f AS (SELECT l_orderkey AS position_id, arg_min(round(l_extendedprice / 200, 2), l_linenumber * 1000000 + l_partkey) AS fill, arg_min(round(l_extendedprice / 190, 2), l_linenumber * 1000000 + l_partkey) AS lim FROM lineitem WHERE l_returnflag = 'R' AND round(l_extendedprice / 200, 2) > 0 GROUP BY 1)
 SELECT CASE WHEN fill IS NULL THEN 'auto_closed_unknown' WHEN lim > entry THEN 'take_profit' ELSE 'stop_loss' END AS reason, count(*) AS n, round(sum(coalesce((fill - entry) * qty, 0)), 0) AS pnl FROM p LEFT JOIN f ON f.position_id = p.position_id WHERE status = 'open' AND exit_by <= DATE '1998-06-01' GROUP BY 1""")
def pnl(spark: SparkSession, d: str) -> DataFrame:
    held, fills = positions(spark, d)
    return T.stepped(held, fills, F.to_date(F.lit("1998-06-01"))).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum(F.col("pnl").cast("decimal(18,2)")), 0).cast("double").alias("pnl"))  # cents, so in any order the same sum


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def position_guard(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    mark = lambda c: o.select("c_custkey", F.when(c, "open").otherwise("closed").alias("status"))
    return T.not_held(table(spark, d, "customer").select("c_custkey"), mark(F.col("o_orderstatus") == "O"), mark(F.col("o_orderpriority") == "1-URGENT"), "c_custkey")
