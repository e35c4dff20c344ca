"""Prices, bracket trades, positions and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.config import DEFAULT, Config, Grid

DAYS = 8


def daily_bars(ticks: DataFrame, ticker: str, at: str, price: str, ident: str) -> DataFrame:
    """One bar of open, high, low and close a ticker and day; ties in time go by ident."""
    when = F.struct(at, ident)
    return ticks.groupBy(F.col(ticker).alias("ticker"), F.to_date(at).alias("trade_date")).agg(F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"))


def horizons(awards: DataFrame, prices: DataFrame, ident: str, ticker: str, date: str, days: int = DAYS, span: int = 22) -> DataFrame:
    """awards with bars: the first `days` bars on or after the date, in order (an array of structs).

    The bars of a ticker are joined by ticker and month, so a long price history isn't read once
    per award: an award meets the months that its span of calendar days touches.
    """
    bars = prices.withColumn("_month", F.trunc("trade_date", "month"))
    months = F.sequence(F.trunc(F.col(date), "month"), F.trunc(F.date_add(date, span), "month"), F.expr("interval 1 month"))
    own = awards.select(F.col(ident).alias("_id"), F.col(ticker).alias("ticker"), F.col(date).alias("_from"), F.explode(months).alias("_month"))
    met = own.join(bars, ["ticker", "_month"]).where((F.col("trade_date") >= F.col("_from")) & (F.col("trade_date") < F.date_add("_from", span)))
    packed = met.groupBy("_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("trade_date", "open", "high", "low", "close"))), 1, days).alias("bars"))  # at most span bars a row
    return awards.join(packed, F.col(ident) == F.col("_id"), "left").drop("_id")


def wide(horizon: DataFrame, days: int = DAYS) -> DataFrame:
    """bars as columns open_t0 .. close_t7."""
    bar = lambda k, name: F.round(F.get("bars", k)[name], 4).alias(f"{name}_t{k}")
    return horizon.select(*(c for c in horizon.columns if c != "bars"), *(bar(k, n) for k in range(days) for n in ("open", "high", "low", "close")))


def simulated(horizon: DataFrame, take: Column | float, stop: Column | float, hold: Column | int) -> DataFrame:
    """horizon with entry, exit_day, exit_price, outcome and pnl_pct of a bracket trade.

    Bought at the first bar's open; from the next bar on, the stop is checked before the target of a
    day; a touched barrier fills at its price; else sold at the close of the hold-th bar, or the
    last there is. No trade where there are fewer than two bars or the open isn't positive.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    take, stop, hold = lit(take), lit(stop), lit(hold)
    df = horizon.where((F.size("bars") >= 2) & (F.get("bars", F.lit(0))["open"] > 0)).withColumn("entry", F.get("bars", F.lit(0))["open"])
    target, floor = F.col("entry") * (1 + take), F.col("entry") * (1 - stop)
    days = F.slice("bars", F.lit(2), F.least(hold, F.size("bars") - 1))
    marks = F.transform(days, lambda b, i: F.when(b["low"] <= floor, F.struct((i + 1).alias("day"), F.lit("SL").alias("outcome"), (-stop).cast("double").alias("gain"))).when(b["high"] >= target, F.struct((i + 1).alias("day"), F.lit("TP").alias("outcome"), take.cast("double").alias("gain"))))
    last = F.element_at(days, -1)
    timed = F.struct(F.size(days).alias("day"), F.lit("TIME").alias("outcome"), F.try_divide(last["close"] - F.col("entry"), F.col("entry")).alias("gain"))
    hit = F.coalesce(F.get(F.filter(marks, lambda m: m.isNotNull()), F.lit(0)), timed)
    out = df.withColumn("_hit", hit)
    return out.select(*df.columns, F.col("_hit.day").alias("exit_day"), F.col("_hit.outcome").alias("outcome"), F.round(F.col("_hit.gain") * 100, 4).alias("pnl_pct"))


def summary(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trades, wins (gains above 0), win rate, total and mean gain, Sharpe ratio, and exits by kind."""
    n, gain = F.count("*"), F.col("pnl_pct")
    sharpe = F.try_divide(F.avg(gain), F.stddev_pop(gain)) * F.sqrt(F.try_divide(F.lit(252.0), n))
    return trades.groupBy(*(by or [])).agg(
        n.alias("n_trades"), F.count_if(gain > 0).alias("n_wins"), F.round(F.try_divide(F.count_if(gain > 0) * 100.0, n), 2).alias("win_rate"), F.round(F.round(F.sum(gain), 4), 2).alias("total_pnl"), F.round(F.round(F.sum(gain), 4) / n, 4).alias("avg_pnl"), F.round(sharpe, 4).alias("sharpe"),
        F.count_if(F.col("outcome") == "TP").alias("exits_tp"), F.count_if(F.col("outcome") == "SL").alias("exits_sl"), F.count_if(F.col("outcome") == "TIME").alias("exits_time"),
    )


def drawdowns(trades: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Running gain and its fall from the highest so far (0 at the start), for each value of by."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("equity", F.sum("pnl_pct").over(w))
    peak = F.greatest(F.lit(0.0), F.max("equity").over(w))
    return run.withColumn("drawdown", F.col("equity") - peak)


def listed(values: tuple, name: str, kind: str = "double") -> Column:
    return F.explode(F.array(*(F.lit(v).cast(kind) for v in values))).alias(name)


def searched(candidates: DataFrame, values: Grid) -> DataFrame:
    """Summary of each parameter combination over candidates (bars, score_total, market_cap), best total first.

    Only the barriers and the holding time change a trade; they are simulated once a candidate. The sums of those
    trades are kept by the highest threshold and the lowest cap that let the candidate in, and a combination adds up
    the sums it lets in: the work doesn't grow with the thresholds and caps tried. Combinations without a trade are left out.
    """
    thresholds, caps = sorted(values.threshold), sorted(values.max_market_cap)
    own = candidates.withColumns({"_t": F.coalesce(*(F.when(F.col("score_total") >= t, k) for k, t in reversed(list(enumerate(thresholds))))), "_c": F.coalesce(*(F.when(F.col("market_cap") <= float(c), k) for k, c in enumerate(caps)))})
    own = own.where("_t is not null and _c is not null").select("bars", "_t", "_c")
    each = own.select("*", listed(values.take_profit, "tp")).select("*", listed(values.stop_loss, "sl")).select("*", listed(values.hold, "hold", "int"))
    gain, exits = F.col("pnl_pct"), {"tp": "TP", "sl": "SL", "time": "TIME"}
    sums = [F.count("*").alias("n"), F.count_if(gain > 0).alias("w"), F.sum(gain).alias("g"), F.sum(gain * gain).alias("q"), *(F.count_if(F.col("outcome") == o).alias(f"x_{k}") for k, o in exits.items())]
    cells = simulated(each, F.col("tp"), F.col("sl"), F.col("hold")).groupBy("tp", "sl", "hold", "_t", "_c").agg(*sums)
    # a cell counts for every threshold up to its own, and every cap from its own on
    levels = lambda v, kind: F.array(*(F.lit(x).cast(kind) for x in v))
    cells = cells.withColumn("threshold", F.explode(F.slice(levels(thresholds, "int"), F.lit(1), F.col("_t") + 1)))
    cells = cells.withColumn("max_mcap", F.explode(F.slice(levels(caps, "double"), F.col("_c") + 1, len(caps))))
    n, total = F.sum("n"), F.sum("g")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - (total / n) * (total / n)))
    out = cells.groupBy("tp", "sl", "hold", "threshold", "max_mcap").agg(
        n.alias("n_trades"), F.sum("w").alias("n_wins"), F.round(F.sum("w") * 100.0 / n, 2).alias("win_rate"), F.round(F.round(total, 4), 2).alias("total_pnl"), F.round(F.round(total, 4) / n, 4).alias("avg_pnl"),
        F.round(F.when(spread > 1e-9, total / n / spread) * F.sqrt(252.0 / n), 4).alias("sharpe"), *(F.sum(f"x_{k}").alias(f"exits_{k}") for k in exits),
    )
    return out.orderBy(F.desc("total_pnl"), "tp", "sl", "hold", "threshold", "max_mcap")


def sized(quotes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Orders: price (ask, else bid), quantity, target and stop; prices above the size or not positive are skipped."""
    price = F.when(F.col("ask") > 0, F.col("ask")).otherwise(F.col("bid"))
    df = quotes.withColumn("price", price).where((F.col("price") > 0) & (F.col("price") <= config.position_size))
    return df.withColumns({"qty": F.greatest(F.lit(1), F.floor(config.position_size / F.col("price"))).cast("bigint"), "take_profit": F.round(F.col("price") * (1 + config.take_profit), 2), "stop_loss": F.round(F.col("price") * (1 - config.stop_loss), 2)})


def stepped(positions: DataFrame, fills: DataFrame, today: Column) -> DataFrame:
    """Positions after one look: open ones whose exit date has come are closed.

    A filled leg (the first with a price) closes as closed_auto, with take_profit where its limit is
    above the entry, else stop_loss; without one the position closes as closed_time with no price,
    no gain and reason auto_closed_unknown. fills: position_id, leg, status, fill_price, limit_price.
    """
    leg = fills.where("status = 'filled' and fill_price > 0").groupBy("position_id").agg(F.min_by(F.struct("fill_price", "limit_price"), "leg").alias("_leg"))
    df = positions.join(leg, "position_id", "left")
    due = (F.col("status") == "open") & (F.col("exit_by") <= today)
    filled = F.col("_leg").isNotNull()
    reason = F.when(~due, F.lit(None).cast("string")).when(~filled, "auto_closed_unknown").when(F.col("_leg.limit_price") > F.col("entry"), "take_profit").otherwise("stop_loss")
    exit_price = F.when(due & filled, F.col("_leg.fill_price")).when(due, 0.0)
    gain = F.when(due & filled, F.round((F.col("_leg.fill_price") - F.col("entry")) * F.col("qty"), 2)).when(due, 0.0)
    status = F.when(due & filled, "closed_auto").when(due, "closed_time").otherwise(F.col("status"))
    return df.withColumns({"reason": reason, "exit_price": exit_price, "pnl": gain, "status": status}).drop("_leg")


def guarded(signals: DataFrame, positions: DataFrame, orders: DataFrame, ticker: str = "ticker") -> DataFrame:
    """signals with `guard`: why one must not be traded; null where it may.

    positions and orders: ticker and status, the answers of two lookups: open, closed, or failed. A failed position
    lookup rejects, since a position may be there; a failed order lookup lets through.
    """
    state = lambda df, name: df.where("status in ('open', 'failed')").groupBy(ticker).agg(F.max(F.col("status") == "open").alias(f"_{name}"))
    both = signals.join(state(positions, "position"), ticker, "left").join(state(orders, "order"), ticker, "left")
    guard = F.when(F.col("_position"), "position already open").when(~F.col("_position"), "position lookup failed").when(F.col("_order"), "open order already exists")
    return both.withColumn("guard", guard).drop("_position", "_order")


def not_held(signals: DataFrame, positions: DataFrame, orders: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The signals that `guarded` lets through."""
    return guarded(signals, positions, orders, ticker).where("guard is null").drop("guard")
