"""Order, rank and duplicates: top-k, keyset pages, keep-first, consecutive lines, date chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; order must be total. Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def page_after(df: DataFrame, amount: str, ident: str, last: tuple[float, int], size: int) -> DataFrame:
    """The page after (amount, ident) in ascending order: a predicate, not an offset."""
    a, i = last
    return df.where((F.col(amount) > a) | ((F.col(amount) == a) & (F.col(ident) > i))).orderBy(amount, ident).limit(size)


def keep_first(df: DataFrame, group: str, ident: str, order: list[Column]) -> DataFrame:
    """The first row of each ident within a group; rows with a blank ident all stay."""
    blank = F.coalesce(F.trim(ident), F.lit("")) == ""
    first = df.where(~blank).withColumn("_r", F.row_number().over(Window.partitionBy(group, ident).orderBy(*order))).where("_r = 1").drop("_r")
    return first.unionByName(df.where(blank))


def consecutive(df: DataFrame, stream: str, order: list[str], line: str) -> DataFrame:
    """Rows whose line differs from the one before it in its stream."""
    before = F.lag(line).over(Window.partitionBy(stream).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(stream).orderBy(*order)) == 1
    return df.withColumns({"_before": before, "_first": first}).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(line))).drop("_before", "_first")


def repeated_lines(df: DataFrame, line: str) -> DataFrame:
    return df.groupBy(line).count().where("count > 1")


def prior_count(df: DataFrame, keys: list[str], order: list[str], name: str = "prior_wins") -> DataFrame:
    """How many rows of the same keys come before."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def date_chunks(df: DataFrame, start: str, end: str, days: int = 14) -> DataFrame:
    """Ranges of days + 1 dates from start; a range that would begin at end is left out."""
    starts = F.when(F.col(start) < F.col(end), F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"interval {days + 1} days")))
    return df.withColumn("chunk_start", F.explode(starts)).withColumn("chunk_end", F.least(F.date_add("chunk_start", days), F.col(end)))


def sessions_after(df: DataFrame, start: str, calendar: DataFrame, session: str, n: int) -> DataFrame:
    """df with exit_by: the n-th session (0 is the first) on or after start; null where the first is more than ten days off.

    calendar: the exchange's sessions. Each session is joined by the days whose first one it is: an equality, no range.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("_s")  # one row a trading day: bounded by time
    listed = calendar.select(F.to_date(session).alias("_s")).where("_s is not null").distinct()
    served = listed.select("_s", F.lag("_s").over(line).alias("_before"), F.lead("_s", n).over(line).alias("exit_by"))
    first = F.greatest(F.date_add("_before", 1), F.date_sub("_s", 10))  # without the null of the first session
    days = served.select(F.explode(F.sequence(first, F.col("_s"))).alias("_day"), "exit_by")
    return df.join(days, F.to_date(start) == F.col("_day"), "left").drop("_day")


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert by key: the last row written stays."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
