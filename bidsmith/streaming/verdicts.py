"""The live verdict as a stream: awards meet the facts of the days before them, both as they arrive.

Awards and facts are streams with watermarks. A left outer join by company and time gives each award its facts, and a
null row once the watermark says that none can come any more; an aggregation by award then sets the flags. State is
the facts of the longest window and the awards that are waiting, whatever the streams' length. A verdict comes when both
streams have passed the award's time by their delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(awards: DataFrame, facts: DataFrame, ident: str, key: str, at: str, then: str, kinds: dict[str, tuple[Column, int]], delay: str = "1 day") -> DataFrame:
    """Streaming awards with a flag for each kind: whether some fact of that kind (same key) lies within its days before `at`, by day.

    kinds: a condition on the facts' columns and days, as in `joins.having`. `at` and `then` are timestamps. Every other column of awards must be
    decided by ident. Awards with a null key come with all flags false; awards and facts later than `delay` are dropped.
    """
    most = max(days for _, days in kinds.values())
    own = awards.withWatermark(at, delay)
    marks = facts.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(then).alias("_then"), *(F.coalesce(c, F.lit(False)).alias(f"_{k}") for k, (c, _) in kinds.items()))
    marks = marks.where(" or ".join(f"_{k}" for k in kinds)).withWatermark("_then", delay)
    # whole days: a fact of the same day counts even if it is later in it
    near = (F.col(key) == F.col("_key")) & (F.col("_then") >= F.col(at) - F.expr(f"interval {most + 1} days")) & (F.col("_then") <= F.col(at) + F.expr("interval 1 day"))
    both = own.join(marks, near, "left_outer")
    gap = F.datediff(at, "_then")
    flags = [F.coalesce(F.max(F.col(f"_{k}") & gap.between(0, days)), F.lit(False)).alias(k) for k, (_, days) in kinds.items()]
    rest = [c for c in awards.columns if c not in (ident, at)]
    met = both.groupBy(at, ident, *rest).agg(*flags)  # `at` carries the watermark that lets a group out
    return met.select(*awards.columns, *kinds)
