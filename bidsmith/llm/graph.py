"""Connected components by alternating large and small stars, each round cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import cut

SALT = 16


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link and isn't the root itself.

    links: columns a and b. Groups are only ever reduced to their minimum before a shuffle, and joins with
    those minima deal each node's links into SALT parts, each of which meets a copy of the minimum: a node
    with very many links is no large task. Ends when a round changes nothing.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = cut(small, "links", links)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return links.toDF("node", "root")
        mark = now


def _with(links: DataFrame, low: DataFrame) -> DataFrame:
    """links with the minimum of their node."""
    copies = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).hint("merge").join(copies, ["a", "salt"])
