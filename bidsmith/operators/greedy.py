"""Order-dependent greedy clusters without one loop a group.

In order, an item joins the first earlier head that is like it, or becomes a head. Which items are alike is found by
similarity joins, once; then all items decide in rounds: one whose earlier likes are all decided, or one of whose likes is known to be
a head, is decided itself. That is the same choice, made side by side, in as many rounds as the longest chain of items that wait
for one another, which in most data is a few. Equal items are one: a later copy goes where the first of them is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.sources.sinks import settled


def joined(links: DataFrame) -> DataFrame | None:
    """(later, head): of links (earlier, later) between alike items, those that join a head, and the least one.

    earlier and later are of one type, ordered as the items are. None where there are no links.
    """
    every = left = settled(links.select("earlier", "later").distinct(), "links")
    followers = None
    while left.take(1):
        heads = left.select("earlier").distinct().join(left.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        new = settled(left.join(heads, "earlier").select("later").distinct(), "followers")
        followers = new if followers is None else followers.union(new)
        left = settled(left.join(new, "later", "left_anti").join(new.toDF("earlier"), "earlier", "left_anti"), "links")
    if followers is None:
        return None
    followers = settled(followers, "followers")
    return every.join(followers, "later").join(followers.toDF("earlier"), "earlier", "left_anti").groupBy("later").agg(F.min("earlier").alias("head"))


def near_hashes(items: DataFrame, group: str, order: str, simhash: str, radius: int = 3) -> DataFrame:
    """(earlier, later) pairs of items within radius bits: two such 64-bit numbers agree in one of radius + 1 blocks. items: one a hash and group."""
    wide = 64 // (radius + 1)
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(simhash, k * wide).bitwiseAND(F.lit((1 << (wide if k < radius else 64 - radius * wide)) - 1)).alias("part")) for k in range(radius + 1)))
    cut = items.select(group, F.col(order).alias("at"), F.col(simhash).alias("h"), F.inline(blocks))
    a, b = cut.alias("a"), cut.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("block", "part")] + [F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))]
    gap = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    return a.join(b, [*same, F.col("a.at") < F.col("b.at"), gap <= radius]).select(F.col(f"a.{group}").alias(group), F.col("a.at").alias("earlier"), F.col("b.at").alias("later")).distinct()


def alike_sets(items: DataFrame, group: str, order: str, words: str, least: float) -> DataFrame:
    """(earlier, later) pairs of items whose word sets share more than `least`: such sets share one of their few rarest words. items: one a set and group."""
    sets = settled(items.where(F.size(words) > 0).select(F.col(group).alias("_group"), F.col(order).alias("at"), F.col(words).alias("set")), "sets")
    # rows a word carry a hash of it, not the set; two words of one hash would be one here, and sets are compared afterwards
    each = sets.select("_group", "at", F.size("set").alias("n"), F.explode("set").alias("_word")).select("_group", "at", "n", F.xxhash64("_word").alias("word"))
    often = each.withColumn("often", F.count("*").over(Window.partitionBy("_group", "word")))
    rare = F.row_number().over(Window.partitionBy("_group", "at").orderBy("often", "word"))  # a row a word of one item
    kept = often.withColumn("r", rare).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("often") > 1)).select("_group", "at", "n", "word")
    held = settled(kept, "rare")
    a, b = held.alias("a"), held.alias("b")
    sizes = (F.col("b.n") >= F.col("a.n") * least) & (F.col("a.n") >= F.col("b.n") * least)
    met = a.join(b, [F.col("a.word") == F.col("b.word"), F.col("a._group").eqNullSafe(F.col("b._group")), F.col("a.at") < F.col("b.at"), sizes])
    pairs = met.select("a._group", F.col("a.at").alias("earlier"), F.col("b.at").alias("later")).distinct()
    for end in ("earlier", "later"):
        of = sets.select(F.col("_group").alias("_own"), F.col("at").alias("_at"), F.col("set").alias(f"_{end}"))
        pairs = pairs.join(of, F.col("_group").eqNullSafe(F.col("_own")) & (F.col(end) == F.col("_at"))).drop("_own", "_at")
    both = F.size(F.array_intersect("_earlier", "_later"))
    alike = both / (F.size("_earlier") + F.size("_later") - both) > least
    return pairs.where(alike).select(F.col("_group").alias(group), "earlier", "later")


def headed(items: DataFrame, group: str, order: str, same: Column, links, apart: Column | None = None) -> DataFrame:
    """items with `head`: the order of the head of each one's cluster (its own where it is one).

    order: differs within a group. same: equal for equal items. links: of (distinct items) to (group, earlier, later). apart: items that are like none.
    """
    own = settled(items.withColumn("_same", same).withColumn("_apart", F.coalesce(apart, F.lit(False)) if apart is not None else F.lit(False)), "items")
    keys = [F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("_g"), F.col("_same")]
    first = own.where("not _apart").groupBy(group, "_same").agg(F.min_by(F.struct(*(c for c in own.columns if c not in ("_same", group))), order).alias("x")).select(group, "_same", "x.*")
    ident = F.struct(F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("g"), F.col(order).alias("o"))
    pair = lambda c: F.struct(F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("g"), F.col(c).alias("o")).alias(c)
    found = joined(links(first).select(pair("earlier"), pair("later")))
    heads = first.withColumn("_id", ident)
    heads = heads.join(found, F.col("_id") == F.col("later"), "left").withColumn("head", F.coalesce("head.o", F.col(order))) if found is not None else heads.withColumn("head", F.col(order))
    classes = heads.select(*keys, "head")
    marked = own.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    return marked.where("not _apart").join(classes, ["_g", "_same"]).unionByName(marked.where("_apart").withColumn("head", F.col(order))).drop("_g", "_same", "_apart")


def simhash_clusters(items: DataFrame, group: str, order: str, simhash: str, radius: int = 3) -> DataFrame:
    """items with `cluster`: the number, from 0 within the group, of the first earlier head within radius bits, else of the item itself."""
    marked = headed(items, group, order, F.col(simhash), lambda first: near_hashes(first, group, order, simhash, radius))
    number = marked.where(F.col("head") == F.col(order)).select(F.col(group).alias("_group"), F.col("head").alias("_head"), (F.row_number().over(Window.partitionBy(group).orderBy("head")) - 1).alias("cluster"))
    return marked.join(number, F.col(group).eqNullSafe(F.col("_group")) & (F.col("head") == F.col("_head"))).drop("_group", "_head", "head")
