"""Caches and memories: eviction, fallback, greedy merging, priced components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.operators.greedy import alike_sets, headed


def evicted(cache: DataFrame, group: str, at: str, ident: str, capacity: int, share: float = 0.1) -> DataFrame:
    """What a cache over capacity loses: its oldest entries, at least a tenth of the capacity, until it fits."""
    w = Window.partitionBy(group)
    df = cache.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(at, ident))})
    lost = F.greatest(F.col("_n") - capacity, F.floor(F.lit(capacity * share)).cast("bigint"))
    return df.where((F.col("_n") > capacity) & (F.col("_r") <= lost)).drop("_n", "_r")


def first_given(*columns: Column) -> Column:
    """The first setting that is given, in order of precedence; INFO where none is."""
    return F.coalesce(*columns, F.lit("INFO"))


def recalled(text: Column, facts: Column) -> Column:
    """Share of the facts that the text holds, in any case; 1 where there are none."""
    own = F.lower(F.coalesce(text, F.lit("")))
    found = F.size(F.filter(facts, lambda f: F.contains(own, F.lower(f))))
    return F.when(F.size(facts) == 0, 1.0).otherwise(F.try_divide(found.cast("double"), F.size(facts).cast("double")))


def components_priced(usage: DataFrame, model: str, prices: DataFrame, parts: list[str]) -> DataFrame:
    """usage with a cost struct of each part (tokens times price a million) and the total; null where the model has no prices.

    prices: one row a model, columns price_<part>.
    """
    own = usage.join(prices, model, "left")
    costs = [(F.col(p) * F.col(f"price_{p}") / 1e6).alias(p) for p in parts]
    total = sum((F.coalesce(F.col(p) * F.col(f"price_{p}") / 1e6, F.lit(0.0)) for p in parts), F.lit(0.0))
    known = F.lit(True)
    for p in parts:
        known = known & F.col(f"price_{p}").isNotNull()
    return own.select(*usage.columns, F.when(known, F.struct(*costs, total.alias("total"))).alias("cost"))


def merged(entries: DataFrame, group: str, order: str, text: str, importance: str, accesses: str, refs: str, least: float = 0.85) -> DataFrame:
    """Per group, entries in order join the first earlier head whose word set is more alike than `least`.

    Of those that joined, the most important one stays (the first of equals), with the most accesses and all refs of them,
    sorted; an entry without words joins none. order differs within a group. Which entry joins which depends on the order;
    `greedy.headed` decides all of them side by side.
    """
    words = F.sort_array(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")))
    own = entries.select(group, order, F.col(importance).cast("double").alias(importance), F.col(accesses).cast("bigint").alias(accesses), refs, words.alias("_words"))
    marked = headed(own, group, order, F.col("_words"), lambda first: alike_sets(first, group, order, "_words", least), F.size("_words") == 0)
    best = F.min_by(F.struct(order, importance), F.struct((-F.col(importance)).alias("i"), F.col(order).alias("o")))
    every = F.flatten(F.collect_list(F.coalesce(refs, F.array().cast("array<string>"))))
    made = marked.groupBy(group, "head").agg(best.alias("_best"), F.max(accesses).alias(accesses), F.sort_array(F.array_distinct(every)).alias(refs), F.count("*").alias("n_merged"))
    return made.select(group, f"_best.{order}", f"_best.{importance}", accesses, refs, "n_merged")
