r"""Importance resampling towards a target: position-table n-grams, hashed into buckets, weighed by log ratios.

Words are exploded with their positions; for orders above one, lead() over a document's positions joins each word
with those that follow it. Runs are hashed into buckets; the corpus's and the target's bucket counts give each bucket
a gain, a document's weight is the sum of its runs' gains, and Gumbel noise drawn from the key makes "the best scores"
a sample without replacement. Everything is DataFrame operations: words are added up within the task that reads
their text, so only bucket counts and a row a document are shuffled (for higher orders also the texts, by row, before
they are exploded); gains are as many rows as buckets, whatever the tables' size.

Defined results: null, empty or wordless texts have no features and weight 0, and are never drawn; rows of one doc_id are
documents of their own; a null doc_id has the noise of an empty key and comes first among equal scores; equal scores
go by doc_id, then by weight and features, and rows alike in all of these in any order; an empty table gives no rows, an empty
target weighs by the corpus alone; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.llm.common import cut
from bidsmith.llm.sharding import ranked

#: Fixed: words, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; ASCII texts take the shorter way to the same letters."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(WORD), F.lit(0))


def runs(texts: DataFrame, order: int, buckets: int, *keys: str) -> DataFrame:
    """A row for each run of 1 to order words: the keys, the run's length `n` and its bucket.

    A text without words has one row without a bucket. keys: columns that tell the texts apart, the first a row's own.
    """
    if order > 1:
        texts = texts.repartition(keys[0])  # texts, not their words, are dealt for the window below
    table = texts.select(*keys, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    if order > 1:
        line = Window.partitionBy(keys[0]).orderBy("pos")
        following = [F.lead("word", k).over(line).alias(f"w{k}") for k in range(1, order)]
        table = table.select(*keys, "word", *following)
        made = [F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", "word", *(f"w{i}" for i in range(1, k + 1)))) for k in range(1, order)]
        table = table.select(*keys, F.posexplode(F.array("word", *made)).alias("n", "word")).where((F.col("n") == 0) | F.col("word").isNotNull())
    else:
        table = table.withColumn("n", F.lit(0))
    return table.select(*keys, (F.col("n") + 1).alias("n"), (F.crc32(F.col("word").cast("binary")) % buckets).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log of the target's smoothed share over the corpus's, floored; a row a bucket."""

    def counted(texts: DataFrame, name: str) -> DataFrame:
        found = runs(texts.select(F.monotonically_increasing_id().alias("_row"), "text"), order, buckets, "_row")
        return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    both = docs.sparkSession.range(buckets).toDF("bucket").join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0)
    every = Window.partitionBy(F.lit(0))  # as many rows as buckets
    s, t, n = F.col("s").cast("double"), F.col("t").cast("double"), F.lit(float(buckets))
    whole_s, whole_t = F.sum("s").over(every).cast("double"), F.sum("t").over(every).cast("double")
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (whole_s + n) / ((s + 1) * (whole_t + n)))).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, decided by key and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that aren't drawn.

    percent of the documents with least_words words or more are drawn, those of the highest scores.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gain = cut(gains(docs.select("text"), target.select("text"), order, buckets), "gains")
    weighed = runs(own, order, buckets, "_row", "doc_id").join(F.broadcast(gain), "bucket", "left")  # buckets rows
    sums = weighed.groupBy("_row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("bigint").alias("weight"), F.count(F.when(F.col("n") == 1, F.col("bucket"))).alias("_words"))
    scored = cut(sums.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("bigint").alias("score"), (F.col("_words") < least_words).alias("_short")), "weights", gain)
    fit = scored.where(~F.col("_short")).count()
    order_by = ["_short", "_low", "doc_id", "weight", "n_features"]
    placed = ranked(scored.withColumns({"_low": -F.col("score"), "_one": F.lit(1).cast("bigint")}), order_by, "_one")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("before") < percent * fit // 100, F.col("before") + 1).cast("bigint").alias("rank"))
