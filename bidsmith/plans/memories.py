"""Queries over caches, memories and prices made from events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.functions import text as X
from bidsmith.operators import memory as M
from bidsmith.operators import relevance as R
from bidsmith.operators.filters import meets
from bidsmith.plans.registry import query, table
from bidsmith.sources.readers import company_hits


@query("""SELECT event_type, event_id FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE n > 50 AND r <= greatest(n - 50, 5)""")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    return M.evicted(table(spark, d, "events"), "event_type", "ts", "event_id", 50).select("event_type", "event_id")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'DEBUG' END, CASE WHEN event_id % 3 = 0 THEN 'ERROR' END, CASE WHEN event_id % 7 = 0 THEN 'WARNING' END, 'INFO') AS level FROM events")
def level_precedence(spark: SparkSession, d: str) -> DataFrame:
    given = lambda k, v: F.when(F.col("event_id") % k == 0, v)
    return table(spark, d, "events").select("event_id", M.first_given(given(5, "DEBUG"), given(3, "ERROR"), given(7, "WARNING")).alias("level"))


@query("""SELECT conv_id, turn, round((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), role) AS INT)) / 3.0::DOUBLE, 6) AS recall FROM conversations""")
def fact_recall(spark: SparkSession, d: str) -> DataFrame:
    facts = F.array(F.lit("The"), F.lit("QUE"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(M.recalled(F.col("text"), facts), 6).alias("recall"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN round((event_id % 1000 * (CASE event_type WHEN 'click' THEN 3.0 ELSE 0.25 END) + event_id % 300 * (CASE event_type WHEN 'click' THEN 15.0 ELSE 1.25 END) + event_id % 50 * (CASE event_type WHEN 'click' THEN 0.3 ELSE 0.025 END))::DOUBLE / 1e6, 9) END AS cost FROM events""")
def priced_components(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 3.0, 15.0, 0.3), ("view", 0.25, 1.25, 0.025)], "event_type string, price_sent double, price_got double, price_cached double")
    k = F.col("event_id")
    usage = table(spark, d, "events").select("event_id", "event_type", (k % 1000).alias("sent"), (k % 300).alias("got"), (k % 50).alias("cached"))
    return M.components_priced(usage, "event_type", prices, ["sent", "got", "cached"]).select("event_id", F.round("cost.total", 9).alias("cost"))


@query("""SELECT count(*) AS n_conversations, CAST(sum(n) AS BIGINT) AS n_turns, round(avg(n), 4) AS mean_turns, CAST(max(n) AS BIGINT) AS longest, CAST(sum(u) AS BIGINT) AS n_user FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1)""")
def nested_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts over conversations kept as nested arrays of turns."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    n = F.size("turns")
    return nested.agg(F.count("*").alias("n_conversations"), F.sum(n).alias("n_turns"), F.round(F.avg(n), 4).alias("mean_turns"), F.max(n).cast("bigint").alias("longest"), F.sum(F.size(F.filter("turns", lambda t: t["role"] == "user"))).alias("n_user"))


@query("""WITH RECURSIVE f AS (SELECT conv_id, turn, text, length(text) // 4 + 10 AS cost, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn DESC) AS k FROM conversations), e AS (SELECT conv_id, turn, cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM f WHERE k = 1),
 s(conv_id, r, used, kept) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e UNION ALL SELECT s.conv_id, e.r, CASE WHEN s.used + e.cost <= 300 THEN s.used + e.cost ELSE s.used END, CASE WHEN s.used + e.cost <= 300 THEN s.kept + 1 ELSE s.kept END FROM s JOIN e ON e.conv_id = s.conv_id AND e.r = s.r + 1)
 SELECT conv_id, max(used) AS used, max(kept) AS kept FROM s GROUP BY 1""")
def memory_export(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, one of each content, as many as a budget of tokens takes."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("text"))
    once = R.first_of_content(c.withColumn("own", key), "own", [F.desc("turn")])
    entry = F.struct((-F.col("turn")).alias("o"), (F.floor(F.length("text") / 4) + 10).cast("bigint").alias("cost"))
    kept = once.groupBy("conv_id").agg(X.fitting(F.sort_array(F.collect_list(entry)), 300).alias("k"))
    return kept.select("conv_id", F.aggregate("k", F.lit(0).cast("bigint"), lambda s, x: s + x["cost"]).alias("used"), F.size("k").cast("bigint").alias("kept"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn + 100, 'short', regexp_replace(text, '\\s+\\S+$', '') FROM conversations),
 e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS words, length(text) / 100.0::DOUBLE AS importance, role FROM c),
 s(conv_id, r, heads, k) AS (SELECT conv_id, r, [words], 1 FROM e WHERE r = 1 UNION ALL
 SELECT conv_id, r, CASE WHEN place > 0 THEN heads ELSE list_append(heads, words) END, CASE WHEN place > 0 THEN place ELSE len(heads) + 1 END FROM
 (SELECT e.conv_id, e.r, s.heads, e.words, coalesce(list_position(list_transform(s.heads, lambda h: len(list_intersect(h, e.words)) > 0.85 * len(list_distinct(list_concat(h, e.words)))), true), 0) AS place FROM s JOIN e ON e.conv_id = s.conv_id AND e.r = s.r + 1)),
 j AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY importance DESC, turn) AS place FROM s JOIN e USING (conv_id, r))
 SELECT conv_id, min(turn) FILTER (place = 1) AS turn, round(max(importance), 4) AS importance, max(turn % 3) AS accesses, string_agg(DISTINCT role, ',' ORDER BY role) AS refs, count(*) AS n_merged FROM j GROUP BY conv_id, k""")
def greedy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Alike turns of a conversation merged in order; each turn comes again, later and less its last word."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    c = c.union(c.select("conv_id", F.col("turn") + 100, F.lit("short"), F.regexp_replace("text", r"\s+\S+$", "")))
    c = c.select("conv_id", "turn", "text", (F.length("text") / 100.0).alias("importance"), (F.col("turn") % 3).cast("bigint").alias("accesses"), F.array("role").alias("refs"))
    made = M.merged(c, "conv_id", "turn", "text", "importance", "accesses", "refs")
    return made.select("conv_id", "turn", F.round("importance", 4).alias("importance"), "accesses", F.array_join("refs", ",").alias("refs"), "n_merged")


@query("""SELECT c_nationkey, origin, ordinal, name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY ordinal) AS r FROM (SELECT c_nationkey, 'search' AS origin, c_custkey AS ordinal, c_name AS name FROM customer WHERE c_nationkey % 4 > 0 UNION ALL SELECT s_nationkey, 'list', s_suppkey, s_name FROM supplier WHERE s_nationkey % 4 = 0)) WHERE r <= 10""")
def company_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits a name: the search's, or the list's where the search failed."""
    hits = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"))
    listed = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("name"))
    failed = table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return company_hits(hits, listed, failed, "c_nationkey").select("c_nationkey", "origin", "ordinal", "name")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long_texts FROM documents GROUP BY 1, 2")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long_texts"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'very_high' END AS label, turn % 2 = 0 AS accepted FROM conversations")
def resolver_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label that isn't on the ladder is never accepted."""
    label = F.when(F.col("turn") % 2 == 0, "high").otherwise("very_high")
    return table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), meets(label, "medium").alias("accepted"))
