"""Lookup queries: as-of and interval joins, name matching, ledgers and identifier hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.operators import joins
from bidsmith.plans.registry import query, table


def facts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.to_date("ts").alias("d"), "ts")


P, E, S, V = (f"(SELECT event_id, user_id, CAST(ts AS DATE) AS d, ts FROM events WHERE event_type = '{k}')" for k in ("purchase", "error", "signup", "view"))


@query(f"SELECT p.event_id, (SELECT min(e.d) FROM {E} e WHERE e.user_id = p.user_id AND e.d >= p.d AND e.d <= p.d + 3) AS first_8k FROM {P} p")
def asof_first_8k(spark: SparkSession, d: str) -> DataFrame:
    found = joins.forward_asof(facts(spark, d, "purchase").drop("ts"), facts(spark, d, "error").select("user_id", F.col("d").alias("first_8k")), "user_id", "d", "first_8k", 3, "first_8k")
    return found.select("event_id", "first_8k")


@query(f"SELECT p.event_id, (SELECT max(e.d) FROM {S} e WHERE e.user_id = p.user_id AND e.d <= p.d) AS last_dilutive FROM {P} p")
def asof_last_dilutive(spark: SparkSession, d: str) -> DataFrame:
    found = joins.backward_asof(facts(spark, d, "purchase").drop("ts"), facts(spark, d, "signup").select("user_id", F.col("d").alias("last_dilutive")), "user_id", "d", "last_dilutive", None, "last_dilutive")
    return found.select("event_id", "last_dilutive")


@query(f"SELECT p.event_id, p.user_id FROM {P} p WHERE NOT EXISTS (SELECT 1 FROM {E} e WHERE e.user_id = p.user_id AND date_diff('day', e.d, p.d) BETWEEN 0 AND 2)")
def anti_recent_8k(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_recent(facts(spark, d, "purchase"), facts(spark, d, "error"), "user_id", "d", "d", 2).select("event_id", "user_id")


@query(f"SELECT p.event_id, p.user_id FROM {P} p WHERE EXISTS (SELECT 1 FROM {S} e WHERE e.user_id = p.user_id AND date_diff('day', e.d, p.d) BETWEEN 0 AND 6)")
def recent_dilutive(spark: SparkSession, d: str) -> DataFrame:
    return joins.recent(facts(spark, d, "purchase"), facts(spark, d, "signup"), "user_id", "d", "d", 6).select("event_id", "user_id")


@query(f"SELECT p.event_id, (SELECT min(v.d) FROM {V} v WHERE v.user_id = p.user_id AND v.d BETWEEN p.d - 1 AND p.d + 7) AS first_pr FROM {P} p")
def pr_band_join(spark: SparkSession, d: str) -> DataFrame:
    news = facts(spark, d, "view").select("user_id", F.col("d").alias("news_date"))
    return joins.earliest_in_band(facts(spark, d, "purchase"), news, "user_id", "d", "news_date", 1, 7, "first_pr").select("event_id", "first_pr")


COMPANIES = [(0, "nation_1", "NAT"), (1, "NATION_12 Holdings", "NTW"), (2, "2", "TWO"), (3, "Nation_2", "NA2"), (4, "acme", "ACM")]
LISTED = "(VALUES " + ", ".join(f"({o}, '{c}', '{t}')" for o, c, t in COMPANIES) + ") c(ordinal, company, ticker)"


@query(f"SELECT n_nationkey, n_name, ordinal, company, ticker FROM (SELECT n_nationkey, n_name, ordinal, company, ticker, row_number() OVER (PARTITION BY n_nationkey ORDER BY ordinal) AS r FROM nation, {LISTED} WHERE contains(lower(n_name), lower(company)) OR contains(lower(company), lower(n_name))) WHERE r <= 10")
def theta_name_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.name_candidates(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", spark.createDataFrame(COMPANIES, "ordinal int, company string, ticker string"))


@query(f"SELECT n_nationkey, ticker, company FROM (SELECT n_nationkey, ticker, company, row_number() OVER (PARTITION BY n_nationkey ORDER BY ordinal) AS r FROM nation, {LISTED} WHERE (contains(lower(n_name), lower(company)) OR contains(lower(company), lower(n_name))) AND length(ticker) = 3 AND ordinal > 0) WHERE r = 1")
def first_match_candidate(spark: SparkSession, d: str) -> DataFrame:
    found = theta_name_match(spark, d)
    return joins.first_match(found, ["n_nationkey"], "ordinal", (F.length("ticker") == 3) & (F.col("ordinal") > 0), ["ticker", "company"])


@query("""WITH ledger AS (SELECT DISTINCT o_custkey, round(o_totalprice, 2) AS p, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.o_custkey = o.o_custkey AND l.p = round(o.o_totalprice, 2) AND l.d = CAST(o.o_orderdate AS DATE))""")
def ledger_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("p"), F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    ledger = o.where("o_orderstatus = 'F'").select("o_custkey", "p", "d").distinct()
    return o.join(ledger, ["o_custkey", "p", "d"], "left_anti").select("o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE epoch(ts) + (CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 30 ELSE 7 END) * 86400 > epoch(TIMESTAMP '2024-01-20 00:00:00')")
def ttl_valid(spark: SparkSession, d: str) -> DataFrame:
    from bidsmith.streaming.state import live

    days = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 30).otherwise(7)
    kept = table(spark, d, "events").withColumn("expires_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + days * 86400)
    return live(kept, F.unix_micros(F.to_timestamp(F.lit("2024-01-20 00:00:00"))) / 1e6).select("event_id", "user_id")


@query("""SELECT ticker, position, search_name FROM (SELECT 'N' || n_nationkey AS ticker, unnest([n_name, r_name, n_name || ' ' || r_name]) AS search_name, unnest([0, 1, 2]) AS position FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def search_name_expansion(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    watch = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("name"), F.array("r_name", F.concat_ws(" ", "n_name", "r_name")).alias("aliases"))
    return joins.search_names(watch)


CAGES = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'BAD' ELSE lpad(CAST(c_custkey % 700 AS VARCHAR), 5, 'A') END AS cage_code FROM customer"
HOPS = f"""WITH a AS ({CAGES}), m AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, 'A') AS cage, 'LEI' || s_suppkey AS lei FROM supplier), t AS (SELECT 'LEI' || s_suppkey AS lei, 'T' || s_nationkey AS ticker FROM supplier WHERE s_suppkey % 3 > 0)"""


def hops(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    a = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "BAD").otherwise(F.lpad((F.col("c_custkey") % 700).cast("string"), 5, "A")).alias("cage_code"))
    s = table(spark, d, "supplier")
    lei = F.concat(F.lit("LEI"), text("s_suppkey")).alias("lei")
    return joins.two_hops(a, s.select(F.lpad(text("s_suppkey"), 5, "A").alias("cage"), lei), s.where("s_suppkey % 3 > 0").select(lei, F.concat(F.lit("T"), text("s_nationkey")).alias("ticker")))


@query(HOPS + """ SELECT a.c_custkey, m.lei, t.ticker, CASE WHEN cage_code = 'BAD' THEN 'invalid_cage_format' WHEN m.lei IS NULL THEN 'cage_not_found' WHEN t.ticker IS NULL THEN 'lei_not_found' END AS rejection_reason,
 CASE WHEN t.ticker IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM a LEFT JOIN m ON cage_code = cage LEFT JOIN t ON m.lei = t.lei""")
def two_hop_resolve(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d).select("c_custkey", "lei", "ticker", "rejection_reason", "confidence")


@query(HOPS + """ SELECT a.c_custkey, round(CASE WHEN e.lei IS NOT NULL THEN least(1.0::DOUBLE, 0.95::DOUBLE + 0.1) ELSE 0.95::DOUBLE END, 4) AS confidence, CASE WHEN e.lei IS NOT NULL THEN 'PUBLIC' ELSE 'PRIVATE' END AS entity_type
 FROM a JOIN m ON cage_code = cage JOIN t ON m.lei = t.lei LEFT JOIN (SELECT 'LEI' || s_suppkey AS lei FROM supplier WHERE s_suppkey % 2 = 0) e ON e.lei = m.lei""")
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("LEI"), F.col("s_suppkey").cast("string")).alias("lei"))
    hits = hops(spark, d).where("ticker is not null").withColumn("confidence", F.lit(0.95))
    return joins.cross_checked(hits, known).select("c_custkey", F.round("confidence", 4).alias("confidence"), "entity_type")


PATHS = "SELECT user_id, CAST(event_id % 3 + 1 AS INT) AS tier, 'p' || (event_id % 4) AS path, CASE WHEN event_type = 'view' THEN NULL ELSE 'T' || (event_id % 2) END AS ticker FROM events"


@query(f"""WITH p AS ({PATHS}), g AS (SELECT user_id, ticker, count(DISTINCT path) AS n_paths, min(tier) AS tier, array_to_string(list_sort(list_distinct(list(path))), '>') AS trail FROM p WHERE ticker IS NOT NULL GROUP BY 1, 2)
 SELECT user_id, ticker, n_paths, CASE WHEN n_paths >= 2 THEN 'very_high' WHEN tier = 1 THEN 'high' WHEN tier = 2 THEN 'medium' ELSE 'low' END AS confidence, trail FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_paths DESC, tier, ticker) AS r FROM g) WHERE r = 1""")
def consensus_confidence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    paths = table(spark, d, "events").select("user_id", (i % 3 + 1).cast("int").alias("tier"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("path"), F.when(F.col("event_type") != "view", F.concat(F.lit("T"), (i % 2).cast("string"))).alias("ticker"))
    return joins.consensus(paths, "user_id")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 7 AS bucket FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", "user_id", k.alias("k"), (k % 7).alias("bucket"))


@query("""SELECT user_id, form, filed FROM (SELECT user_id, event_type AS form, CAST(ts AS DATE) AS filed FROM events) WHERE form IN ('error', 'signup') AND filed >= DATE '2024-01-10'""")
def array_zip_inline(spark: SparkSession, d: str) -> DataFrame:
    """Filings kept as parallel arrays per company and day, read back as rows."""
    arrays = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct("event_type", F.to_date("ts").alias("filed"))).alias("x")).select("user_id", F.col("x.event_type").alias("form"), F.col("x.filed").alias("filed"))
    flat = arrays.select("user_id", F.inline(F.arrays_zip("form", "filed")))
    return flat.where(F.col("form").isin("error", "signup") & (F.col("filed") >= F.to_date(F.lit("2024-01-10"))))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def upsert_last(spark: SparkSession, d: str) -> DataFrame:
    from bidsmith.operators.rows import last_write

    return last_write(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT DISTINCT * FROM (SELECT c_custkey AS vertex, c_nationkey AS neighbour FROM customer UNION ALL SELECT c_nationkey, c_custkey FROM customer) WHERE vertex <> neighbour")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    from bidsmith.operators.relevance import neighbours

    return neighbours(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey")), "c_custkey", "c_nationkey")
