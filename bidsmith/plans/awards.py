"""Award queries: cleaning, verdicts, scores, rollups and order, over orders, customers and nations.

An order is an award: the customer is the awardee, the nation the agency, the balance (times 100)
the market cap, and amounts and caps have thresholds of their own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.config import CONFIDENCE, DILUTIVE_FORMS, HOT_SECTORS, IDIQ_BULK, IDIQ_NOTICE, PRESS_WIRES, SOLE_BULK, SOLE_NOTICE, Config
from bidsmith.functions import cleaning as C
from bidsmith.functions import scoring
from bidsmith.operators import filters, joins, rows
from bidsmith.plans.registry import query, table

LIMITS = Config(min_award=50_000.0, max_award=450_000.0, max_market_cap=900_000.0)


def award(spark: SparkSession, d: str) -> DataFrame:
    """One row an order; the two dimensions are joined as Spark sees fit."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    code = F.element_at(F.array(*map(F.lit, (*HOT_SECTORS[:3], "336412", "111111", "541715"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(F.col("o_orderkey").alias("award_id"), F.col("c_custkey").alias("cik"), F.col("c_name").alias("awardee_name"), F.col("n_name").alias("agency"), F.col("o_totalprice").alias("award_amount"), F.to_date("o_orderdate").alias("posted_date"),
                F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 100).alias("market_cap"), (F.col("o_orderpriority") == "1-URGENT").alias("sole_source"), (F.col("o_orderstatus") == "P").alias("is_idiq"), code.alias("naics"), F.col("c_mktsegment").alias("segment"))
    )


AWARD = """SELECT o_orderkey AS award_id, c_custkey AS cik, c_name AS awardee_name, n_name AS agency, o_totalprice AS award_amount, CAST(o_orderdate AS DATE) AS posted_date,
 CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 END AS market_cap, o_orderpriority = '1-URGENT' AS sole_source, o_orderstatus = 'P' AS is_idiq,
 (['336411','336414','336415','336412','111111','541715'])[CAST(o_orderkey % 6 + 1 AS INT)] AS naics, c_mktsegment AS segment
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
WITH = f"WITH award AS ({AWARD})"
#: Filings are events: an error is a form 8-K, a signup another form, a view a news item; an award is seen on a day of their month.
SEEN = "CAST(DATE '2024-01-01' + CAST(award_id % 31 AS INT) AS DATE)"
FLAGGED = f"""{WITH}, event AS (SELECT user_id, event_type, event_id, CAST(ts AS DATE) AS d, (['S-1','10-K','S-3/A','8-K','S-3','S-1/A'])[CAST(event_id % 6 + 1 AS INT)] AS form,
 'Contract news via ' || (['PRNewswire','a blog','BusinessWire','the paper','radio','AccessWire','GlobeNewswire'])[CAST(event_id % 7 + 1 AS INT)] AS body FROM events),
 flagged AS (SELECT a.*, EXISTS (SELECT 1 FROM event e WHERE e.user_id = a.cik AND e.event_type = 'error' AND date_diff('day', e.d, {SEEN}) BETWEEN 0 AND 7) AS recent_8k,
 EXISTS (SELECT 1 FROM event e WHERE e.user_id = a.cik AND e.event_type = 'view' AND regexp_matches(lower(e.body), 'prnewswire|businesswire|globenewswire|accesswire') AND date_diff('day', e.d, {SEEN}) BETWEEN 0 AND 2) AS has_press,
 EXISTS (SELECT 1 FROM event e WHERE e.user_id = a.cik AND e.event_type = 'signup' AND e.form IN ('S-1', 'S-3', 'S-1/A', 'S-3/A') AND date_diff('day', e.d, {SEEN}) BETWEEN 0 AND 60) AS dilutive FROM award a)"""


def verdict_inputs(spark: SparkSession, d: str, config: Config = LIMITS) -> tuple[DataFrame, DataFrame, dict]:
    """Awards with the day they are `seen`, filings and news, and the kinds of them that count: an 8-K, a wire's press release, a dilutive form."""
    i, pick = F.col("event_id"), lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    seen = table(spark, d, "events").select(F.col("user_id").alias("cik"), "event_type", i, F.to_date("ts").alias("d"), pick(("S-1", "10-K", "S-3/A", "8-K", "S-3", "S-1/A")).alias("form"), F.concat(F.lit("Contract news via "), pick(("PRNewswire", "a blog", "BusinessWire", "the paper", "radio", "AccessWire", "GlobeNewswire"))).alias("body"))
    own = award(spark, d).withColumn("seen", F.date_add(F.lit("2024-01-01"), (F.col("award_id") % 31).cast("int")))
    kinds = {
        "recent_8k": (F.col("event_type") == "error", config.filing_window_live_days),
        "has_press": ((F.col("event_type") == "view") & C.any_phrase(F.lower("body"), PRESS_WIRES), config.press_window_days),
        "dilutive": ((F.col("event_type") == "signup") & F.col("form").isin(*DILUTIVE_FORMS), config.dilution_window_days),
    }
    return own, seen, kinds


def flagged(spark: SparkSession, d: str, config: Config = LIMITS) -> DataFrame:
    """Awards with what joins say of the days before each."""
    own, seen, kinds = verdict_inputs(spark, d, config)
    return joins.having(own, seen, "cik", "seen", "d", kinds).drop("seen")


@query(FLAGGED + """ SELECT award_id, reason, reason IS NULL AS passed FROM (SELECT award_id, CASE WHEN is_idiq THEN 'IDIQ contract'
 WHEN award_amount < 50000 THEN 'Contract value $' || format('{:,}', CAST(round_even(award_amount, 0) AS BIGINT)) || ' below $50,000 minimum' WHEN market_cap IS NULL THEN 'Could not determine market cap for ''' || awardee_name || ''''
 WHEN market_cap > 900000 THEN 'Market cap $' || format('{:,}', CAST(round_even(market_cap, 0) AS BIGINT)) || ' exceeds $900,000 limit' WHEN recent_8k THEN 'Recent 8-K filing found (contract likely already disclosed)'
 WHEN has_press THEN 'Press release already exists' WHEN dilutive THEN 'Dilutive equity offering (S-1/S-3) in progress' END AS reason FROM flagged)""")
def award_verdict(spark: SparkSession, d: str) -> DataFrame:
    return filters.live_verdict(flagged(spark, d), LIMITS).select("award_id", "reason", "passed")


POINTS = """CASE WHEN market_cap IS NULL OR market_cap <= 0 THEN 0 WHEN award_amount / market_cap >= 0.10 THEN 30 WHEN award_amount / market_cap >= 0.05 THEN 20
 WHEN award_amount / market_cap >= 0.02 THEN 12 WHEN award_amount / market_cap >= 0.01 THEN 6 ELSE 2 END"""
SECTOR = "CASE WHEN naics IN ('336411','336414','336415','336419','334511','334519','541715','518210','336413','927110') THEN 15 WHEN starts_with(naics, '33641') THEN 7 ELSE 0 END"
SCORED = f"""{WITH}, numbered AS (SELECT *, row_number() OVER (PARTITION BY cik, agency ORDER BY posted_date, award_id) = 1 AS first_win FROM award),
 scored AS (SELECT *, {POINTS} AS value_to_mcap, CASE WHEN sole_source THEN 25 ELSE 0 END AS sole_pts, CASE WHEN first_win THEN 15 ELSE 0 END AS first_agency, {SECTOR} AS hot_sector,
 CASE WHEN segment = 'BUILDING' THEN 15 ELSE 0 END AS no_pr FROM numbered), totals AS (SELECT *, value_to_mcap + sole_pts + first_agency + hot_sector + no_pr AS total FROM scored)"""


def scored(spark: SparkSession, d: str, threshold: int = 40) -> DataFrame:
    df = rows.prior_count(award(spark, d), ["cik", "agency"], ["posted_date", "award_id"]).withColumn("first_win", F.col("prior_wins") == 0)
    press = F.when(F.col("segment") == "BUILDING", False).when(F.col("segment") == "MACHINERY", True)
    return df.withColumn("score", scoring.score(F.col("award_amount"), F.col("market_cap"), F.col("sole_source"), F.col("first_win"), F.col("naics"), press, threshold))


@query(SCORED + " SELECT award_id, total, total >= 40 AS passed FROM totals")
def award_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("award_id", "score.total", "score.passed")


@query(SCORED + " SELECT award_id, value_to_mcap, CASE WHEN market_cap > 0 THEN round(award_amount / market_cap * 100, 2) ELSE 0.0 END AS ratio_pct, sole_pts AS sole_source, first_agency, hot_sector, no_pr, total, 40 AS threshold, total >= 40 AS passed FROM totals")
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("award_id", "score.*")


@query(SCORED + " SELECT award_id, awardee_name, agency, award_amount, total FROM totals WHERE total >= 40 AND award_amount >= 50000 ORDER BY total DESC, award_amount DESC, award_id LIMIT 100")
def score_topk(spark: SparkSession, d: str) -> DataFrame:
    best = scored(spark, d).where((F.col("score.total") >= 40) & (F.col("award_amount") >= LIMITS.min_award))
    return best.select("award_id", "awardee_name", "agency", "award_amount", "score.total").orderBy(F.desc("total"), F.desc("award_amount"), "award_id").limit(100)


@query(SCORED + """, f AS (SELECT count(*) AS n, count(*) FILTER (award_amount >= 50000) AS a, count(*) FILTER (award_amount >= 50000 AND market_cap IS NOT NULL) AS b, count(*) FILTER (award_amount >= 50000 AND market_cap IS NOT NULL AND total >= 40) AS c FROM totals)
 SELECT 'all' AS stage, n, 100.0::DOUBLE AS pct FROM f UNION ALL SELECT 'amount', a, round(a * 100.0::DOUBLE / n, 2) FROM f UNION ALL SELECT 'market_cap', b, round(b * 100.0::DOUBLE / n, 2) FROM f UNION ALL SELECT 'score', c, round(c * 100.0::DOUBLE / n, 2) FROM f""")
def threshold_funnel(spark: SparkSession, d: str) -> DataFrame:
    amount, cap = F.col("award_amount") >= LIMITS.min_award, F.col("market_cap").isNotNull()
    return filters.funnel(scored(spark, d), {"all": F.lit(True), "amount": amount, "market_cap": amount & cap, "score": amount & cap & (F.col("score.total") >= 40)})


LABELS = (*CONFIDENCE, "very_high", "", "None")
TRAINING = f"""{WITH}, training AS (SELECT award_id, CAST(award_amount AS VARCHAR) AS award_amount, (['none','low','medium','medium_high','high','very_high','','None'])[CAST(award_id % 8 + 1 AS INT)] AS ticker_confidence,
 CASE award_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'None' ELSE CAST(market_cap AS VARCHAR) END AS cap, CAST(posted_date AS VARCHAR) AS posted_date,
 CASE award_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nan' ELSE CAST(posted_date + CAST(award_id % 5 - 1 AS INT) AS VARCHAR) END AS first_8k_date,
 CASE award_id % 4 WHEN 0 THEN '' ELSE CAST(posted_date - CAST(award_id % 130 - 3 AS INT) AS VARCHAR) END AS last_dilutive,
 CASE award_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'True' END AS has_pr, CASE award_id % 3 WHEN 0 THEN '' ELSE CAST(posted_date + CAST(award_id % 6 - 1 AS INT) AS VARCHAR) END AS first_pr_date,
 (['','None','3','3.7','x'])[CAST(award_id % 5 + 1 AS INT)] AS wins FROM award),
 t AS (SELECT *, coalesce(TRY_CAST(nullif(nullif(cap, ''), 'None') AS DOUBLE), 0.0) AS mc, CASE WHEN ticker_confidence IN ('', 'None') THEN 'none' ELSE ticker_confidence END AS conf,
 date_diff('day', CAST(posted_date AS DATE), TRY_CAST(first_8k_date AS DATE)) AS d8, date_diff('day', TRY_CAST(last_dilutive AS DATE), CAST(posted_date AS DATE)) AS dd, date_diff('day', CAST(posted_date AS DATE), TRY_CAST(first_pr_date AS DATE)) AS dp FROM training)"""


def training(spark: SparkSession, d: str) -> DataFrame:
    """Awards as all-text training rows, with every way of saying that a value is missing."""
    a, i = award(spark, d), F.col("award_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (i % k + 1).cast("int"))
    shift = lambda k: F.date_add("posted_date", k.cast("int")).cast("string")
    return a.select(
        "award_id", F.col("award_amount").cast("string").alias("award_amount"), pick(LABELS, 8).alias("ticker_confidence"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, "None").otherwise(F.col("market_cap").cast("string")).alias("historical_market_cap_approx"), F.col("posted_date").cast("string").alias("posted_date"),
        F.when(i % 7 == 0, None).when(i % 7 == 1, "nan").otherwise(shift(i % 5 - 1)).alias("first_8k_date"), F.when(i % 4 == 0, "").otherwise(shift(-(i % 130 - 3))).alias("last_dilutive_filing_date"),
        F.when(i % 6 == 0, "unknown").when(i % 6 == 1, None).otherwise("True").alias("has_pr"), F.when(i % 3 == 0, "").otherwise(shift(i % 6 - 1)).alias("first_pr_date"), pick(("", "None", "3", "3.7", "x"), 5).alias("agency_prior_win_count"),
    )


@query(TRAINING + """ SELECT award_id, reason, reason IS NULL AS passed, mc AS market_cap FROM (SELECT *, CASE WHEN CAST(award_amount AS DOUBLE) < 50000 THEN 'Contract $' || format('{:,}', CAST(round_even(CAST(award_amount AS DOUBLE), 0) AS BIGINT)) || ' below minimum'
 WHEN conf NOT IN ('medium','medium_high','high') THEN 'Ticker confidence ''' || conf || ''' below minimum ''medium''' WHEN mc <= 0 THEN 'No historical market cap data' WHEN mc > 900000 THEN 'Historical market cap $' || CAST(CAST(round_even(mc / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M exceeds $1M limit'
 WHEN d8 BETWEEN 0 AND 2 THEN '8-K filed ' || d8 || 'd after award (within 2d window)' WHEN dd BETWEEN 0 AND 60 THEN 'Dilutive offering ' || dd || 'd before award (within 60d window)' END AS reason FROM t)""")
def training_verdict(spark: SparkSession, d: str) -> DataFrame:
    return filters.training_verdict(training(spark, d), LIMITS).select("award_id", "reason", "passed", "market_cap")


@query(TRAINING + " SELECT award_id, CASE WHEN coalesce(has_pr, '') IN ('unknown','None','nan','') OR dp IS NULL THEN NULL ELSE dp BETWEEN 0 AND 2 END AS has_press FROM t")
def pr_tristate(spark: SparkSession, d: str) -> DataFrame:
    return filters.training_verdict(training(spark, d), LIMITS).select("award_id", "has_press")


@query(TRAINING + " SELECT ticker_confidence, conf IN ('medium','medium_high','high') AS meets, count(*) AS n FROM t GROUP BY 1, 2")
def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    own = F.coalesce(C.missing("ticker_confidence"), F.lit("none"))
    return training(spark, d).groupBy("ticker_confidence", filters.meets(own, "medium").alias("meets")).agg(F.count("*").alias("n"))


@query(TRAINING + " SELECT award_id, mc AS market_cap, CAST(CASE wins WHEN '3' THEN 3 WHEN '3.7' THEN 3 ELSE 0 END AS INT) AS prior_wins, CAST(d8 AS INT) AS days_to_8k FROM t")
def missing_token_cast(spark: SparkSession, d: str) -> DataFrame:
    t = training(spark, d)
    return t.select("award_id", F.coalesce(C.missing("historical_market_cap_approx").try_cast("double"), F.lit(0.0)).alias("market_cap"), C.whole("agency_prior_win_count").alias("prior_wins"), C.signed_days("posted_date", "first_8k_date").alias("days_to_8k"))


MONEY = "(['$' || CAST(o_totalprice AS VARCHAR), ' ' || CAST(o_totalprice AS VARCHAR), 'N/A', '', NULL, '$1,234.50'])[CAST(o_orderkey % 6 + 1 AS INT)]"


@query(f"SELECT o_orderkey, coalesce(v, 0.0) AS amount, v BETWEEN 50000 AND 450000 IS TRUE AS in_range FROM (SELECT o_orderkey, TRY_CAST(trim(regexp_replace({MONEY}, '[$,]', '', 'g')) AS DOUBLE) AS v FROM orders)")
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    o, p = table(spark, d, "orders"), F.col("o_totalprice").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("$"), p), F.concat(F.lit(" "), p), F.lit("N/A"), F.lit(""), F.lit(None), F.lit("$1,234.50")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    df = o.select("o_orderkey", raw.alias("raw"))
    return df.select("o_orderkey", C.money("raw").alias("amount"), F.coalesce(C.money_or_null("raw").between(LIMITS.min_award, LIMITS.max_award), F.lit(False)).alias("in_range"))


RAW_NAME = """(['ACME ' || upper(s_name) || ' INC 34 PARKWAY COMMONS WAY GREER SC USA 29650-5213', 'ACME HOLDINGS ' || s_name || ' PO BOX 77', s_name || ' LLC  ', 'SHORT SUITE 9', 'DELTA WORKS GROUP TEXAS TX USA 75001', ''])[CAST(s_suppkey % 6 + 1 AS INT)]"""


@query(f"""WITH r AS (SELECT s_suppkey, trim({RAW_NAME}) AS n FROM supplier), s AS (SELECT *, trim(regexp_extract(n, '^(.+?)\\s+\\d+\\s+[A-Z]', 1)) AS street, strpos(upper(n), ' PO BOX ') AS po, strpos(upper(n), ' SUITE ') AS su FROM r)
 SELECT s_suppkey, CASE WHEN street <> '' AND len(regexp_split_to_array(street, '\\s+')) >= 2 THEN street WHEN regexp_matches(n, '^.+?\\s+[A-Z]{{2}}\\s+USA\\s+\\d{{5}}') THEN regexp_replace(n, '\\s+\\d+$', '') WHEN po > 11 THEN trim(substr(n, 1, po - 1)) WHEN su > 11 THEN trim(substr(n, 1, su - 1)) ELSE n END AS clean_name FROM s""")
def name_clean(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_name")
    raw = F.element_at(F.array(F.concat(F.lit("ACME "), F.upper(n), F.lit(" INC 34 PARKWAY COMMONS WAY GREER SC USA 29650-5213")), F.concat(F.lit("ACME HOLDINGS "), n, F.lit(" PO BOX 77")), F.concat(n, F.lit(" LLC  ")), F.lit("SHORT SUITE 9"), F.lit("DELTA WORKS GROUP TEXAS TX USA 75001"), F.lit("")), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", C.clean_name(raw).alias("clean_name"))


PHRASE = "(['Sole Source award', 'IDIQ vehicle', 'Only one responsible source', '8(a) Sole', 'indefinite-quantity', 'other than full and open', 'open competition'])[CAST(p_partkey % 7 + 1 AS INT)] || ' ' || p_name"


def _phrases(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@query(f"SELECT p_partkey, {_phrases('t', SOLE_NOTICE)} AS sole_notice, {_phrases('t', IDIQ_NOTICE)} AS idiq_notice, {_phrases('t', SOLE_BULK)} AS sole_bulk, {_phrases('t', IDIQ_BULK)} AS idiq_bulk FROM (SELECT p_partkey, lower({PHRASE}) AS t FROM part)")
def phrase_classify(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("Sole Source award", "IDIQ vehicle", "Only one responsible source", "8(a) Sole", "indefinite-quantity", "other than full and open", "open competition"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    df = table(spark, d, "part").select("p_partkey", C.joined_lower(text, "p_name").alias("t"))
    return df.select("p_partkey", *(C.any_phrase(F.col("t"), p).alias(n) for n, p in (("sole_notice", SOLE_NOTICE), ("idiq_notice", IDIQ_NOTICE), ("sole_bulk", SOLE_BULK), ("idiq_bulk", IDIQ_BULK))))


@query(f"{WITH} SELECT naics, {SECTOR} AS points, count(*) AS n FROM award GROUP BY 1, 2")
def naics_bucket(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).groupBy("naics", scoring.sector_points(F.col("naics")).alias("points")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us_date, strftime(o_orderdate, '%Y-%m-%d') AS iso_date, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders""")
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    return df.select("o_orderkey", C.us_date("iso").alias("us_date"), C.iso_text("iso").alias("iso_date"), C.iso_text(C.us_date("iso")).alias("back"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN NULL ELSE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS INT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_signed(spark: SparkSession, d: str) -> DataFrame:
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    shipped = F.when(F.col("l_returnflag") == "R", "nan").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", C.signed_days(F.date_format("o_orderdate", "yyyy-MM-dd"), shipped).alias("days"))


@query("""SELECT c_custkey, CAST(s AS DATE) AS chunk_start, least(CAST(s AS DATE) + 14, e) AS chunk_end FROM (SELECT c_custkey, lo, e, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(e AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 15 DAY)) AS s
 FROM (SELECT o_custkey AS c_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1) WHERE lo < e)""")
def date_chunks(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return rows.date_chunks(span, "lo", "hi").select("c_custkey", "chunk_start", "chunk_end")


@query("""WITH cal AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE isodow(o_orderdate) < 6)), f AS (SELECT e.event_id, CAST(e.ts AS DATE) - 10000 AS s FROM events e),
 x AS (SELECT f.event_id, f.s, (SELECT min(n) FROM cal WHERE d >= f.s AND d <= f.s + 10) AS k FROM (SELECT DISTINCT s, 0 AS event_id FROM f) f)
 SELECT f.event_id, cal.d AS exit_by FROM f JOIN x ON f.s = x.s LEFT JOIN cal ON cal.n = x.k + 4""")
def trading_day_add(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).where(F.weekday("session") < 5).distinct()
    starts = table(spark, d, "events").select("event_id", F.date_sub(F.to_date("ts"), 10000).alias("start"))
    return rows.sessions_after(starts, "start", days, "session", 4).select("event_id", "exit_by")


@query("""SELECT event_id, CAST(CASE WHEN dow = 5 THEN d + 6 WHEN dow = 6 THEN d + 5 WHEN dow = 7 THEN d + 4 WHEN dow = 1 THEN d + 4 ELSE d + 6 END AS DATE) AS exit_by FROM (SELECT event_id, CAST(ts AS DATE) AS d, isodow(ts) AS dow FROM events)""")
def weekday_add(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.weekdays_after(F.to_date("ts"), 4).alias("exit_by"))


@query("""SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 10 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE CAST(c_custkey AS VARCHAR) END AS cik, regexp_full_match(upper(trim(substr(c_name, 14, 5))), '[A-Z0-9]{5}') AS is_cage, regexp_full_match(upper(trim(c_name)), '[A-Z0-9]{20}') AS is_lei FROM customer""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", C.padded(F.col("c_custkey").cast("string")).alias("cik"), C.is_cage(F.substring("c_name", 14, 5)).alias("is_cage"), C.is_lei("c_name").alias("is_lei"))


@query(f"{WITH} SELECT agency, count(*) AS n, round(sum(award_amount), 2) AS amount FROM award GROUP BY 1")
def agency_count(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).groupBy("agency").agg(F.count("*").alias("n"), F.round(F.sum("award_amount"), 2).alias("amount"))


@query(f"{WITH} SELECT cik, array_to_string(list_sort(list_distinct(list(agency || ':' || naics))), ',') AS keys FROM award GROUP BY 1")
def agency_distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).groupBy("cik").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "agency", "naics"))), ",").alias("keys"))


@query(f"{WITH} SELECT awardee_name, count(DISTINCT posted_date) AS n_dates, count(DISTINCT naics) AS n_codes FROM award GROUP BY 1")
def distinct_awards_per_company(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).groupBy("awardee_name").agg(F.countDistinct("posted_date").alias("n_dates"), F.countDistinct("naics").alias("n_codes"))


@query(f"{WITH} SELECT award_id, awardee_name, award_amount, agency FROM award WHERE naics IN ('336411','541715') AND award_amount BETWEEN 50000 AND 450000 AND awardee_name <> ''")
def bulk_pushdown_scan(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).where(F.col("naics").isin("336411", "541715") & F.col("award_amount").between(LIMITS.min_award, LIMITS.max_award) & (F.col("awardee_name") != "")).select("award_id", "awardee_name", "award_amount", "agency")


@query(f"{WITH} SELECT award_id, cik, agency, row_number() OVER (PARTITION BY cik, agency ORDER BY posted_date, award_id) - 1 AS prior_wins FROM award")
def prior_wins(spark: SparkSession, d: str) -> DataFrame:
    return rows.prior_count(award(spark, d), ["cik", "agency"], ["posted_date", "award_id"]).select("award_id", "cik", "agency", F.col("prior_wins").cast("bigint").alias("prior_wins"))


@query(f"{WITH}, g AS (SELECT naics, count(*) AS n, count(*) FILTER (w) AS k FROM (SELECT naics, row_number() OVER (PARTITION BY cik, naics ORDER BY posted_date, award_id) = 1 AS w FROM award) GROUP BY 1) SELECT naics, k AS first_wins, round(k * 100.0::DOUBLE / n, 4) AS rate FROM g")
def first_agency_win(spark: SparkSession, d: str) -> DataFrame:
    df = rows.prior_count(award(spark, d), ["cik", "naics"], ["posted_date", "award_id"])
    return df.groupBy("naics").agg(F.count_if(F.col("prior_wins") == 0).alias("first_wins"), F.round(F.avg((F.col("prior_wins") == 0).cast("double")) * 100, 4).alias("rate"))


@query(f"{WITH} SELECT * FROM (SELECT cik, award_id, award_amount, row_number() OVER (PARTITION BY cik ORDER BY award_amount DESC, award_id) AS rank FROM award) WHERE rank <= 3")
def topk_per_company(spark: SparkSession, d: str) -> DataFrame:
    return rows.top_per_key(award(spark, d).select("cik", "award_id", "award_amount"), ["cik"], [F.desc("award_amount"), F.col("award_id")], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 OR (o_totalprice = 200000 AND o_orderkey > 5) ORDER BY o_totalprice, o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return rows.page_after(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (200_000.0, 5), 100)


@query(f"""{WITH}, k AS (SELECT award_id, agency, CASE WHEN award_id % 9 = 0 THEN '' ELSE cik || '-' || naics END AS ident, award_amount FROM award)
 SELECT award_id, agency, ident FROM (SELECT *, row_number() OVER (PARTITION BY agency, ident ORDER BY award_amount DESC, award_id) AS r FROM k WHERE ident <> '') WHERE r = 1 UNION ALL SELECT award_id, agency, ident FROM k WHERE ident = ''""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    ident = F.when(F.col("award_id") % 9 == 0, "").otherwise(F.concat_ws("-", F.col("cik").cast("string"), "naics"))
    df = award(spark, d).select("award_id", "agency", ident.alias("ident"), "award_amount")
    return rows.keep_first(df, "agency", "ident", [F.desc("award_amount"), F.col("award_id")]).select("award_id", "agency", "ident")


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return rows.consecutive(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


LINE = "CAST(CAST(ts AS DATE) AS VARCHAR) || ' 10:00:00 [' || (['INFO','ERROR','DEBUG'])[CAST(event_id % 3 + 1 AS INT)] || '] user ' || user_id || ' ' || event_type || (['',' failed',' Total'])[CAST(event_id % 3 + 1 AS INT)]"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines made from events."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.to_date("ts").cast("string"), F.lit(" 10:00:00 ["), pick("INFO", "ERROR", "DEBUG"), F.lit("] user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), pick("", " failed", " Total"))
    return table(spark, d, "events").select("event_id", "user_id", "ts", text.alias("line"))


@query(f"SELECT line, count(*) AS count FROM (SELECT trim(regexp_replace(regexp_replace({LINE}, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}', '', 'g'), '\\[(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\\]', '', 'g')) AS line FROM events) GROUP BY 1 HAVING count(*) > 1")
def line_dup_counts(spark: SparkSession, d: str) -> DataFrame:
    return rows.repeated_lines(lines(spark, d).select(C.bare_line("line").alias("line")), "line")


@query(f"SELECT is_error, is_summary, count(*) AS n FROM (SELECT regexp_matches(upper(l), 'ERROR|WARNING|FAILED|EXCEPTION|TRACEBACK') AS is_error, regexp_matches(l, '===|---|│|├|└|Summary|Results|Total') AS is_summary FROM (SELECT {LINE} AS l FROM events)) GROUP BY 1, 2")
def log_line_classes(spark: SparkSession, d: str) -> DataFrame:
    from bidsmith.config import ERROR_MARKS, SUMMARY_MARKS

    return lines(spark, d).groupBy(C.any_phrase(F.upper("line"), ERROR_MARKS).alias("is_error"), C.any_phrase(F.col("line"), SUMMARY_MARKS).alias("is_summary")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT agency, round(avg(CASE WHEN market_cap IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 4) AS rate, count(*) AS tested FROM award GROUP BY 1")
def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    return award(spark, d).groupBy("agency").agg(F.round(F.avg(F.col("market_cap").isNotNull().cast("double")) * 100, 4).alias("rate"), F.count("*").alias("tested"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS posted FROM orders")
def coalesce_chain(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 3
    df = o.select("o_orderkey", F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, "").alias("a"), F.when(k == 1, F.col("o_orderpriority")).otherwise("").alias("b"))
    return df.select("o_orderkey", C.first_filled("a", "b").alias("posted"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, 'awards_' || strftime(ts, '%Y%m%d') || '_' || strftime(ts + INTERVAL 14 DAY, '%Y%m%d') || '.json' AS cache_name FROM events")
def pub_date_parse(spark: SparkSession, d: str) -> DataFrame:
    mail = F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    end = F.date_format(F.date_add(F.to_date("ts"), 14), "yyyy-MM-dd")
    return table(spark, d, "events").select("event_id", F.date_format(C.mail_date(mail), "yyyy-MM-dd HH:mm:ss").alias("stamp"), C.cache_name(F.date_format("ts", "yyyy-MM-dd"), end).alias("cache_name"))
