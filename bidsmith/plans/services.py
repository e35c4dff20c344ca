"""Queries of lookups with memory, the resolver, small expressions, and what writers leave for readers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.functions import cleaning as C
from bidsmith.operators import filters, joins, rows
from bidsmith.plans.awards import AWARD, LIMITS, award
from bidsmith.plans.lookups import facts
from bidsmith.plans.registry import query, table
from bidsmith.sources import readers, sinks
from bidsmith.streaming.state import shared

#: Awards for lookups by name: some carry a ticker and a cap; earlier runs knew some names, some of them as failures.
LOOKUPS = f"""WITH a AS (SELECT award_id, awardee_name, award_amount, is_idiq, CASE WHEN award_id % 5 = 0 THEN 'W' || cik WHEN award_id % 5 = 1 THEN '' END AS ticker, CASE WHEN award_id % 10 = 0 THEN 0 WHEN award_id % 5 = 0 THEN market_cap END AS market_cap FROM ({AWARD})),
 known AS (SELECT c_name AS awardee_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'K' || c_custkey END AS ticker, CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) * 150 END AS market_cap FROM customer WHERE c_custkey % 3 = 0),
 asked AS (SELECT c_name AS awardee_name, 'Q' || c_custkey AS ticker, abs(c_acctbal) * 120 AS market_cap FROM customer WHERE c_custkey % 2 = 0)"""


def lookups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, i = table(spark, d, "customer").select(F.col("c_name").alias("awardee_name"), "c_custkey", "c_acctbal"), F.col("award_id")
    own = award(spark, d).withColumn("ticker", F.when(i % 5 == 0, F.concat(F.lit("W"), F.col("cik").cast("string"))).when(i % 5 == 1, F.lit("")))
    own = own.select("award_id", "awardee_name", "award_amount", "is_idiq", "ticker", F.when(i % 10 == 0, 0.0).when(i % 5 == 0, F.col("market_cap")).alias("market_cap"))
    answer = lambda letter, factor: [F.concat(F.lit(letter), F.col("c_custkey").cast("string")).alias("ticker"), (F.abs("c_acctbal") * factor).alias("market_cap")]
    known = c.where("c_custkey % 3 = 0").select("awardee_name", *(F.when(F.col("c_custkey") % 4 != 0, x).alias(n) for x, n in zip(answer("K", 150), ("ticker", "market_cap"), strict=True)))
    return own, known, c.where("c_custkey % 2 = 0").select("awardee_name", *answer("Q", 120))


_MONEY = "format('{{:,}}', CAST(round_even({}, 0) AS BIGINT))"


@query(LOOKUPS + f""", j AS (SELECT a.award_id, a.awardee_name, a.award_amount, a.is_idiq, coalesce(a.ticker, '') <> '' AND coalesce(a.market_cap, 0) <> 0 AS short, k.awardee_name IS NOT NULL AS known, a.ticker AS t0, a.market_cap AS m0, k.ticker AS t1, k.market_cap AS m1, q.ticker AS t2, q.market_cap AS m2
 FROM a LEFT JOIN known k USING (awardee_name) LEFT JOIN asked q USING (awardee_name)), g AS (SELECT *, CASE WHEN short THEN t0 WHEN known THEN t1 ELSE t2 END AS ticker, CASE WHEN short THEN m0 WHEN known THEN m1 ELSE m2 END AS cap FROM j),
 r AS (SELECT *, CASE WHEN is_idiq THEN 'IDIQ contract' WHEN award_amount < 50000 THEN 'Contract $' || {_MONEY.format('award_amount')} || ' below minimum' WHEN ticker IS NULL THEN 'No tradeable ticker for ''' || awardee_name || '''' || CASE WHEN known THEN ' (cached)' ELSE '' END
 WHEN cap > 900000 THEN 'Market cap $' || CAST(CAST(round_even(cap / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M exceeds $1M limit' END AS bad FROM g)
 SELECT award_id, ticker, round(cap, 2) AS market_cap, bad IS NULL AS passed, coalesce(bad, CASE WHEN short THEN 'Passed filters (watchlist mode)' ELSE 'Passed filters (backtest mode)' END) AS reason FROM r""")
def lookup_verdict(spark: SparkSession, d: str) -> DataFrame:
    return filters.lookup_verdict(*lookups(spark, d), LIMITS).select("award_id", "ticker", F.round("market_cap", 2).alias("market_cap"), "passed", "reason")


@query(LOOKUPS + " SELECT awardee_name, ticker, round(market_cap, 2) AS market_cap FROM (SELECT * FROM known UNION ALL SELECT n.awardee_name, q.ticker, q.market_cap FROM (SELECT DISTINCT awardee_name FROM a WHERE awardee_name NOT IN (SELECT awardee_name FROM known)) n LEFT JOIN asked q USING (awardee_name))")
def lookup_memo(spark: SparkSession, d: str) -> DataFrame:
    """What the memo holds after the run, failures too."""
    return filters.remembered(*lookups(spark, d)).withColumn("market_cap", F.round("market_cap", 2))


@query(f"SELECT a.award_id, a.awardee_name, c.market_cap FROM ({AWARD}) a LEFT JOIN (SELECT c_name, c_acctbal AS market_cap FROM customer WHERE c_custkey % 2 = 0) c ON a.awardee_name = c.c_name")
def market_cap_left(spark: SparkSession, d: str) -> DataFrame:
    """Awards with their company's market cap; one without a company stays, with null."""
    caps = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("awardee_name"), F.col("c_acctbal").alias("market_cap"))
    return award(spark, d).select("award_id", "awardee_name").join(caps, "awardee_name", "left")


_NULLS = "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, event_type, CAST(ts AS DATE) AS d FROM events"


def _some_null(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))


@query(f"WITH x AS ({_NULLS}) SELECT p.event_id, (SELECT min(e.d) FROM x e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.d BETWEEN p.d AND p.d + 3) AS first_8k, (SELECT max(e.d) FROM x e WHERE e.event_type = 'signup' AND e.user_id = p.user_id AND e.d <= p.d) AS last_dilutive FROM x p WHERE p.event_type = 'purchase'")
def asof_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved companies, whose key is null, meet no filing."""
    own, first, last = (_some_null(facts(spark, d, k).select("event_id", "user_id", "d")) for k in ("purchase", "error", "signup"))
    out = joins.forward_asof(own, first.select("user_id", F.col("d").alias("first_8k")), "user_id", "d", "first_8k", 3, "first_8k")
    return joins.backward_asof(out, last.select("user_id", F.col("d").alias("last_dilutive")), "user_id", "d", "last_dilutive", None, "last_dilutive").select("event_id", "first_8k", "last_dilutive")


@query("WITH x AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d FROM events), s AS (SELECT * FROM x WHERE event_type = 'signup'), z AS (SELECT event_id, d, (['S-1','S-3','10-K'])[CAST(event_id % 3 + 1 AS INT)] AS form, user_id FROM s) SELECT p.event_id, max(z.d) AS last_filed, arg_max(z.form, (z.d, z.event_id)) AS form FROM x p LEFT JOIN z ON z.user_id = p.user_id AND z.d <= p.d WHERE p.event_type = 'purchase' AND p.event_id % 3 = 0 GROUP BY 1")
def asof_last_form(spark: SparkSession, d: str) -> DataFrame:
    """The last filing of any age, with its form; of one day's the last."""
    z = facts(spark, d, "signup").withColumn("form", F.element_at(F.array(F.lit("S-1"), F.lit("S-3"), F.lit("10-K")), (F.col("event_id") % 3 + 1).cast("int")))
    one = z.groupBy("user_id", "d").agg(F.max_by("form", "event_id").alias("form"))
    own = facts(spark, d, "purchase").where("event_id % 3 = 0").select("event_id", "user_id", "d")
    return joins.backward_asof(own, one.select("user_id", F.col("d").alias("last_filed"), "form"), "user_id", "d", "last_filed", None, ["last_filed", "form"]).select("event_id", "last_filed", "form")


@query("""WITH x AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d FROM events), q AS (SELECT p.event_id, (SELECT min(v.d) FROM x v WHERE v.event_type = 'view' AND v.event_id % 4 = 0 AND v.user_id = p.user_id AND date_diff('day', p.d, v.d) BETWEEN -1 AND 7) AS a,
 (SELECT min(v.d) FROM x v WHERE v.event_type = 'click' AND v.user_id = p.user_id AND date_diff('day', p.d, v.d) BETWEEN -1 AND 7) AS b FROM x p WHERE p.event_type = 'purchase') SELECT event_id, coalesce(a, b) AS first_pr FROM q""")
def press_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The earliest press release of the first search; of the second where the first found none, even if the second's is earlier."""
    first, second = facts(spark, d, "view").where("event_id % 4 = 0"), facts(spark, d, "click")
    return joins.earliest_of_searches(facts(spark, d, "purchase").select("event_id", "user_id", "d"), [first, second], "user_id", "d", "d", 1, 7, "first_pr").select("event_id", "first_pr")


#: Awardees spelled in several ways, and the companies: suppliers.
RESOLVE = """WITH co AS (SELECT s_suppkey AS ordinal, 'Firm ' || s_nationkey || ' of ' || s_suppkey || ' Ltd' AS company, 'S' || s_suppkey AS ticker, s_suppkey + 1000 AS cik FROM supplier),
 a AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN upper(company) WHEN 1 THEN company || ' Holdings' WHEN 2 THEN 'x' || replace(company, 'Ltd', 'Lld') WHEN 3 THEN replace(company, ' Ltd', 'xx td') ELSE 'zz' || c_custkey || 'zz' END AS name,
  CASE WHEN c_custkey % 12 < 6 THEN '' ELSE company END AS parent, CASE WHEN c_custkey % 6 = 5 THEN printf('%05d', c_custkey) WHEN c_custkey % 7 = 0 THEN 'bad' END AS cage_code FROM customer JOIN co ON ordinal = c_custkey % (SELECT count(*) FROM supplier)),
 cl AS (SELECT printf('%05d', c_custkey) AS cage, 'L' || c_custkey AS lei FROM customer WHERE c_custkey % 11 <> 0), lt AS (SELECT 'L' || c_custkey AS lei, 'S' || (c_custkey % 5) AS ticker FROM customer WHERE c_custkey % 13 <> 0), caps AS (SELECT 'S' || s_suppkey AS ticker, s_acctbal AS market_cap FROM supplier WHERE s_suppkey % 2 = 0)"""
_VALID = "regexp_matches(coalesce(a.cage_code, ''), '^[A-Za-z0-9]{5}$')"
_WAY = "SELECT id, {t} + CASE way WHEN 'exact' THEN 2 WHEN 'substring' THEN 3 WHEN 'fuzzy_90' THEN 4 ELSE 5 END AS tier, ordinal, '{p}' || way AS way, ticker, company AS o1, NULL AS o2 FROM (SELECT a.id, co.ordinal, co.ticker, co.company, CASE WHEN lower({c}) = lower(company) THEN 'exact' WHEN contains(lower({c}), lower(company)) OR contains(lower(company), lower({c})) THEN 'substring' WHEN ratio({c}) >= 90 THEN 'fuzzy_90' WHEN ratio({c}) >= 85 THEN 'fuzzy_85' END AS way FROM a, co WHERE {c} <> '') WHERE way IS NOT NULL"


def _way(c: str, p: str, t: int) -> str:
    return _WAY.replace("{c}", c).replace("{p}", p).replace("{t}", str(t)).replace(f"ratio({c})", f"floor(100 * (1 - levenshtein(lower({c}), lower(company)) / greatest(length({c}), length(company))))")


@query(RESOLVE + f""", hop AS (SELECT a.id, cl.lei, lt.ticker, CASE WHEN NOT {_VALID} THEN 'invalid_cage_format' WHEN cl.lei IS NULL THEN 'cage_not_found' WHEN lt.ticker IS NULL THEN 'lei_not_found' END AS bad FROM a LEFT JOIN cl ON {_VALID} AND upper(a.cage_code) = cl.cage LEFT JOIN lt ON lt.lei = cl.lei),
 w AS (SELECT id, 1 AS tier, -1 AS ordinal, 'cage_lei_openfigi' AS way, ticker, lei AS o1, ticker AS o2 FROM hop WHERE ticker IS NOT NULL UNION ALL {_way('name', '', 0)} UNION ALL {_way('parent', 'parent_', 10)}),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, ordinal) AS r FROM w) WHERE r = 1)
 SELECT h.id, b.ticker AS resolved_ticker, CASE WHEN b.ticker IS NOT NULL THEN CAST(substr(b.ticker, 2) AS BIGINT) + 1000 END AS resolved_cik, CASE WHEN b.way IS NULL THEN 'none' WHEN b.way LIKE '%cage%' OR b.way LIKE '%exact' THEN 'high' WHEN b.way LIKE '%fuzzy_85' THEN 'low' ELSE 'medium' END AS confidence, b.way AS evidence_type,
 CASE WHEN b.way IS NULL THEN 'cage_to_lei=' || h.bad || ';names=not_found' WHEN b.way LIKE 'cage%' THEN 'cage_to_lei=' || b.o1 || ';lei_to_ticker=' || b.o2 ELSE b.way || '=' || b.o1 END AS trail, caps.market_cap FROM hop h LEFT JOIN best b USING (id) LEFT JOIN caps ON caps.ticker = b.ticker""")
def resolver(spark: SparkSession, d: str) -> DataFrame:
    s, c, text = table(spark, d, "supplier"), table(spark, d, "customer"), lambda x: F.col(x).cast("string")
    co = s.select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("Firm "), text("s_nationkey"), F.lit(" of "), text("s_suppkey"), F.lit(" Ltd")).alias("company"), F.concat(F.lit("S"), text("s_suppkey")).alias("ticker"), (F.col("s_suppkey") + 1000).alias("cik"))
    k, five = F.col("c_custkey"), F.lpad(text("c_custkey"), 5, "0")
    own = c.select("c_custkey").withColumn("ordinal", k % s.count()).join(co.select("ordinal", "company"), "ordinal")
    name = F.when(k % 6 == 0, F.upper("company")).when(k % 6 == 1, F.concat("company", F.lit(" Holdings"))).when(k % 6 == 2, F.concat(F.lit("x"), F.replace("company", F.lit("Ltd"), F.lit("Lld")))).when(k % 6 == 3, F.replace("company", F.lit(" Ltd"), F.lit("xx td"))).otherwise(F.concat(F.lit("zz"), text("c_custkey"), F.lit("zz")))
    own = own.select(k.alias("id"), name.alias("name"), F.when(k % 12 < 6, "").otherwise(F.col("company")).alias("parent"), F.when(k % 6 == 5, five).when(k % 7 == 0, "bad").alias("cage_code"))
    lei = F.concat(F.lit("L"), text("c_custkey")).alias("lei")
    cage_lei, lei_ticker = c.where("c_custkey % 11 <> 0").select(five.alias("cage"), lei), c.where("c_custkey % 13 <> 0").select(lei, F.concat(F.lit("S"), (k % 5).cast("string")).alias("ticker"))
    caps = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), text("s_suppkey")).alias("ticker"), F.col("s_acctbal").alias("market_cap"))
    out = joins.resolved(own, "id", "name", "parent", co, cage_lei, lei_ticker, caps)
    return out.withColumn("trail", F.array_join(F.transform("audit_trail", lambda x: F.concat(x["step"], F.lit("="), F.coalesce(x["outcome"], F.lit("")))), ";")).drop("audit_trail")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid_lei_format' WHEN event_id % 7 = 0 THEN 'openfigi_timeout' WHEN event_id % 5 = 0 THEN 'api_error: ' || substr(repeat('broken ', 12), 1, 50) WHEN event_id % 4 = 0 THEN 'openfigi_http_' || (400 + event_id % 3)
 WHEN event_id % 3 = 0 THEN 'lei_not_found_in_openfigi' WHEN event_id % 2 = 0 THEN 'no_us_ticker_in_openfigi' END AS rejection_reason, CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 4 <> 0 AND event_id % 3 <> 0 AND event_id % 2 <> 0 THEN 0.9 ELSE 0 END AS confidence FROM events""")
def lookup_reasons(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 4 == 0, 400 + i % 3).otherwise(200)
    reason = joins.service_reason("openfigi", i % 11 != 0, "invalid_lei_format", status, i % 7 == 0, F.when(i % 5 == 0, F.repeat(F.lit("broken "), 12)), i % 3 != 0, "lei_not_found_in_openfigi", i % 2 != 0, "no_us_ticker_in_openfigi")
    return table(spark, d, "events").select("event_id", reason.alias("rejection_reason")).withColumn("confidence", F.when(F.col("rejection_reason").isNull(), 0.9).otherwise(0.0))


@query("SELECT event_id, 'http://x/search?q=' || event_type || '&n=' || user_id AS url FROM events")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", readers.search_url("http://x/search", q=F.col("event_type"), none=F.lit(None).cast("string"), n=F.col("user_id").cast("string")).alias("url"))


@query("SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    """New York's winter time, all of the table's being in January."""
    return table(spark, d, "events").select("event_id", C.local_time(F.col("ts")).alias("local"))


@query("""WITH x AS (SELECT user_id, event_id, event_id % 4 AS k, event_type FROM events), g AS (SELECT user_id, list({'t': CASE WHEN k = 0 THEN '' ELSE event_type END, 'e': CASE WHEN k = 1 THEN 'LN' WHEN k = 2 THEN 'US' WHEN k = 3 THEN '' END, 'i': event_id} ORDER BY event_id) AS h FROM x GROUP BY 1)
 SELECT user_id, coalesce(h[1].t, 'none') AS first, list_filter(h, lambda y: y.t <> '' AND coalesce(y.e, '') IN ('', 'US'))[1].i AS listed FROM g""")
def array_picks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    hit = F.struct("event_id", F.when(k == 0, "").otherwise(F.col("event_type")).alias("ticker"), F.when(k == 1, "LN").when(k == 2, "US").when(k == 3, "").alias("exchCode"))
    grouped = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(hit)).alias("h"))
    return grouped.select("user_id", C.first_or(F.transform("h", lambda x: x["ticker"]), F.lit("none")).alias("first"), C.first_listed(F.col("h"))["event_id"].alias("listed"))


@query("SELECT event_type AS ticker, lower(arg_max(props, event_id)) AS name, count(*) AS n FROM events GROUP BY 1")
def ticker_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by ticker, from a JSON map of entries: of repeated tickers the last counts."""
    e = table(spark, d, "events")
    n = e.groupBy(F.col("event_type").alias("ticker")).agg(F.count("*").alias("n"))
    last = rows.last_write(e.select(F.col("event_type").alias("ticker"), F.lower("props").alias("name"), "event_id"), ["ticker"], [F.desc("event_id")]).drop("event_id")
    pairs = last.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("ticker", "name"))).alias("m"))  # an entry a kind
    return pairs.select(F.explode("m").alias("ticker", "name")).join(n, "ticker")


@query("SELECT c_custkey AS ordinal, c_name AS company, 'T' || c_nationkey AS ticker FROM customer")
def company_map_values(spark: SparkSession, d: str) -> DataFrame:
    """A company list kept as one JSON map a nation: its values as rows."""
    entry = F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('": '), F.to_json(F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"))))
    maps = table(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    return readers.company_list(maps).select(F.col("cik").alias("ordinal"), "company", "ticker")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS awardee_name, c_acctbal AS award_amount FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 <> 0")
def watchlist_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select("c_custkey", F.when(k % 3 != 0, F.concat(F.lit("  "), F.col("c_name"))).alias("awardee_name"), F.when(k % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("amount"))
    return filters.watchlist_parse(raw).drop("amount")


_LINES = "SELECT event_id, (['ERROR: it broke', '=== Summary ===', 'plain line', 'a warning', 'Traceback (most recent call)', 'WARNING: low', '2024-01-01 plain'])[CAST(event_id % 7 + 1 AS INT)] AS line FROM events"


@query(f"WITH l AS ({_LINES}), c AS (SELECT event_id, regexp_matches(upper(line), 'ERROR|WARNING|FAILED|EXCEPTION|TRACEBACK') AS e, regexp_matches(line, '===|---|│|├|└|Summary|Results|Total') AS s FROM l) SELECT event_id, e AS errors_only, e OR s AS stats, e OR s AS summary, true AS plain FROM c")
def log_modes(spark: SparkSession, d: str) -> DataFrame:
    lines = F.element_at(F.array(*map(F.lit, ("ERROR: it broke", "=== Summary ===", "plain line", "a warning", "Traceback (most recent call)", "WARNING: low", "2024-01-01 plain"))), (F.col("event_id") % 7 + 1).cast("int"))
    df = table(spark, d, "events").select("event_id", lines.alias("line"))
    return df.select("event_id", *(C.kept_line(F.col("line"), m).alias(m) for m in ("errors_only", "stats", "summary", "plain")))


@query("""WITH l AS (SELECT conv_id, turn, text, turn % 3 <> 1 AS kept, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), k AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM l WHERE kept),
 m AS (SELECT conv_id, any_value(n) AS n, max(turn) AS last, string_agg(CASE WHEN turn - b > 1 THEN '[... ' || (turn - b - 1) || ' lines omitted ...]' || chr(10) ELSE '' END || length(text), chr(10) ORDER BY turn) AS t FROM k GROUP BY 1)
 SELECT conv_id, t || CASE WHEN last < n - 1 THEN chr(10) || '[... ' || (n - last - 1) || ' lines omitted ...]' ELSE '' END AS shown FROM m""")
def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    line = F.struct(F.col("turn").cast("bigint").alias("i"), F.length("text").cast("string").alias("line"))
    own = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("turn") % 3 != 1, line))).alias("x"), F.count("*").alias("n"))
    return own.where(F.size("x") > 0).select("conv_id", C.with_gaps(F.col("x"), F.col("n")).alias("shown"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20).select("event_id", "user_id", "value")


@query("WITH x AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d, value FROM events), px AS (SELECT user_id, d, max(value) AS close FROM x WHERE event_type = 'view' GROUP BY 1, 2) SELECT p.event_id, round((SELECT arg_max(close, px.d) FROM px WHERE px.user_id = p.user_id AND px.d <= p.d) * (1000 + p.user_id), 2) AS historical_market_cap FROM x p WHERE event_type = 'purchase'")
def historical_cap(spark: SparkSession, d: str) -> DataFrame:
    """The last close on or before an award's day times today's shares outstanding."""
    prices = table(spark, d, "events").where("event_type = 'view'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("close"))
    own = facts(spark, d, "purchase").select("event_id", "user_id", "d")
    priced = joins.backward_asof(own, prices, "user_id", "d", "day", None, "close")
    return priced.select("event_id", F.round(F.col("close") * (1000 + F.col("user_id")), 2).alias("historical_market_cap"))


@query(LOOKUPS + f""", s1 AS (SELECT award_id, awardee_name, cik, award_amount, posted_date, market_cap FROM ({AWARD}) WHERE NOT is_idiq AND award_amount >= 50000), s2 AS (SELECT s1.*, k.ticker FROM s1 JOIN known k USING (awardee_name) WHERE k.ticker IS NOT NULL), s3 AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY posted_date, award_id) - 1 AS prior_wins FROM s2)
 SELECT 'filter' AS stage, count(*) AS n, round(sum(award_amount), 2) AS amount FROM s1 UNION ALL SELECT 'resolve', count(*), round(sum(award_amount), 2) FROM s2 UNION ALL SELECT 'enrich', count(*), round(sum(award_amount * prior_wins), 2) FROM s3""")
def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Filter, resolve, enrich: each stage works on what the one before kept; a row a stage says how much that was."""
    _, known, _ = lookups(spark, d)
    kept = award(spark, d).where(~F.col("is_idiq") & (F.col("award_amount") >= 50_000))
    found = kept.join(known.where("ticker is not null").select("awardee_name", "ticker"), "awardee_name")
    rich = rows.prior_count(found, ["cik"], ["posted_date", "award_id"])
    row = lambda name, df, x: df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.round(F.sum(x), 2).alias("amount")).select("stage", "n", "amount")
    return row("filter", kept, F.col("award_amount")).union(row("resolve", found, F.col("award_amount"))).union(row("enrich", rich, F.col("award_amount") * F.col("prior_wins")))


# What writers leave for readers: each query writes to the shared folder and reads back.


@query("SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 10 = 0")
def ledger_versions(spark: SparkSession, d: str) -> DataFrame:
    """A ledger written, then rewritten from itself with more keys."""
    o, path, schema = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus", "o_orderkey"), shared(spark, "ledger"), "o_custkey bigint, day string"
    sinks.write_ledger(o.where("o_orderstatus = 'F'").select("o_custkey", "day"), path)
    sinks.write_ledger(sinks.published(spark, path, schema).union(o.where("o_orderkey % 10 = 0").select("o_custkey", "day")), path)
    return sinks.published(spark, path, schema)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END AS entry FROM customer")
def position_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A position table rewritten with the rows that changed."""
    c, path, schema = table(spark, d, "customer"), shared(spark, "positions"), "c_custkey bigint, status string, entry double"
    own = c.select("c_custkey", F.lit("open").alias("status"), F.col("c_acctbal").alias("entry"))
    sinks.write_positions(own.where("c_custkey % 3 <> 0"), path, schema, "c_custkey")
    sinks.write_positions(own.where("c_custkey % 3 = 0"), path, schema, "c_custkey")
    sinks.write_positions(own.where("c_custkey % 4 = 0").select("c_custkey", F.lit("closed").alias("status"), F.lit(0.0).alias("entry")), path, schema, "c_custkey")
    return sinks.published(spark, path, schema)


@query("SELECT 'k' || event_id AS key, event_type AS value FROM events WHERE event_id % 3 <> 0 AND user_id % 2 = 0 UNION ALL SELECT 'after', 'clear'")
def ttl_map(spark: SparkSession, d: str) -> DataFrame:
    """An expiring map: a missing one is empty, a saved one gives its live entries, a cleared one is empty again."""
    from bidsmith.streaming.state import live

    path, schema, now = shared(spark, "map"), "key string, value string, expires_at double", 1000.0
    missing = sinks.published(spark, path, schema)
    own = table(spark, d, "events").where("event_id % 3 <> 0").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.when(F.col("user_id") % 2 == 0, now + 1).otherwise(now).alias("expires_at"))
    sinks.publish(missing.unionByName(own), path)
    kept = live(sinks.published(spark, path, schema), F.lit(now)).select("key", "value")
    gone = shared(spark, "map")
    sinks.publish(own, gone)
    sinks.cleared(spark, gone)
    return kept.union(sinks.published(spark, gone, schema).select("key", "value")).union(spark.createDataFrame([("after", "clear")], "key string, value string"))


@query("SELECT c_name AS awardee_name, c_acctbal AS award_amount FROM customer WHERE c_custkey % 2 = 1")
def snapshot_clear(spark: SparkSession, d: str) -> DataFrame:
    """Two cached date ranges, of which one is cleared."""
    c, root = table(spark, d, "customer"), shared(spark, "snapshots")
    for k, (start, end) in enumerate((("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"))):
        sinks.write_snapshot(c.where(f"c_custkey % 2 = {k}").select(F.col("c_name").alias("awardee_name"), F.col("c_acctbal").alias("award_amount")), root, start, end)
    sinks.clear_snapshots(spark, root, "2024-01-01", "2024-01-15")
    both = [readers.snapshot(spark, root, a, b) for a, b in (("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"))]
    return both[0].union(both[1]).select("awardee_name", "award_amount")


@query("""SELECT '{"timestamp":"2024-01-02T03:04:05Z","level":"ERROR","logger":"bidsmith","message":"' || CASE WHEN c_acctbal <= 0 THEN 'no amount' ELSE 'no segment' END || '","c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","paid":' || (c_acctbal > 0) || '}' AS line FROM customer WHERE c_acctbal <= 0 OR c_mktsegment = 'MACHINERY' UNION ALL SELECT 'good ' || count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'""")
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a check become log lines; the others go on."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("paid"))
    good, lines = sinks.isolated(c, {"no amount": F.col("paid"), "no segment": F.col("c_mktsegment") != "MACHINERY"}, F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    return lines.union(good.agg(F.concat(F.lit("good "), F.count("*").cast("string")).alias("line")))


@query("SELECT 'T' || c_custkey AS ticker, c_name AS awardee_name, CAST(c_acctbal AS VARCHAR) AS award_amount FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'T' || c_custkey, c_name, CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0")
def signal_log(spark: SparkSession, d: str) -> DataFrame:
    """A signal log appended to twice, read by its header."""
    c, path = table(spark, d, "customer"), shared(spark, "signals")
    for k in (3, 5):
        sinks.append_signals(c.where(f"c_custkey % {k} = 0").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("awardee_name"), F.col("c_acctbal").alias("award_amount"), F.lit("x").alias("other")), path)
    return readers.plain_csv(spark, path).select("ticker", "awardee_name", "award_amount")


@query("SELECT s_suppkey, CAST(s_suppkey + 1 AS BIGINT) AS qty, leg.side AS side, leg.kind AS kind, round(leg.price, 2) AS price FROM (SELECT s_suppkey, unnest([{'side': 'buy', 'kind': 'market', 'price': s_suppkey * 1.0}, {'side': 'sell', 'kind': 'limit', 'price': s_suppkey * 1.5}, {'side': 'sell', 'kind': 'stop', 'price': s_suppkey * 0.5}]) AS leg FROM supplier)")
def order_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    sized = table(spark, d, "supplier").select("s_suppkey", (k + 1).alias("qty"), (k * 1.0).alias("price"), (k * 1.5).alias("take_profit"), (k * 0.5).alias("stop_loss"))
    return sinks.bracket_orders(sized, "s_suppkey").withColumn("price", F.round("price", 2))


@query("SELECT p_partkey, p_name AS title, CAST(p_retailprice AS DOUBLE) AS award_amount, regexp_matches(lower(p_name), 'zzz') AS sole_source FROM part WHERE p_partkey % 4 <> 0")
def opportunity_parse(spark: SparkSession, d: str) -> DataFrame:
    """Notices as JSON text, of which those without a positive amount or a name are left out."""
    k = F.col("p_partkey")
    notice = F.struct(F.col("p_name").alias("title"), k.cast("string").alias("solicitationNumber"), F.struct(F.when(k % 8 == 0, "0").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("amount"), F.struct(F.when(k % 8 == 4, "").otherwise("ACME").alias("name")).alias("awardee")).alias("award"))
    got = readers.opportunities(table(spark, d, "part").select(F.to_json(notice).alias("value")))
    return got.select(F.col("solicitation_number").cast("bigint").alias("p_partkey"), "title", "award_amount", "sole_source")


@query("SELECT o_orderkey AS piid, c_name AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_date, o_totalprice AS award_amount, o_orderstatus = 'F' AS is_educational FROM orders JOIN customer ON o_custkey = c_custkey")
def report_scan(spark: SparkSession, d: str) -> DataFrame:
    """A bulk report with a preamble and names over two lines, written as text and read in splits."""
    path = shared(spark, "report")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ["PIID", "CAGE Code", "Contractor Name", "Period of Performance Start Date", "Base and All Options Value (Total Contract Value)", "Is Vendor Business Type - Educational Institution"]
    row = [F.col("o_orderkey").cast("string"), F.lit("00000"), F.concat("c_name", F.lit("\n")), F.to_date("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"), F.when(F.col("o_orderstatus") == "F", "YES").otherwise("NO")]
    head = "a report\nof all orders, by a \"careful clerk\n" + ",".join(f'"{n}"' for n in names)
    lines = o.select(F.concat_ws(",", *(F.concat(F.lit('"'), c, F.lit('"')) for c in row)).alias("value"))

    def headed(batches):
        for k, batch in enumerate(batches):
            if not k:
                yield pa.RecordBatch.from_arrays([pa.array(head.split("\n"), batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    lines.mapInArrow(headed, "value string").write.text(path)  # a file a task, each with its preamble
    return readers.report_csv(spark, path).select(F.col("piid").cast("bigint").alias("piid"), F.col("contractor_name").alias("name"), "posted_date", "award_amount", "is_educational")
