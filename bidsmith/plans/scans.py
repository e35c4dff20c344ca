"""Queries that run whole scans: reports behind their filters, feeds, watchlists, lines, and enrichment in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.functions import cleaning as C
from bidsmith.functions import text as X
from bidsmith.operators import filters, joins, rows
from bidsmith.operators import trades as T
from bidsmith.plans.awards import AWARD, LIMITS, award
from bidsmith.plans.registry import query, table
from bidsmith.plans.trades import BARS, bars
from bidsmith.sources import readers, sinks
from bidsmith.sources.order_sink import orders_of, stream_orders, write_orders
from bidsmith.sources.paged import paged_table
from bidsmith.streaming import state as S
from bidsmith.streaming.enrich import enriched

_PARTS = {"PIID": "piid", "CAGE Code": "cage", "Contractor Name": "name", "Country of Incorporation": "country", "IDV Type": "idv", "Base and All Options Value (Total Contract Value)": "amount"}
_COUNTRY = "(['USA',' usa','GBR','','USA'])[CAST(o_orderkey % 5 + 1 AS INT)]"
_IDV = "(['','  ','IDC'])[CAST(o_orderkey % 3 + 1 AS INT)]"


@query(f"SELECT o_orderkey AS piid, c_name || ' Ñü' AS name, o_totalprice AS award_amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE upper(trim({_COUNTRY})) = 'USA' AND trim({_IDV}) = '' AND o_totalprice BETWEEN 50000 AND 450000")
def report_filters(spark: SparkSession, d: str) -> DataFrame:
    """The newest report of a folder, in Latin-1 and read by byte ranges: domestic awards of a size in range, no umbrella contracts."""
    folder, o = S.shared(spark, "reports"), table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    own = {"piid": F.col("o_orderkey").cast("string"), "cage": F.lit("0AB12"), "name": F.concat("c_name", F.lit(" Ñü")), "country": pick(("USA", " usa", "GBR", "", "USA")), "idv": pick(("", "  ", "IDC")), "amount": F.col("o_totalprice").cast("string")}
    lines = o.select(F.concat_ws(",", *(F.concat(F.lit('"'), own[c], F.lit('"')) for c in _PARTS.values())).alias("value"))
    head = spark.range(3, numPartitions=1).select(F.element_at(F.array(F.lit("a report"), F.lit(""), F.lit(",".join(_PARTS))), (F.col("id") + 1).cast("int")).alias("value"))
    old, new = f"{folder}/SAM_old.csv", f"{folder}/FirstReport.csv"
    one_file(lines.limit(3), old)
    one_file(head.unionByName(lines), new)
    return filters.bulk_scan(readers.report_csv(spark, readers.newest_report(spark, folder), "iso-8859-1", 1 << 18), LIMITS).select(F.col("piid").cast("bigint").alias("piid"), F.col("contractor_name").alias("name"), "award_amount")


def one_file(lines: DataFrame, path: str) -> None:
    """Lines as one file of the given name, in Latin-1: what a clerk would download."""
    spark, hadoop = lines.sparkSession, lines.sparkSession._jvm.org.apache.hadoop.fs
    lines.coalesce(1).write.option("encoding", "iso-8859-1").option("quote", "").option("escape", "").option("sep", "\u0001").option("emptyValue", "").csv(f"{path}.parts")
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.rename(files.globStatus(hadoop.Path(f"{path}.parts/part-*"))[0].getPath(), hadoop.Path(path))


_WIRE = "(['PRNewswire','a blog','BusinessWire','radio','AccessWire'])[CAST(page_id % 5 + 1 AS INT)]"
_AT = "TIMESTAMP '2024-03-01 08:30:00' + INTERVAL 1 HOUR * (page_id % 400)"


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Pages as items of 25 feeds: URLs with entities, headlines in CDATA, a source with an attribute; every 9th item isn't well formed."""
    i, at = F.col("page_id"), F.to_timestamp(F.lit("2024-03-01 08:30:00")) + F.make_interval(hours=(F.col("page_id") % 400).cast("int"))
    wire = F.element_at(F.array(*map(F.lit, ("PRNewswire", "a blog", "BusinessWire", "radio", "AccessWire"))), (i % 5 + 1).cast("int"))
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    title = F.when(i % 2 == 0, F.concat(F.lit("<![CDATA["), F.col("url"), F.lit("]]>"))).otherwise(url)
    item = F.concat(F.lit('<item xmlns:m="urn:m"><title>'), title, F.lit("</title><m:note>x</m:note><source url='u'>"), wire, F.lit("</source><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.when(i % 9 == 0, "</pubDat></item>").otherwise("</pubDate></item>"))
    return table(spark, d, "pages").select((i % 25).alias("feed"), i, item.alias("item")).groupBy("feed").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "\n"), F.lit("</channel></rss>")).alias("text"))


@query(f"SELECT page_id % 25 AS feed, CASE WHEN page_id % 9 <> 0 THEN url END AS title, CASE WHEN page_id % 9 <> 0 THEN strftime({_AT}, '%Y-%m-%d %H:%M') END AS published FROM pages")
def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.feed_items(feeds(spark, d), "text", "feed").select("feed", "title", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"))


@query(f"SELECT feed, min(CASE WHEN wire AND pub BETWEEN day - INTERVAL 1 DAY AND day + INTERVAL 7 DAY THEN CAST(pub AS DATE) END) AS first_pr FROM (SELECT page_id % 25 AS feed, TIMESTAMP '2024-03-03' + INTERVAL 1 DAY * (page_id % 25 % 9) AS day, {_AT} AS pub, page_id % 9 <> 0 AND page_id % 5 IN (0, 2, 4) AS wire FROM pages) GROUP BY 1")
def feed_first_press(spark: SparkSession, d: str) -> DataFrame:
    """The first wire report around each feed's award date."""
    items = readers.feed_items(feeds(spark, d), "text", "feed").withColumn("day", F.date_add(F.lit("2024-03-03"), (F.col("feed") % 9).cast("int")))
    return readers.first_press(items, "feed", "day", 7)


@query(f"""WITH a AS ({AWARD}), w AS (SELECT s_suppkey, 'T' || s_suppkey AS ticker, abs(s_acctbal) * 100 AS market_cap, unnest(['Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'Customer#' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0')]) AS name, unnest([0, 1]) AS position FROM supplier),
 f AS (SELECT w.*, award_id, award_amount, CASE WHEN award_id % 4 > 0 THEN 'S' || award_id // 8 ELSE '' END AS number, row_number() OVER (PARTITION BY ticker, name ORDER BY award_amount DESC, award_id) AS r FROM w JOIN a ON awardee_name = name)
 SELECT ticker, market_cap, award_id, number FROM (SELECT *, row_number() OVER (PARTITION BY ticker, CASE WHEN number = '' THEN CAST(award_id AS VARCHAR) ELSE number END ORDER BY position, r) AS k FROM f WHERE r <= 5) WHERE k = 1""")
def watchlist_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each listed company's names searched for their five largest awards, tagged with ticker and market cap, and numbers kept once a ticker."""
    code = lambda shift: F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") + shift).cast("string"), 9, "0"))
    watch = table(spark, d, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), code(0).alias("name"), F.array(code(1)).alias("aliases"), (F.abs("s_acctbal") * 100).alias("market_cap"))
    names = joins.search_names(watch).join(watch.select("ticker", "market_cap"), "ticker")
    own = award(spark, d).drop("market_cap").withColumn("number", F.when(F.col("award_id") % 4 > 0, F.concat(F.lit("S"), F.floor(F.col("award_id") / 8).cast("string"))).otherwise(""))
    best = rows.top_per_key(names.join(own, F.col("search_name") == F.col("awardee_name")), ["ticker", "search_name"], [F.desc("award_amount"), F.col("award_id")], 5)
    return rows.keep_first(best, "ticker", "number", [F.col("position"), F.desc("award_amount"), F.col("award_id")]).select("ticker", "market_cap", "award_id", "number")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'position already open' WHEN 1 THEN CASE WHEN c_custkey % 10 = 1 THEN 'position lookup failed' END WHEN 2 THEN 'open order already exists' END AS guard FROM customer")
def guard_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a signal isn't traded: a failed position lookup rejects, a failed order lookup doesn't."""
    c, k = table(spark, d, "customer").select("c_custkey"), F.col("c_custkey")
    held = c.select("c_custkey", F.when(k % 5 == 0, "open").when(k % 10 == 1, "failed").otherwise("closed").alias("status"))
    orders = c.select("c_custkey", F.when(k % 5 == 2, "open").when(k % 5 == 3, "failed").otherwise("closed").alias("status"))
    return T.guarded(c, held, orders, "c_custkey")


_FLAGS = "(['True',' yes','1','no','0','','TRUE ','y'])[CAST(event_id % 8 + 1 AS INT)]"


@query(f"SELECT event_id, lower(trim({_FLAGS})) IN ('true', '1', 'yes') AS flag FROM events")
def flag_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("True", " yes", "1", "no", "0", "", "TRUE ", "y"))), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", C.truthy(raw).alias("flag"))


@query(f"""SELECT DISTINCT '["' || awardee_name || '","' || printf('%.1f', round(award_amount)) || '","' || CAST(posted_date AS VARCHAR) || '"]' AS key FROM ({AWARD})""")
def award_keys(spark: SparkSession, d: str) -> DataFrame:
    """The text that tells awards apart in a ledger: name, amount and day as a JSON array."""
    a = award(spark, d)
    key = C.award_key(F.col("awardee_name"), F.concat(F.format_string("%.0f", F.round("award_amount")), F.lit(".0")), F.col("posted_date"))
    return a.select(C.key_text(key).alias("key")).distinct()


@query("SELECT event_type AS line, count(*) AS n FROM events GROUP BY 1")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines as they arrive in a folder, counted."""
    folder = S.shared(spark, "lines")
    table(spark, d, "events").select("event_type").repartition(3).write.text(folder)
    return S.drained(readers.line_stream(spark, folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n")), "line-scan", "complete")


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0")
def json_line_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, of which every seventh is cut off and left out."""
    folder, whole = S.shared(spark, "json-lines"), F.to_json(F.struct("event_id", "event_type"))
    table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(folder)
    return readers.json_lines(spark, folder, "event_id bigint, event_type string")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS length, CASE WHEN event_id % 3 = 0 THEN 'event_type,k' ELSE 'k' END AS keys, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'none' END AS kind, contains(event_type, 'i') AND event_id % 3 = 0 AS has_i, CAST(user_id AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) AS slice FROM events""")
def json_cookbook(spark: SparkSession, d: str) -> DataFrame:
    """What a JSON query language says of each record: length, keys, a default for null, contains, a slice of an array."""
    e = table(spark, d, "events")
    text = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"), F.get_json_object("props", "$.k").alias("k")))
    got = e.select("event_id", F.from_json(text, "map<string, string>").alias("o"), F.array(F.col("value").cast("string"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("z")).alias("a"))
    kind = F.coalesce(F.try_element_at("o", F.lit("event_type")), F.lit("none"))
    return got.select("event_id", F.size("o").alias("length"), F.array_join(F.sort_array(F.map_keys("o")), ",").alias("keys"), kind.alias("kind"), (F.contains(kind, F.lit("i")) & (kind != "none")).alias("has_i"), F.array_join(F.slice("a", 2, 2), ",").alias("slice"))


@query("""SELECT award_id, '{"ratio":' || CASE WHEN award_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"agency":"' || agency || '"}' AS dump FROM (""" + AWARD + ")")
def breakdown_dump(spark: SparkSession, d: str) -> DataFrame:
    """A breakdown as the text that a log keeps."""
    return award(spark, d).select("award_id", F.to_json(F.struct((F.col("award_id") % 2 == 0).alias("ratio"), "agency")).alias("dump"))


def busy_page(filters_: dict, page: int, size: int):
    """`folder_page` of a service that is busy at each second request of a worker."""
    from bidsmith.sources.paged import folder_page

    busy_page.calls = getattr(busy_page, "calls", 0) + 1
    return folder_page(filters_, page, size) if busy_page.calls % 2 else None


@query("SELECT event_id, event_type AS kind FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def busy_scan(spark: SparkSession, d: str) -> DataFrame:
    """A service that is busy at every second request, asked again after a pause, with pauses between requests; as many tasks as run at once page side by side."""
    from bidsmith.plans.polls import NOTICE, service

    return paged_table(spark, "bidsmith.plans.scans:busy_page", NOTICE, ["event_id", "kind"], size=25, pause=0.01, backoff=0.02, order="event_id", lanes=spark.sparkContext.defaultParallelism, **{"filter.folder": service(spark, d), "filter.day": "2024-01-15"})


@query(f"""WITH {BARS}, p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_id % 6 = 0 AS had, event_id % 11 = 0 AS lacks FROM events WHERE event_type = 'purchase')
 SELECT event_id, CASE WHEN had THEN '1.5' WHEN lacks THEN '' ELSE coalesce(CAST(b.open AS VARCHAR), 'None') END AS open_t0, CASE WHEN had OR lacks THEN '' ELSE coalesce(CAST(b.close AS VARCHAR), 'None') END AS close_t0 FROM p LEFT JOIN bars b ON b.ticker = user_id AND b.trade_date = day""")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Rows enriched with their day's bar in batches of one file; rows that were done or lack a ticker pass as they are. The table's columns are the old ones, then the new."""
    i, to = F.col("event_id"), S.shared(spark, "enriched")
    own = table(spark, d, "events").where("event_type = 'purchase'").select(i.cast("string").alias("event_id"), F.when(i % 11 == 0, "").otherwise(F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").cast("string").alias("posted_date"), F.when(i % 6 == 0, "1.5").otherwise("").alias("open_t0"))
    own.repartition(4).write.parquet(f"{to}/in")
    prices = bars(spark, d).select(F.col("ticker").cast("string").alias("ticker"), F.col("trade_date").cast("string").alias("posted_date"), *(F.col(c).cast("string").alias(f"{c}_t0") for c in ("open", "close")))

    def enrich(todo: DataFrame) -> DataFrame:
        return todo.drop("open_t0").join(prices, ["ticker", "posted_date"], "left").fillna("None", ["open_t0", "close_t0"])

    enriched(S.table_stream(spark, f"{to}/in"), enrich, "open_t0", ["ticker", "posted_date"], f"{to}/out", f"{to}/mark")
    columns = sinks.wide_columns(own.columns, ["open_t0", "close_t0"])
    wide = spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(f"{to}/out")
    sinks.write_wide(wide, f"{to}/wide", own.columns)
    back = readers.plain_csv(spark, f"{to}/wide")
    return back.select(F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("open_t0", F.lit("")).alias("open_t0"), F.coalesce("close_t0", F.lit("")).alias("close_t0"))


_CODE = "CASE WHEN page_id % 4 = 1 THEN 'def f(x):\nimport y;\nreturn x;\n' || substr(html, 1, 100) WHEN page_id % 4 = 2 THEN '{{\"a\": [1, 2, 3]}}' WHEN page_id % 4 = 3 THEN 'id 550e8400-e29b-41d4-a716-446655440000 of ' || url ELSE '' END".replace("{{", "{").replace("}}", "}")


@query(f"""SELECT page_id, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE floor(length(t) / CASE page_id % 4 WHEN 1 THEN 3.5 WHEN 2 THEN 3.2 ELSE 4.0 END + 0.5) + CASE page_id % 4 WHEN 1 THEN length(regexp_replace(array_to_string(regexp_extract_all(t, 'https?://\\S+'), ''), '[^/?&]', '', 'g')) WHEN 3 THEN 2 + length(regexp_replace(url, '[^/?&]', '', 'g')) ELSE 0 END END AS BIGINT) AS tokens FROM (SELECT *, {_CODE} AS t FROM pages)""")
def token_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Estimates for code, JSON, identifiers and URLs, and no text."""
    k = F.col("page_id") % 4
    own = F.when(k == 1, F.concat(F.lit("def f(x):\nimport y;\nreturn x;\n"), F.substring("html", 1, 100))).when(k == 2, '{"a": [1, 2, 3]}').when(k == 3, F.concat(F.lit("id 550e8400-e29b-41d4-a716-446655440000 of "), F.col("url"))).otherwise("")
    return table(spark, d, "pages").select("page_id", X.estimated_tokens(own).alias("tokens"))


@query("SELECT s_suppkey, 'buy' AS side, CAST(s_suppkey + 1 AS BIGINT) AS qty FROM supplier UNION ALL SELECT s_suppkey, 'sell', CAST(s_suppkey + 1 AS BIGINT) FROM supplier WHERE s_suppkey % 3 = 0")
def order_book(spark: SparkSession, d: str) -> DataFrame:
    """Orders through the sink: a stream's batches, and one batch that is written twice and counts once."""
    to, k = S.shared(spark, "orders"), F.col("s_suppkey")
    uri = to if ":" in to else f"file://{to}"
    own = table(spark, d, "supplier").select("s_suppkey", (k + 1).alias("qty"))
    own.withColumn("side", F.lit("buy")).repartition(3).write.parquet(f"{to}-in")
    stream_orders(S.table_stream(spark, f"{to}-in"), uri, f"{to}-mark")
    for _ in range(2):
        write_orders(own.where("s_suppkey % 3 = 0").withColumn("side", F.lit("sell")), uri, "closing")
    return orders_of(spark, to, "s_suppkey bigint, side string, qty bigint")
