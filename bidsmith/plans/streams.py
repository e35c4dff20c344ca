"""Stream queries over events: each runs a Structured Streaming job until the table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.operators import filters
from bidsmith.plans.awards import LIMITS, verdict_inputs
from bidsmith.plans.registry import ORACLES, query
from bidsmith.sources.sinks import settled
from bidsmith.streaming import keyed
from bidsmith.streaming import state as S
from bidsmith.streaming import verdicts


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    keys = ["user_id", "event_type", "day"]
    keyed = events(spark, d).select("user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    return S.drained(S.first_seen(keyed, keys, "ts").select(*keys), "dedup")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_count(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.window_counts(events(spark, d), "ts", ["event_type"], "1 hour"), "windows", "complete")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.running_counts(events(spark, d), "event_type"), "counts", "complete")


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "user_id", "event_type", "ts")
    return S.drained(S.changes(rows, "user_id", ["ts", "event_id"], "event_type", "ts"), "changes").drop("ts")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS r FROM events),
 s(user_id, r, ts, hit, given, until) AS (SELECT user_id, r, ts, false, value, ts + INTERVAL 3 DAY FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, e.ts, e.ts < s.until, CASE WHEN e.ts < s.until THEN s.given ELSE e.value END, CASE WHEN e.ts < s.until THEN s.until ELSE e.ts + INTERVAL 3 DAY END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
 SELECT user_id, count(*) AS n, count(*) FILTER (hit) AS hits, round(sum(given), 2) AS given FROM s GROUP BY 1""")
def stream_ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    seen = S.drained(S.cached(events(spark, d).select("user_id", "ts", "value"), "user_id", "ts", "value", 3), "cache")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.sum("given"), 2).alias("given"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, value) AS r FROM events),
 s(user_id, r, opened, entry, seen, was, closed, status, cost, paid) AS (SELECT user_id, r, CASE WHEN event_type = 'purchase' THEN ts END, CASE WHEN event_type = 'purchase' THEN value END, value, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE FROM e WHERE r = 1 UNION ALL
 SELECT user_id, r, CASE WHEN still THEN opened WHEN event_type = 'purchase' THEN ts END, CASE WHEN still THEN entry WHEN event_type = 'purchase' THEN value END, value,
  CASE WHEN due OR auto THEN opened END, CASE WHEN due THEN opened + INTERVAL 4 DAY WHEN auto THEN ts END, CASE WHEN due THEN 'closed_time' WHEN auto THEN 'closed_auto' END, CASE WHEN due OR auto THEN entry END, CASE WHEN due THEN seen WHEN auto THEN value END FROM
 (SELECT *, opened IS NOT NULL AND NOT due AND NOT auto AS still FROM (SELECT *, NOT due AND opened IS NOT NULL AND event_type = 'view' AS auto FROM (SELECT e.*, s.opened, s.entry, s.seen, coalesce(e.ts >= s.opened + INTERVAL 4 DAY, false) AS due FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)))),
 z AS (SELECT user_id, arg_max(s, r) AS x FROM s GROUP BY user_id)
 SELECT user_id, was AS opened, closed, status, cost AS entry, paid AS exit, round(paid - cost, 2) AS pnl FROM s WHERE status IS NOT NULL
 UNION ALL SELECT user_id, x.opened, x.opened + INTERVAL 4 DAY, 'closed_time', x.entry, x.seen, round(x.seen - x.entry, 2) FROM z WHERE x.opened + INTERVAL 4 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of four days at most; those still open close by time where the latest event is two days past it."""
    rows = events(spark, d).select("user_id", "ts", "event_type", "value")
    return S.drained(S.positions(rows, "user_id", "ts", "event_type", "value", "purchase", "view", 4, "2 days"), "positions")


#: The memo of each kind of event: users are asked about, and an answer is good for three days.
MEMO = """WITH RECURSIVE e AS (SELECT event_type, user_id, ts, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, value) AS r FROM events),
 s(event_type, user_id, r, ts, hit, given, until) AS (SELECT event_type, user_id, r, ts, false, value, ts + INTERVAL 3 DAY FROM e WHERE r = 1 UNION ALL SELECT e.event_type, e.user_id, e.r, e.ts, e.ts < s.until, CASE WHEN e.ts < s.until THEN s.given ELSE e.value END, CASE WHEN e.ts < s.until THEN s.until ELSE e.ts + INTERVAL 3 DAY END
 FROM s JOIN e ON e.event_type = s.event_type AND e.user_id = s.user_id AND e.r = s.r + 1)"""


@query(MEMO + " SELECT event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, hit, given FROM s")
def stream_memo(spark: SparkSession, d: str) -> DataFrame:
    """Lookups through one memo a service."""
    with keyed.rocksdb(spark):
        out = S.drained(keyed.memoized(events(spark, d).select("event_type", "user_id", "ts", "value"), "event_type", "user_id", "ts", "value", 3), "memo")
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(MEMO + ", z AS (SELECT event_type, user_id, arg_max(given, r) AS answer, max(until) AS until FROM s GROUP BY 1, 2) SELECT event_type, user_id, answer, strftime(until, '%Y-%m-%d %H:%M:%S') AS until FROM z WHERE until > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_memo_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What the memos hold when the stream has been read: entries whose time the watermark has not passed, read from the state store."""
    to = S.shared(spark, "memo")
    with keyed.rocksdb(spark):
        S.drained(keyed.memoized(events(spark, d).select("event_type", "user_id", "ts", "value"), "event_type", "user_id", "ts", "value", 3, "1 day"), "memo", to=to)
        left = settled(keyed.memo_table(spark, f"{to}/checkpoint", "event_type", "user_id"), "sweep")
    return left.withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


@query(ORACLES["award_verdict"])
def stream_award_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of `award_verdict`, with awards, filings and news as streams that are staged by a few days; a mark at the end of each lets the
    last ones out. Awards wait for the days that a stage holds, and what waits is kept in RocksDB."""
    end, days = F.lit("2024-12-31").cast("timestamp"), 4
    own, seen, kinds = verdict_inputs(spark, d)
    own, seen = own.withColumn("seen", F.col("seen").cast("timestamp")), seen.withColumn("d", F.col("d").cast("timestamp"))
    streams = []
    for name, rows, at in (("awards", own, "seen"), ("facts", seen, "d")):
        blank = {c: F.lit(None).cast(t) for c, t in rows.dtypes}
        last = spark.range(1).select(*((end if c == at else F.lit(-1).cast(t) if c == "award_id" else F.lit("error") if c == "event_type" else F.lit(-1).cast(t) if c == "cik" else blank[c]).alias(c) for c, t in rows.dtypes))
        streams.append(S.staged(rows.unionByName(last), at, S.shared(spark, name), days))
    met = verdicts.flagged(streams[0], streams[1], "award_id", "cik", "seen", "d", kinds, f"{days + 1} days")
    with keyed.rocksdb(spark):
        out = S.drained(met, "verdicts").where("award_id >= 0")
    return filters.live_verdict(out, LIMITS).select("award_id", "reason", "passed")
