"""Queries of the paged connector over events: a service kept in files by day, read with filters sent to it, and polled as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.plans.registry import query, table
from bidsmith.sources.paged import paged_stream, paged_table
from bidsmith.streaming.polling import ledger, poll
from bidsmith.streaming.state import shared

FETCH, NOTICE = "bidsmith.sources.paged:folder_page", "event_id bigint, user_id bigint, kind string, posted string, amount double"


def service(spark: SparkSession, d: str) -> str:
    """Events as notices that a service files by day; every 50th shows up half an hour after its time."""
    to, ts = shared(spark, "service"), F.col("ts").cast("timestamp")
    late = F.when(F.col("event_id") % 50 == 0, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), stamp(ts).alias("posted"), F.col("value").alias("amount"), stamp(ts + late).alias("seen"), F.to_date("ts").cast("string").alias("day"))
    e.repartition("day").write.partitionBy("day").parquet(to)
    return to if "://" in to else to if to.startswith("file:") else f"file://{to}"


_POSTED = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query(f"SELECT event_id, user_id, value AS amount, {_POSTED} AS posted FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 20 AND CAST(ts AS DATE) = DATE '2024-01-09'")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Four tasks page through the service side by side; kinds, amounts, the day and the columns are its filters."""
    rows = paged_table(spark, FETCH, f"{NOTICE}, day string", ["event_id", "user_id", "kind", "posted", "amount", "day"], lanes=4, size=20, order="event_id", **{"filter.folder": service(spark, d)})
    wanted = rows.where(F.col("kind").isin("purchase", "signup") & (F.col("amount") >= 20) & (F.col("day") == "2024-01-09"))
    return wanted.select("event_id", "user_id", "amount", "posted")


@query("SELECT event_id, event_type AS kind, value AS amount FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 100")
def paged_most(spark: SparkSession, d: str) -> DataFrame:
    """The 100 largest purchases, an exact limit that the connector keeps by the service's order."""
    return paged_table(spark, FETCH, NOTICE, ["event_id", "kind", "amount"], size=30, most=100, order="-amount,event_id", **{"filter.folder": service(spark, d), "filter.kind": "purchase"})


#: The times of four polls; the third repeats the second, so it has nothing new.
POLLS = ("2024-01-05T06:00:00", "2024-01-12T18:30:00", "2024-01-12T18:30:00", "2024-01-24T11:45:00")
_SEEN = "ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END"


@query(f"SELECT event_id, user_id, {_POSTED} AS posted, batch FROM (SELECT *, CASE {' '.join(f'''WHEN strftime({_SEEN}, '%Y-%m-%dT%H:%M:%S') <= '{t}' THEN {k}''' for k, t in enumerate(dict.fromkeys(POLLS)))} END AS batch FROM events WHERE value >= 5) WHERE batch IS NOT NULL")
def polled_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Four polls, each started anew from the checkpoint: every notice of 5 or more once, with the batch that found it."""
    folder, to, mark = service(spark, d), shared(spark, "ledger"), shared(spark, "polls")
    for now in POLLS:
        stream = paged_stream(spark, FETCH, NOTICE, "2024-01-01T00:00:00", now=now, size=50, **{"filter.folder": folder, "filter.order": "event_id"}).where("amount >= 5")
        poll(stream, ["event_id"], "posted", to, mark).awaitTermination()
    return ledger(spark, to, stream.schema).select("event_id", "user_id", "posted", "batch")
