"""Writers: signal logs, ledgers, wide price tables, snapshots, expiring maps, tables that are rewritten, and order tables.

Appends are atomic by Spark's commit protocol. What replaces a table is written as a new version beside the last
(`publish`), in a folder of its own: readers take the newest version whose commit mark is there, so they see the old
table or the new one, a table may be rewritten from itself, and what a crashed write leaves is in nobody's way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.schemas import SIGNAL
from bidsmith.streaming.state import shared


def append_signals(df: DataFrame, path: str) -> None:
    """Append to a CSV log: its fields in order, others left out, missing ones empty."""
    have = set(df.columns)
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in SIGNAL)).write.mode("append").option("header", True).csv(path)


def _versions(spark: SparkSession, path: str, mark: str = "/_SUCCESS") -> list[tuple[int, str]]:
    """(number, path) of the committed versions, in order; with an empty mark, of all."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*{mark}")
    found = [f.getPath().getParent() if mark else f.getPath() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []]
    return sorted((int(f.getName()[1:].partition("-")[0]), f.toString()) for f in found)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def publish(df: DataFrame, path: str, keep: int = 2) -> None:
    """df in place of the table at path, as JSON lines. The last `keep` versions stay; older ones go, and with them what crashed writes of that time left."""
    spark = df.sparkSession
    old = _versions(spark, path)
    number = old[-1][0] + 1 if old else 1
    df.write.json(f"{path}/v{number}-{uuid.uuid4().hex}")
    kept = {where for _, where in old[len(old) + 1 - keep :]} if keep > 1 else set()
    for n, gone in _versions(spark, path, ""):
        if n < number and gone not in kept:
            _delete(spark, gone)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several plans or branches need is worked out once."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one where there is none. Lines that can't be read are left out."""
    found = _versions(spark, path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found[-1][1]) if found else spark.createDataFrame([], schema)


def cleared(spark: SparkSession, path: str) -> None:
    """No table at path any more."""
    _delete(spark, path)


def clear_snapshots(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> int:
    """Delete the cached awards of one date range, or of all; returns how many ranges went."""
    name = "awards_*" if start is None or end is None else f"awards_{start.replace('-', '')}_{end.replace('-', '')}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    found = [f.getPath().toString() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []]
    for path in found:
        _delete(spark, path)
    return len(found)


def write_ledger(keys: DataFrame, path: str) -> None:
    """The processed keys, distinct and in order, in place of the last."""
    publish(keys.distinct().orderBy(*keys.columns), path)


def write_positions(changed: DataFrame, path: str, schema: str, ident: str) -> None:
    """The position table with the changed rows in place of those of the same ident, and new ones added."""
    old = published(changed.sparkSession, path, schema).join(changed.select(ident), ident, "left_anti")
    publish(old.select(*changed.columns).unionByName(changed).orderBy(ident), path)


def isolated(df: DataFrame, checks: dict[str, Column], at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, error lines): a row that fails a check (false or null) is logged and the others go on.

    checks: message and condition; the first that fails is the row's error. at: the lines' time, now by default.
    """
    failed = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), m) for m, ok in checks.items()))
    marked = df.withColumn("_error", failed)
    return marked.where("_error is null").drop("_error"), log_lines(marked.where("_error is not null").withColumnRenamed("_error", "message"), "ERROR", at=at)


def wide_columns(first: list[str], added: list[str]) -> list[str]:
    """The columns of a wide table: the first ones in their order, then those of the others that aren't among them."""
    return [*first, *(c for c in dict.fromkeys(added) if c not in set(first))]


def write_wide(df: DataFrame, path: str, first: list[str]) -> None:
    """CSV with the columns named first, then the others as they come."""
    df.select(*wide_columns(first, df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, root: str, start: str, end: str) -> None:
    """The awards of a date range, in place of what was cached for it."""
    publish(df, f"{root}/awards_{start.replace('-', '')}_{end.replace('-', '')}", keep=1)


def log_lines(df: DataFrame, level: str = "INFO", logger: str = "bidsmith", at: Column | None = None) -> DataFrame:
    """One JSON log line a row: timestamp, level, logger, message (if there is one) and the other columns."""
    message = ["message"] if "message" in df.columns else []
    when = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select(F.to_json(F.struct(when.alias("timestamp"), F.lit(level).alias("level"), F.lit(logger).alias("logger"), *message, *(c for c in df.columns if c != "message"))).alias("line"))


def bracket_orders(sized: DataFrame, ident: str) -> DataFrame:
    """Order rows of sized signals: a buy with its target and stop. Nothing is sent to a broker."""
    leg = lambda side, price, kind: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.col(price).alias("price"))
    return sized.select(ident, "qty", F.explode(F.array(leg("buy", "price", "market"), leg("sell", "take_profit", "limit"), leg("sell", "stop_loss", "stop"))).alias("o")).select(ident, "qty", "o.*")


def resumed(rows: DataFrame, done: str, need: list[str]) -> tuple[DataFrame, DataFrame]:
    """(finished, to do): rows whose `done` column is filled or that lack a needed field count as finished."""
    filled = ~F.coalesce(F.trim(done), F.lit("")).isin("", "None")
    lacking = F.lit(False)
    for c in need:
        lacking = lacking | (F.coalesce(F.trim(c), F.lit("")) == "")
    return rows.where(filled | lacking), rows.where(~(filled | lacking))
