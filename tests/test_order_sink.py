"""Each batch once: failed tasks, failed batches, batches that are run again."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from bidsmith.sources import order_sink as O
from bidsmith.streaming import state as S

SCHEMA = "k bigint, side string"


def rows(spark, path):
    return sorted((r.k, r.side) for r in O.orders_of(spark, str(path), SCHEMA).collect())


def test_a_batch_counts_once(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"), F.lit("buy").alias("side")).repartition(4)
    O.write_orders(df, str(tmp_path), "one")
    O.write_orders(df, str(tmp_path), "one")
    O.write_orders(df.where("k < 3"), str(tmp_path))
    assert rows(spark, tmp_path) == sorted([(k, "buy") for k in [*range(50), 0, 1, 2]])
    assert len(os.listdir(tmp_path / "rows")) <= 8  # what the second write staged is gone


def test_failed_batch_leaves_nothing(spark, tmp_path):
    O.write_orders(spark.createDataFrame([(1, "buy")], SCHEMA), str(tmp_path), "good")
    bad = spark.range(40).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broker is away")).cast("bigint")).otherwise(F.col("id")).alias("k"), F.lit("sell").alias("side")).repartition(1)
    with pytest.raises(Exception, match="broker is away"):
        O.write_orders(bad, str(tmp_path), "bad")
    assert rows(spark, tmp_path) == [(1, "buy")]
    O.write_orders(spark.createDataFrame([(2, "sell")], SCHEMA), str(tmp_path), "bad")
    assert rows(spark, tmp_path) == [(1, "buy"), (2, "sell")]


def test_task_that_is_run_again(tmp_path):
    """Two attempts of one task stage two files; the manifest names that of the one which Spark counts."""
    writer = O.OrderStreamWriter({"path": str(tmp_path)}, ["k", "side"])
    first, second, other = (writer.write(iter([(k, "buy")])) for k in (1, 1, 2))
    writer.commit([second, other, None], 7)
    writer.commit([first], 7)  # the batch again, after a crash before Spark's own mark
    names = {line.split('"file": "')[1].split('"')[0] for line in (tmp_path / "batches" / "stream-7.json").read_text().splitlines()}
    assert names == {second.file, other.file}
    assert set(os.listdir(tmp_path / "rows")) == names


def test_stream_started_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, "buy")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: O.stream_orders(S.table_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "mark"))
    run()
    for name in os.listdir(tmp_path / "mark" / "commits"):  # as if stopped before the last batch's mark
        if name in ("2", ".2.crc"):
            os.remove(tmp_path / "mark" / "commits" / name)
    spark.createDataFrame([(3, "buy")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert rows(spark, tmp_path / "out") == [(k, "buy") for k in range(4)]
