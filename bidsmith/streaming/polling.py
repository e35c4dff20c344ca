"""The polling job: a stream of overlapping windows, each record once in a ledger that survives replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What polls have found so far, with the number of the batch that found it."""
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(whole).parquet(path) if there else spark.createDataFrame([], whole)


def poll(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Start polling: records whose keys the ledger at path lacks are processed and put there, a folder a batch.

    at: a column that a record keeps whenever it is read, such as the day it was posted: only that part of the ledger is
    read that can hold a batch's records. Of a batch's records of one key the first by `at` counts. after: called with a batch's
    new rows once they are in the ledger. every: the interval between polls; without, one batch: the one that a
    crash left open or, where none was, what there is now.

    A batch that is run again (a crash before its commit) looks past its own folder and writes it anew, so the ledger has each
    record once, whatever fails; `after` may be called again, with the same rows.
    """

    def put(df: DataFrame, batch: int) -> None:
        spark, own = df.sparkSession, f"{path}/batch={batch}"
        df = df.persist()  # a poll asks the service once
        try:
            low = df.agg(F.min(at)).first()[0]
            known = ledger(spark, path, made).where((F.col("batch") < batch) & (F.col(at) >= F.lit(low))).select(*keys)
            first = Window.partitionBy(*keys).orderBy(at, *(c for c in df.columns if c != at))
            new = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(known, keys, "left_anti")
            (process(new) if process else new).select(*made.names).write.mode("overwrite").parquet(own)
        finally:
            df.unpersist()
        if after:
            after(spark.read.schema(made).parquet(own), batch)

    made = (process(stream) if process else stream).schema
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
