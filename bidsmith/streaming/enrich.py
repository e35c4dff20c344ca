"""Enrichment that resumes: rows in small batches, each written once, whatever stops the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from bidsmith.sources.sinks import resumed


def enriched(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], done: str, need: list[str], path: str, checkpoint: str) -> None:
    """Run a stream of all-text rows to its end: rows to do are enriched, the others pass as they are.

    enrich: gives rows their values as text, with the same columns in any order and more. Each batch (as many files as the stream takes at a
    time) is a folder of the table at path, written whole under its number: a run that is stopped and started again goes on
    with the batch it was at, and asks for nothing that earlier batches have asked for.
    """

    def put(df: DataFrame, batch: int) -> None:
        finished, todo = resumed(df, done, need)
        finished.unionByName(enrich(todo), allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
