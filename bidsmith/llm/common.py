"""What the training-data operators share: the shared folder, lineage cuts, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of all word rules here; bytes.split() without arguments splits at the same characters.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, cut down to the columns named."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a local one in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"{tempfile.gettempdir()}/bidsmith-checkpoints"
    return where.rstrip("/")


_CUT = "_bidsmith_cut"


def cut(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives any executor.

    spent: earlier cuts that nothing needs once df is written; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bidsmith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _CUT, path)
    discard(*spent)
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete the files of cuts that no plan reads any more, or the folder that a path names; other tables are left alone."""
    for df in tables:
        if path := df if isinstance(df, str) else getattr(df, _CUT, None):
            spark = SparkSession.active() if isinstance(df, str) else df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], often: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row a key and, in `often`, about how many rows of left that key has.

    The HOT most frequent keys are joined by a broadcast of their rows of right (HOT rows, a fixed bound),
    so no task gets more than a HOT-th of left for one key; all others are shuffled. `often` is dropped.
    """
    hot = F.broadcast(right.orderBy(F.desc(often), *keys).limit(HOT))
    rest = left.join(F.broadcast(right.orderBy(F.desc(often), *keys).limit(HOT).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).drop(often).unionByName(rest.hint("merge").join(right, keys, how).drop(often), allowMissingColumns=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches small enough that a batch of long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: str, modulus: int):
    """crc32 of doc_id as text, modulo: the fold of a row. A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def fold_of(doc_id: int | None, modulus: int) -> int:
    """The same fold in Python."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """name, with marks before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def annotate(docs: DataFrame, score: Callable[..., dict[str, Any]], fields: str, keep: list[str] | None = None, size: int = 3_000_000, text: str = "text") -> DataFrame:
    """docs with columns that score computes from the texts, batch by batch, in Arrow.

    score gets the texts of a batch (about size UTF-8 bytes; a longer text is a batch of its own)
    and their record batch, and returns one sequence for each name in fields (a DDL string).
    keep: the columns of docs to pass on, all by default. A new column replaces one of docs
    that has its name, in any letter case.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType.fromDDL(fields)
    names = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = StructType([*kept, *added])
    arrow, own = to_arrow_schema(schema), [f.name for f in kept]
    source = docs if keep is None else docs.select(*dict.fromkeys([*own, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, size):
                new = score(part.column(text).to_pylist(), part)
                columns = [part.column(n) for n in own] + [x if isinstance(x := new[f.name], pa.Array) else pa.array(x, arrow.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch, cut so that the texts of each piece hold about size bytes."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff(np.cumsum(lengths.astype(np.int64)) // size)) + 1
    for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
        # copied: kernels of the Arrow library at hand misread strings of a slice that starts within a buffer
        yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))
