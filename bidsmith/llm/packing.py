"""Harmonic packing: token sequences filled by pieces of reciprocal-capacity classes, worker by worker.

Class k holds pieces of capacity // k tokens, or, where several lengths share that many to a sequence, pieces of one
length each; a sequence of a class always takes the same number of pieces, so a worker fills it without knowing others'
lengths. A document is cut into whole sequences (class 1), and its rest greedily into the largest class size that fits, as a
fraction is into unit fractions: three or four cuts at most for 1,024. A full sequence lacks less than one piece.

What a worker cannot fill (less than one sequence a class) is filled across workers in a second round, by rank within the
class over all leftovers; what remains then (less than one sequence a class in all, so a bound that no input changes) is laid
end to end in one last task, cut at the capacity, and its end into powers of two, which take no padding.

Files read as they lie decide who is a worker: pieces are rows of one written table, so an executor lost later
changes nothing. Defined results: null counts as the empty text; every document ends with end_id, so none is without a
piece; rows of one doc_id are documents of their own; a very long text is many whole sequences; an empty table gives no rows;
further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import cut
from bidsmith.llm.sharding import ranked
from bidsmith.llm.token_ids import joined, tokenize

#: First sequence ids of the second round and of the last task; a worker's own are its number << 32 and up.
SECOND, LAST = 1 << 61, 1 << 62
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PLACED = f"{_PIECE}, sequence_id bigint, offset bigint"


def sizes(capacity: int) -> np.ndarray:
    """The class sizes, largest first: capacity // k for each k, which for small sizes is every length."""
    return np.unique(capacity // np.arange(1, capacity + 1))[::-1]


def cut_lengths(tokens: int, size: np.ndarray) -> list[int]:
    """A document's pieces in order: whole sequences, then the largest class size that fits, and so on."""
    out = [int(size[0])] * (tokens // int(size[0]))
    rest = tokens % int(size[0])
    while rest:
        s = int(size[np.searchsorted(-size, -rest)])
        out.append(s)
        rest -= s
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def filled(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces in the sequences that each worker fills by itself; those left have no sequence, but their `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size, number = sizes(capacity), TaskContext.get().partitionId() << 32
        open_: dict[int, list] = {}  # at most one sequence of each class
        names = [f.split()[0] for f in f"{_PLACED}, ids binary".split(", ")]

        def batch(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

        for part in joined(batches):
            done = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), tokenize(part.column("text"), path, end_id), strict=True):
                start, n = 0, len(ids)
                for length in cut_lengths(n, size):
                    own = ids[start : start + length]
                    held = open_.setdefault(length, [])
                    held.append((doc, start, length, crc(own), n, own if length == capacity else own.copy()))
                    if len(held) == capacity // length:
                        done += [(*p[:5], number, k * length, None) for k, p in enumerate(held)]
                        number += 1
                        del open_[length]
                    start += length
            yield batch(done)
        yield batch([(*p[:5], None, None, p[5].astype("<u4").tobytes()) for held in open_.values() for p in held])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"{_PLACED}, ids binary")


def laid(pieces: DataFrame, capacity: int) -> DataFrame:
    """The last pieces end to end, in one task: their tokens are fewer than capacity for each class, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        total, at, sequence, done = sum(r["length"] for r in rows), 0, LAST, []
        ends = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if total % capacity >> k & 1]
        room, ends = (ends[0] if ends else 0), ends[1:]
        for r in rows:
            ids, start = np.frombuffer(r["ids"], "<u4"), 0
            while start < len(ids):
                own = ids[start : start + room]
                done.append((r["doc_id"], r["start"] + start, len(own), crc(own), r["doc_tokens"], sequence, at))
                start, at, room = start + len(own), at + len(own), room - len(own)
                if not room:
                    sequence, at, room, ends = sequence + 1, 0, (ends[0] if ends else 0), ends[1:]
        names = [f.split()[0] for f in _PLACED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)] or [pa.array([], pa.int64())] * len(names), names=names)

    return pieces.repartition(1).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(run, _PLACED)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    start: the document's ids before the piece; offset: the sequence's; ids_crc32: of the piece's ids as little-endian
    32-bit integers; doc_tokens: all ids of the document, with the one that ends it.
    """
    made = cut(filled(docs, path, end_id, capacity), "pieces")
    whole = made.where("sequence_id is not null").drop("ids")
    place = ranked(made.where("sequence_id is null").withColumn("_one", F.lit(1).cast("bigint")), ["doc_id", "start", "ids_crc32"], "_one", "length")
    left = cut(place.drop("_one"), "left")
    many = left.groupBy("length").agg(F.count("*").alias("_many"))  # a row a class
    per, before = F.floor(F.lit(capacity) / F.col("length")), F.col("before")
    left = left.join(F.broadcast(many), "length").withColumn("_bin", F.floor(before / per))
    full = (F.col("_bin") + 1) * per <= F.col("_many")
    number = F.lit(SECOND) + F.col("length") * F.lit(1 << 44) + F.col("_bin")
    second = left.where(full).select(*whole.columns[:5], number.alias("sequence_id"), (before % per * F.col("length")).alias("offset"))
    last = laid(left.where(~full).select(*whole.columns[:5], "ids"), capacity)
    return whole.unionByName(second).unionByName(last)
