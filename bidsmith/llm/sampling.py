"""Sampled SentencePiece encoding: forward filtering, backward sampling over the piece lattice.

Each text gets one segmentation, drawn with probability proportional to the product of its
pieces' probabilities to the power `sharpness`. The row key, the word's place in the text and
`seed` decide every draw, so a run gives the same ids wherever and however often a row is
computed. Decoding gives back the text, whatever it holds.

Defined results: null and the empty text have no ids (null ones in the table of ids stay null); an empty table gives no
rows; rows with the same key and text get the same ids; a null key draws as its own key; equally likely paths are
drawn equally often; very long texts are one batch of their own and are encoded whole; further columns
pass through, and one named ids (or decoded), in any letter case, is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm import lattice
from bidsmith.llm.common import annotate, free_name, small_batches


def sampled(texts: pa.Array, keys: list, path: str, sharpness: float, seed: int) -> list[np.ndarray]:
    """Piece ids of each text."""
    number, words, distinct = lattice.split(texts)
    if not len(words):
        return [np.empty(0, np.int32)] * len(texts)
    own = lattice.Lattice(lattice.pieces(path), distinct, automaton=False)
    own.weigh(sharpness)
    key = np.fromiter((-1 if k is None else zlib.crc32(str(k).encode(), seed) for k in keys), np.int64, len(keys)).astype(np.uint64)
    first = np.cumsum(number) - number
    place = np.arange(len(words)) - np.repeat(first, number)
    with np.errstate(over="ignore"):
        seeds = (np.repeat(key, number) << np.uint64(32)) * np.uint64(0xA0761D6478BD642F) + place.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(seed)
        seeds ^= seeds >> np.uint64(29)
        seeds *= np.uint64(0x8EBC6AF09C88C6E3)
    ids, n = own.sample(words, seeds)
    ends = np.concatenate(([0], np.cumsum(n)))
    return [ids[a:b] for a, b in zip(ends[first], ends[first + number], strict=True)]


def encode(docs: DataFrame, path: str, key: str = "doc_id", sharpness: float = 0.5, seed: int = 1) -> DataFrame:
    """docs with `ids`: the piece ids of a sampled segmentation of each text."""
    small_batches(docs.sparkSession)

    def score(_, part):
        texts = part.column("text")
        ids = sampled(texts, part.column(key).to_pylist(), path, sharpness, seed)
        return {"ids": pa.array([x if ok else None for x, ok in zip(ids, texts.is_valid().to_pylist(), strict=True)], pa.list_(pa.int32()))}

    return annotate(docs, score, "ids array<int>", None, 2_500_000)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with `decoded`: the text of their ids; null ids give null."""
    none = free_name(rows, "none")
    return annotate(rows.withColumn(none, F.lit(None).cast("string")), lambda _, part: {"decoded": [None if x is None else lattice.decode(lattice.pieces(path), np.array(x)) for x in part.column("ids").to_pylist()]}, "decoded string", rows.columns, text=none)


def digests(docs: DataFrame, path: str, key: str = "doc_id", sharpness: float = 0.5, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids) and whether decoding gave the text back."""
    small_batches(docs.sparkSession)

    def score(texts, part):
        ids = sampled(part.column("text"), part.column(key).to_pylist(), path, sharpness, seed)
        own = lattice.pieces(path)
        return {"n_pieces": list(map(len, ids)), "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "lossless": [t is None or lattice.decode(own, x) == t for t, x in zip(texts, ids, strict=True)]}

    return annotate(docs, score, "n_pieces bigint, ids_crc32 bigint, lossless boolean", [key], 2_500_000)
