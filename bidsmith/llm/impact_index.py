r"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks (BLOCK documents or TEXT bytes, whichever comes first), in order of doc_id within a block. A block
keeps, for each of its terms, the documents that hold it and bitmaps of the bits of their impacts, one bitmap a bit (a slice),
over the term's own documents. Impacts there are without the term's weight, which depends on all blocks; a search reads
the document frequencies of its terms from the index, and multiplies slices by weights in shifted bitwise additions.

In a block, slices go from a term's documents to bitmaps over the block's; all terms of an item are added slice by slice
from the least, each bit into vertical counters whose upper bits carry over to the next slice. The k best come from
the most significant slice down: as long as more than k documents have all bits set so far they are narrowed down, else they are taken
and the others go on; of equal scores the smallest doc_ids are taken. Every block gives its k best of each item, exactly, and a window ranks them.

Terms are 64-bit hashes: two terms of a search and a table of 10^9 terms are the same with a probability under 10^-6.
Items come PASS at a time, from the driver to all workers, and a worker takes PART of them at once.

Defined results: null, empty or wordless texts have no terms, rank nowhere and don't count; such items give no rows; repeated
item rows are one item, and items of one id but different texts are each ranked; rows of one doc_id are documents of their own; a
null doc_id comes first among equal scores; a very long text is read in parts that end between terms; an empty table
gives no rows; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidsmith.llm.common import cut, discard, pieces, shared_dir
from bidsmith.llm.decontaminate import passes
from bidsmith.llm.text import Words

#: Fixed: terms, after A-Z are lower-cased, and the constants of weights and impacts.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SATURATION, LENGTH = 1_000_000_000, 8, 90

BLOCK, TEXT, READ, PART, TERMS = 8192, 16_000_000, 3_000_000, 512, 8192
_PARTING = re.compile(r"[\x00-/:-@\[-`{-\x7f]")
_SCHEMA = "doc_ids binary, nulls int, terms binary, sizes binary, docs binary, slices binary"


def parted(text: str | None, size: int = READ) -> list[str]:
    """The text in parts of about size characters, cut between terms."""
    text, out, at = text or "", [], 0
    while len(text) - at > size and (found := _PARTING.search(text, at + size)):
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the text each is in."""
    parts = [(i, p) for i, t in enumerate(texts) for p in parted(t)]
    with np.errstate(over="ignore"):
        words = Words([p for _, p in parts], marks=False)
    return words.hash, np.array([i for i, _ in parts], np.int64)[words.text] if parts else np.empty(0, np.int64)


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and all their terms."""
    n = F.regexp_count("text", F.lit(TERM))
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return int(found[0]), int(found[1] or 0)


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits (last axis) as words of 64."""
    short = -bits.shape[-1] % 64
    if short:
        bits = np.concatenate((bits, np.zeros((*bits.shape[:-1], short), bits.dtype)), axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def block_row(doc_ids: list[int | None], hashes: np.ndarray, places: np.ndarray, documents: int, terms: int) -> dict:
    """One block of the index from its documents' term hashes."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0))
    rank = np.empty(len(doc_ids), np.int64)
    rank[order] = np.arange(len(doc_ids))
    length = np.bincount(places, minlength=len(doc_ids)).astype(np.int64)
    by = np.argsort(hashes)
    ordered = hashes[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    key = ((np.cumsum(new) - 1) << 16) | rank[places[by]]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(first, len(key)))
    term, doc = key[first] >> 16, key[first] & 0xFFFF
    m = 100 - LENGTH + LENGTH * length[order] * documents // max(terms, 1)
    impact = SCALE * tf // (1000 * tf + SATURATION * m[doc])
    deep = int(impact.max()).bit_length() if len(impact) else 0
    slices = np.stack([np.packbits((impact >> s & 1).astype(np.uint8), bitorder="little") for s in range(deep)]) if deep else np.empty(0, np.uint8)
    ids = [doc_ids[i] for i in order]
    return {
        "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "nulls": sum(i is None for i in ids), "terms": ordered[new].tobytes(), "sizes": np.bincount(term, minlength=int(new.sum())).astype("<u2").tobytes(),
        "docs": doc.astype("<u2").tobytes(), "slices": slices.tobytes(),
    }


def build(docs: DataFrame, path: str, block_size: int = BLOCK) -> None:
    """Write the index of all docs (doc_id, text) under path: `blocks`, of block_size documents (65,536) at most, and `totals` in one row."""
    spark = docs.sparkSession
    documents, terms = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, places, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = block_row(ids, np.concatenate(found), np.concatenate(places), documents, terms)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == "nulls" else pa.binary()) for k, v in row.items()], names=list(row))

        for batch in batches:
            for part in pieces(batch, "text", READ):
                step = max(1, block_size // 4)
                for a in range(0, part.num_rows, step):
                    some = part.slice(a, step)
                    if ids and (len(ids) + some.num_rows > block_size or size >= TEXT):
                        yield block()
                        ids, found, places, size = [], [], [], 0
                    texts = some.column("text").to_pylist()
                    hashes, place = hashed(texts)
                    found.append(hashes)
                    places.append(place + len(ids))
                    ids += some.column("doc_id").to_pylist()
                    size += sum(len(t or "") for t in texts)
        if ids:
            yield block()

    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(documents, terms)], "documents bigint, terms bigint").coalesce(1).write.parquet(f"{path}/totals")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def frequencies(blocks: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each term of a sorted list; only terms and their sizes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, sizes in zip(b.column(0), b.column(1), strict=True):
                own = np.frombuffer(terms.as_buffer(), np.uint64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    sums += np.where(own[at] == wanted, np.frombuffer(sizes.as_buffer(), "<u2")[at], 0)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], names=["at", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in blocks.select("terms", "sizes").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a term of the pass
        out[r["at"]] = r["n"]
    return out


def multiplied(slices: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices of impact times weight, from slices over postings and each posting's weight."""
    out: list[np.ndarray] = []
    for j in range(int(weights.max()).bit_length()):
        mask = packed((weights >> j & 1).astype(np.uint8))
        carry = None
        for s, own in enumerate(slices):
            x, at = own & mask, j + s
            if at == len(out):
                out.append(np.zeros_like(mask))
            half = out[at] ^ x
            over = out[at] & x
            if carry is None:
                out[at], carry = half, over
            else:
                out[at], carry = half ^ carry, over | (half & carry)
        at = j + len(slices)
        while carry is not None and carry.any():
            if at == len(out):
                out.append(np.zeros_like(mask))
            out[at], carry, at = out[at] ^ carry, out[at] & carry, at + 1
    return out


class Rounds:
    """Terms of a part's items that a block holds, in chunks of TERMS; in a chunk, rounds with at most one term an item."""

    def __init__(self, items: list[np.ndarray], present: np.ndarray):
        pairs = np.array([(t, i) for i, own in enumerate(items) for t in own[present[own] >= 0].tolist()], np.int64).reshape(-1, 2)
        self.terms = np.unique(pairs[:, 0])
        local = np.searchsorted(self.terms, pairs[:, 0])
        self.chunks = []
        for low in range(0, len(self.terms), TERMS):
            mine = (local >= low) & (local < low + TERMS)
            term, item = local[mine] - low, pairs[mine, 1]
            order = np.argsort(item, kind="stable")
            term, item = term[order], item[order]
            turn = np.arange(len(item)) - np.searchsorted(item, item)
            self.chunks.append((low, [(item[turn == r], term[turn == r]) for r in range(int(turn.max()) + 1)]))


def added(counters: list[np.ndarray], items: np.ndarray, bits: np.ndarray) -> None:
    """Add one bit to the vertical counters of the items."""
    k = 0
    while bits.any():
        if k == len(counters):
            counters.append(np.zeros_like(counters[0]))
        held = counters[k][items]
        counters[k][items] = held ^ bits
        bits = held & bits
        k += 1


def best(slices: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of each item's k documents of highest score above 0, ties to smaller places."""
    open_ = np.bitwise_or.reduce(slices)
    taken = np.zeros_like(open_)
    for own in reversed(slices):
        both = taken | (open_ & own)
        many = (np.bitwise_count(both).sum(axis=1, dtype=np.int64) > k)[:, None]
        taken = np.where(many, taken, both)
        open_ &= np.where(many, own, ~own)
    out = []
    for i in range(len(taken)):
        sure, tied = (np.flatnonzero(np.unpackbits(x[i].view(np.uint8), bitorder="little")) for x in (taken, open_))
        places = np.concatenate((sure, tied[: k - len(sure)]))
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        scores = sum(((s[i][word] >> bit & np.uint64(1)).astype(np.int64) << n for n, s in enumerate(slices)), np.zeros(len(places), np.int64))
        out.append((places, scores))
    return out


def search_block(row: dict, items: list[np.ndarray], wanted: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best places of a block for each item; items: places in wanted, the sorted term hashes."""
    own, sizes = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["sizes"], "<u2").astype(np.int64)
    docs = np.frombuffer(row["docs"], "<u2")
    none = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
    if not len(docs) or not len(wanted):
        return none
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    present = np.where((own[at] == wanted) & (weights > 0), at, -1)
    rounds = Rounds(items, present)
    if not len(rounds.terms):
        return none
    wide = -(-len(row["doc_ids"]) // 8 // 64)
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(row["slices"], np.uint8).reshape(-1, -(-len(docs) // 8))
    prepared = []
    for low, turns in rounds.chunks:
        terms = rounds.terms[low : low + TERMS]
        n = sizes[present[terms]]
        postings = np.repeat(begin[present[terms]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        byte, bit = postings >> 3, (postings & 7).astype(np.uint8)
        mine = multiplied([packed(s[byte] >> bit & 1) for s in raw], np.repeat(weights[terms], n))
        place = docs[postings].astype(np.int64)
        word = np.repeat(np.arange(len(terms)) * wide, n) + (place >> 6)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        prepared.append((mine, np.uint64(1) << (place & 63).astype(np.uint64), starts, word[starts], len(terms), turns))
    deep = max(len(p[0]) for p in prepared)
    counters, result = [np.zeros((len(items), wide), np.uint64)], []
    s = 0
    while s < deep or any(c.any() for c in counters):
        for mine, mask, starts, word, many, turns in prepared:
            if s >= len(mine):
                continue
            bits = np.unpackbits(mine[s].view(np.uint8), bitorder="little")[: len(mask)]
            dense = np.zeros(many * wide, np.uint64)
            dense[word] = np.bitwise_or.reduceat(mask * bits, starts)
            dense = dense.reshape(many, wide)
            for item, term in turns:
                added(counters, item, dense[term])
        result.append(counters[0])
        counters = counters[1:] or [np.zeros_like(result[0])]
        s += 1
    return best(result, k) if result else none


def parts(items: list[tuple[int | None, np.ndarray]]) -> list[tuple[int, list[np.ndarray]]]:
    """Items' term places, PART at a time, with the number of the first."""
    return [(i, [t for _, t in items[i : i + PART]]) for i in range(0, len(items), PART)]


def searched(blocks: DataFrame, items: list[tuple[int | None, str]], documents: int, k: int) -> DataFrame:
    """item_id, item (its number in the pass), doc_id and score of each block's k best."""
    hashes, place = hashed([t for _, t in items])
    wanted, number = np.unique(hashes, return_inverse=True)
    asked = [(i, np.unique(number[place == n])) for n, (i, _) in enumerate(items)]
    holding = frequencies(blocks, wanted)
    weights = np.array([weight(documents, h) if h else 0 for h in holding.tolist()], np.int64)
    shared = blocks.sparkSession.sparkContext.broadcast((asked, wanted, weights))  # the terms of one pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted, weights = shared.value
        split = parts(asked)
        for b in batches:
            for at in range(b.num_rows):
                row = {n: c[at].as_py() if n == "nulls" else memoryview(c[at].as_buffer()) for n, c in zip(b.schema.names, b.columns, strict=True)}
                ids = np.frombuffer(row["doc_ids"], "<i8")
                out: list[tuple] = []
                for first, own in split:
                    for i, (places, scores) in enumerate(search_block(row, own, wanted, weights, k)):
                        out += [(asked[first + i][0], first + i, None if p < row["nulls"] else int(ids[p]), s) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, names=["item_id", "item", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id bigint, item bigint, doc_id bigint, score bigint")


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item (item_id, text), from the index at path."""
    blocks, documents = spark.read.schema(_SCHEMA).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/totals").first()["documents"]
    out = None
    for found in passes(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")):
        hits = cut(searched(blocks, found, documents, k), "hits")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_size: int = BLOCK) -> DataFrame:
    """Index docs, search for all items, delete the index."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/bidsmith/impacts-{uuid.uuid4().hex}"
    build(docs, path, block_size)
    out = search(spark, path, items, k)
    discard(path)
    return out
