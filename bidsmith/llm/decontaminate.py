"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window has as many words as some benchmark item. Its fingerprint (BITS bits) sums the
bits of its five-word shingles. The index cuts fingerprints into BLOCKS; two fingerprints
within RADIUS bits differ in at most RADIUS // BLOCKS bits in some block, so the items listed
under every block value within that many bits are all items within the radius. Candidates
are confirmed by the weighted Jaccard similarity of the two multisets of shingles (weight: how
often a shingle occurs), at least `similarity`.

Windows of which too few shingles occur in the benchmark at all cannot reach the similarity,
whatever the item; they get no fingerprint. Every start position of every item size is considered; a text with
fewer shingles than an item is one window.

Words are lower-cased (all letters) runs without ASCII punctuation. The benchmark comes to the driver and goes to the
executors PASS items at a time, a bound whatever its size: a worker holds their indexes (ITEMS items each; about 6,000
entries, 25 kB, an item). A larger benchmark takes more passes, each written to the shared folder.

Defined results: null, empty and wordless texts, and items without words, match nothing; an item or
text of fewer than five words is one shingle; an empty table of documents or items gives no leaks; repeated rows match
alike, and repeated items once; of windows that are equally similar to an item the one of nearest fingerprint, then the
first, is reported; null ids are kept; very long texts are searched whole, 20,000 windows at a time; columns of the
documents keep their names and values, and the column of leaks gets a name that no other has.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import annotate, cut, free_name, small_batches
from bidsmith.llm.text import Words

BITS, BLOCKS, RADIUS, ITEMS, PASS, WIDTH = 128, 8, 31, 1000, 4000, 5
_MASKS = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS // BLOCKS), r)], np.uint16)
LEAKS = "array<struct<item_id: bigint, similarity: double, start: bigint, n_words: bigint>>"


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    with np.errstate(over="ignore"):
        other = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        other ^= other >> np.uint64(30)
    bits = np.unpackbits(np.stack([shingles, other], axis=1).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as BLOCKS 16-bit values; a tied bit is 0."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Index:
    """The items of a benchmark slice, ready for search."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        with np.errstate(over="ignore"):
            words = Words([t and t.lower() for _, t in items], marks=False)
            shingles, begin = words.windows(WIDTH)
        self.items = [(i, shingles[a:b], int(n)) for (i, _), a, b, n in zip(items, begin[:-1], begin[1:], words.count, strict=True) if b > a]
        self.counts = [Counter(s.tolist()) for _, s, _ in self.items]
        self.known = np.unique(shingles)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        self.lengths = sorted({n for *_, n in self.items})
        self.prints = packed(np.array([signs(s).sum(axis=0, dtype=np.int32) for _, s, _ in self.items]).reshape(-1, BITS))
        self.lists = []
        for block in range(BLOCKS):
            values = (self.prints[:, block, None] ^ _MASKS[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.lists.append((np.searchsorted(values[order], np.arange((1 << 16) + 1)), (order // len(_MASKS)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of all items within RADIUS of each fingerprint."""
        found = []
        for block, (begin, listed) in enumerate(self.lists):
            a, b = begin[prints[:, block]], begin[prints[:, block].astype(np.int64) + 1]
            n = b - a
            rows = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            items = listed[at]
            gap = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(axis=1).astype(np.int64)
            ok = gap <= RADIUS
            found.append(np.stack([rows[ok], items[ok], gap[ok]]))
        out = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((3, 0), np.int64)
        return out[0], out[1], out[2]


def leaks(texts: list[str | None], index: Index, similarity: float) -> list[list[dict]]:
    """For each text, the items that some window of it resembles: the best window of each."""
    out: list[list[dict]] = [[] for _ in texts]
    if not index.items:
        return out
    with np.errstate(over="ignore"):
        words = Words([t and t.lower() for t in texts], marks=False)
        shingles, begin = words.windows(WIDTH)
    hit = index.maybe[shingles & np.uint64((1 << 20) - 1)]
    spots = np.flatnonzero(hit)
    hit[spots] = np.isin(shingles[spots], index.known)
    spots = spots[hit[spots]]
    if not len(spots):
        return out
    for i in np.unique(np.searchsorted(begin, spots, side="right") - 1):
        own = shingles[begin[i] : begin[i + 1]]
        seen = np.concatenate(([0], np.cumsum(hit[begin[i] : begin[i + 1]])))
        starts, widths, sizes, short = [], [], [], False
        for n in index.lengths:
            wide = max(1, n - WIDTH + 1)
            if words.count[i] < min(n, WIDTH):
                continue
            if len(own) < wide:  # the whole text, once, if it can be alike enough to an item of this size
                s = np.zeros(int(not short and seen[-1] >= similarity * wide), np.int64)
                short, wide, n = short or len(s) > 0, len(own), int(words.count[i])
            else:
                s = np.flatnonzero(seen[wide:] - seen[:-wide] >= similarity * wide)
            starts.append(s)
            widths.append(np.full(len(s), wide))
            sizes.append(np.full(len(s), n))
        if not starts or not sum(map(len, starts)):
            continue
        starts, widths, sizes = map(np.concatenate, (starts, widths, sizes))
        best: dict[int, tuple[float, int, int]] = {}
        for part in range(0, len(starts), 20_000):
            s, w, z = starts[part : part + 20_000], widths[part : part + 20_000], sizes[part : part + 20_000]
            low, high = s.min(), (s + w).max()
            sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(own[low:high]), axis=0, dtype=np.int32)))
            rows, items, gaps = index.near(packed(sums[s + w - low] - sums[s - low]))
            for k in np.argsort(gaps, kind="stable"):
                r, item = rows[k], int(items[k])
                if best.get(item, (0,))[0] == 1.0:
                    continue
                theirs, ours = index.counts[item], Counter(own[s[r] : s[r] + w[r]].tolist())
                both = sum(min(c, theirs[x]) for x, c in ours.items() if x in theirs)
                alike = both / (ours.total() + theirs.total() - both)
                if alike >= similarity and alike > best.get(item, (0,))[0]:
                    best[item] = (alike, int(s[r]), int(z[r]))
        out[i] = [{"item_id": index.items[k][0], "similarity": v[0], "start": v[1], "n_words": v[2]} for k, v in sorted(best.items())]
    return out


def passes(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The different items with a text, in order, PASS at a time; the driver holds no more than that."""
    rows, last = benchmark.select("item_id", "text").where("text is not null").distinct(), None
    while True:
        left = rows
        if last:
            same, i = F.col("item_id").eqNullSafe(F.lit(last[0])), F.col("item_id")
            left = rows.where((same & (F.col("text") > last[1])) | (i.isNotNull() if last[0] is None else i > last[0]))
        found = [(r["item_id"], r["text"]) for r in left.orderBy(F.col("item_id").asc_nulls_first(), "text").limit(PASS).collect()]
        if found or last is None:
            yield found
        if len(found) < PASS:
            return
        last = found[-1]


_MADE: dict[str, list[Index]] = {}


def _made(key: str, items: list) -> list[Index]:
    """The indexes of a pass, made once a worker; those of another pass go."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = [Index(items[i : i + ITEMS]) for i in range(0, len(items), ITEMS)]
    return _MADE[key]


def with_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, keep: list[str] | None = None, name: str = "leaks") -> DataFrame:
    """docs with an array column: item_id, similarity, first word and length of each leaked item's best window."""
    small_batches(docs.sparkSession)
    out, own = docs, [c for c in docs.columns if (keep is None or c in keep) and c.lower() != name.lower()]
    for number, items in enumerate(passes(benchmark)):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # at most PASS items

        def score(texts, _, shared=shared, key=key):
            found = [leaks(texts, index, similarity) for index in _made(key, shared.value)]
            return {name if not number else more: [sum(x, []) for x in zip(*found, strict=True)] if found else [[] for _ in texts]}  # noqa: B023

        if not number:
            kept = keep if keep is None else [*dict.fromkeys([*own, "text"])]
            out = annotate(docs, score, f"`{name}` {LEAKS}", kept)
        else:
            more = free_name(out, "more")
            out = annotate(cut(out, "leaks"), score, f"`{more}` {LEAKS}").withColumn(name, F.concat(name, more)).drop(more)
    return out.select(*own, name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without the documents in which a benchmark item leaks, columns unchanged."""
    name = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, similarity, name=name).where(F.size(name) == 0).select(*docs.columns)


def leak_pairs(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row for each document and item that leaks into it."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, similarity, ["doc_id"])
    return found.select("doc_id", F.inline("leaks"))
