"""Token ids to files and back: tokenize, count globally, Huffman-code in document order, decode.

Files: `<path>/code` has one row, the code length of each id; `<path>/blocks` has rows (file, seq,
first, tokens, block): each file covers a range of doc_id, its blocks follow each other, `first`
is the number of ids before the block in its file. Blocks are independent (see `huffman`); one
closes at the first document end after BLOCK ids. Spark's own writer commits them, so a task that runs
twice leaves one copy, and any store that Spark writes to will do.

Tokenizing goes by pieces that a byte-level pre-tokenizer never joins: texts are cut at spaces, and at
line breaks before a non-space; full stops and commas after a letter or digit are pieces of their own.
The library encodes each distinct piece once while a worker's bounded memo holds it, many in a row. A text
with a space before white space or at its end is encoded whole, and so is every text where the file's
pre-tokenizer is another one (see `cuttable`).

Defined results: null counts as the empty text; every text gets the end id; an empty table gives files without blocks and no rows;
rows with a null doc_id come first; repeated rows are documents of their own, rows of one doc_id being ordered by length and
checksum; a very long text is a block of its own; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidsmith.llm.common import cut, discard, partitions, pieces, shared_dir, small_batches
from bidsmith.llm.huffman import Code, lengths

BLOCK, MEMO, CHUNK = 50_000, 350_000, 5_000_000
#: White space of the pre-tokenizer, for a character class.
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\pZ"
#: Texts that are encoded whole: a space before white space or at the end, or white space before what may be a special token.
_WHOLE = rf" ([{_BLANK}]|$)|[{_BLANK}]<\|"
_BREAK = rf"\n([^{_BLANK}])"
#: What full stops and commas can be cut from: a letter or digit that all Unicode versions agree on.
_LETTER = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]$"
_TAIL = ".,"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def cuttable(path: str) -> bool:
    """Whether texts can be cut into pieces: byte-level pairs, no normalizer, special tokens that start with <|."""
    own = tokenizer(path)
    before = json.loads(own.pre_tokenizer.__getstate__()) if own.pre_tokenizer else {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback")
    whole = type(own.model).__name__ == "BPE" and not any(getattr(own.model, x) for x in odd)
    special = all(t.content.startswith("<|") and not re.search(r"\s", t.content) and not (t.lstrip or t.rstrip or t.single_word) for t in own.get_added_tokens_decoder().values())
    return bool(plain and whole and special and own.normalizer is None and own.truncation is None and own.padding is None)


class Memo:
    """Ids of the pieces that a worker has met, in one array; at MEMO pieces, those met in one batch only
    are dropped, and beyond half of MEMO those met least lately."""

    def __init__(self, path: str):
        self.path, self.own = path, tokenizer(path)
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.wide = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: one a character of its name
        self.wide[list(vocabulary.values())] = list(map(len, vocabulary))
        self.now = 0
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.size, self.met, self.last = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.place)
        while n + len(words) > len(self.begin):
            self.begin, self.size, self.met, self.last = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.size, self.met, self.last))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.begin[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def shrink(self) -> None:
        often = np.flatnonzero(self.met[: len(self.place)] > 1)
        if 2 * len(often) > MEMO:
            often = np.sort(often[np.argsort(-self.last[often], kind="stable")[: MEMO // 2]])
        words, begin, size, last, flat = list(self.place), self.begin[often], self.size[often], self.last[often], self.flat
        self.clear()
        self._keep([words[i] for i in often.tolist()], size, gathered(flat, begin, size))
        self.met[: len(often)], self.last[: len(often)] = 1, last

    def add(self, words: list[str]) -> None:
        """Encode pieces that aren't held. Those that start with white space and a non-space can be encoded in a
        row, as none is joined with what stands before it; bytes tell which ids are whose."""
        row = [w for w in words if len(w) > 1 and w[0] in " \n" and not w[1].isspace() and self.plain(w)]
        for i in range(0, len(row), 500):
            part = row[i : i + 500]
            ids = np.array(self.own.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(part, pa.large_string())).to_numpy())
            cuts = np.searchsorted(np.cumsum(self.wide[ids]), ends) + 1
            self._keep(part, np.diff(cuts, prepend=0), ids)
        rest = [w for w in words if w not in self.place] if len(row) < len(words) else []
        if rest:
            found = [e.ids for e in self.own.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.array(list(map(len, found)), np.int64), np.array([i for x in found for i in x], np.uint32))

    @staticmethod
    def plain(word: str) -> bool:
        """No special token's string may be in a row of words."""
        return "<|" not in word

    def get(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` each piece's ids begin, and how many there are. The pieces differ."""
        if len(self.place) > MEMO:
            self.shrink()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self.add(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        self.now += 1
        self.met[at] += 1
        self.last[at] = self.now
        return self.begin[at], self.size[at]


@cache
def memo(path: str) -> Memo:
    return Memo(path)


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after another."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return flat[at]


def tokenize(texts: pa.Array, path: str, end_id: int | None) -> list[np.ndarray]:
    """Token ids of each text, with end_id (if any) after them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return []
    closing = [] if end_id is None else [end_id]
    if not cuttable(path):
        return [np.array([*e.ids, *closing], np.uint32) for e in tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
    cut_up = pc.replace_substring_regex(pc.if_else(pa.array(whole), "", texts), _BREAK, " \n\\1")
    lists = pc.split_pattern(cut_up, " ")
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    number, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    first = np.cumsum(count) - count
    number[first] += len(names)  # no space stands before these
    used = np.flatnonzero(np.bincount(number, minlength=2 * len(names)))
    own = names.take(pa.array(used % len(names)))
    spaced = pc.and_(pa.array(used < len(names)), pc.invert(pc.starts_with(own, "\n")))
    stem = pc.utf8_rtrim(own, _TAIL)
    stem = pc.if_else(pc.match_substring_regex(stem, _LETTER), stem, own)
    lost = np.flatnonzero(pc.less(pc.binary_length(stem), pc.binary_length(own)).to_numpy(zero_copy_only=False))
    tails = [w[len(w.rstrip(_TAIL)) :] for w in own.take(pa.array(lost)).to_pylist()]
    stem = pc.binary_join_element_wise(pc.if_else(spaced, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())), stem, pa.scalar("", pa.large_string())).dictionary_encode()
    kinds = sorted(set(tails))
    held = memo(path)
    begin, size = held.get(stem.dictionary.to_pylist())
    at = stem.indices.to_numpy(zero_copy_only=False)
    ids = [held.flat]
    begin, size = begin[at], size[at]
    # ids of this batch's pieces in a row of their own: of each the stem's, then the tail's
    part_begin, part_size = np.zeros((2, len(used), 2), np.int64)
    part_begin[:, 0], part_size[:, 0] = begin, size
    if kinds:
        ends = {k: e.ids for k, e in zip(kinds, held.own.encode_batch_fast(kinds, add_special_tokens=False), strict=True)}
        ids.append(np.array([i for k in kinds for i in ends[k]], np.uint32))
        starts = dict(zip(kinds, np.cumsum([0, *(len(ends[k]) for k in kinds)])[:-1] + len(held.flat), strict=True))
        part_begin[lost, 1], part_size[lost, 1] = [starts[t] for t in tails], [len(ends[t]) for t in tails]
    flat = gathered(np.concatenate(ids) if kinds else held.flat, part_begin.ravel(), part_size.ravel())
    offsets = np.concatenate(([0], np.cumsum(part_size.sum(axis=1))))
    place = np.zeros(2 * len(names), np.int32)
    place[used] = np.arange(len(used))
    row = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))
    taken = row.take(pa.array(place[number]))
    all_ids, edges = taken.flatten().to_numpy(), taken.offsets.to_numpy()
    out = [np.append(all_ids[a:b], closing).astype(np.uint32) for a, b in zip(edges[first].tolist(), edges[first + count].tolist(), strict=True)]
    for i in np.flatnonzero(whole):
        out[i] = np.array([*held.own.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, *closing], np.uint32)
    return out


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK bytes: the more text, the more often a piece occurs in it."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, "text", CHUNK):
            held.append(part)
            size += part.column("text").nbytes
            if size >= CHUNK:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


#: Documents (n_tokens at least 0), and one row a task with the counts of its ids (n_tokens -1).
_ROWS = "doc_id bigint, n_tokens bigint, ids binary, used binary, counts binary"


def token_ids(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, n_tokens and `ids`, pressed for the way to the next task; and each task's counts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "ids", "used", "counts"]
        for part in joined(batches):
            ids = tokenize(part.column("text"), path, end_id)
            more = np.bincount(np.concatenate(ids), minlength=len(total))
            more[: len(total)] += total
            total = more
            none = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array([pressed(x) for x in ids], pa.binary()), none, none], names=names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([used.astype("<i8").tobytes()], pa.binary()), pa.array([total[used].astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _ROWS)


@cache
def _press() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pressed(ids: np.ndarray) -> bytes:
    """Ids for the way between tasks: bytes in planes, pressed."""
    return _press()[0].compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 2 if not len(ids) or ids.max() < 65536 else 4].tobytes())


def unpressed(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(_press()[1].decompress(data), np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if n:
        planes = raw.reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u4").ravel()


def counted(rows: DataFrame) -> np.ndarray:
    """How often each id occurs: the sums of the tasks' counts; one row an id comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for used, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(used, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], names=["id", "count"])

    found = rows.where("n_tokens < 0").select("used", "counts").mapInArrow(run, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    out[found["id"]] = found["count"]
    return out


def write(rows: DataFrame, path: str) -> None:
    """Write the ids of `token_ids` rows as files in ascending doc_id order."""
    spark = rows.sparkSession
    size = lengths(counted(rows))
    spark.createDataFrame([(bytearray(size.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    made = size.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, file = Code(np.frombuffer(made, np.uint8)), TaskContext.get().partitionId()
        held: list = []
        seq = first = n = 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([code.pack(held)], pa.binary())], names=["file", "seq", "first", "tokens", "block"])

        for b in batches:
            for doc, k, data in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held.append((doc, unpressed(data, k)))
                n += k
                if n >= BLOCK:
                    yield block()
                    held, seq, first, n = [], seq + 1, first + n, 0
        if held:
            yield block()

    dealt = rows.where("n_tokens >= 0").select("doc_id", "n_tokens", "ids").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", F.crc32("ids"))
    dealt.mapInArrow(run, "file bigint, seq bigint, first bigint, tokens bigint, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and `ids` (or ids_crc32, of little-endian 32-bit ids) from files, each block by itself."""
    size = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    blocks = spark.read.schema("file bigint, seq bigint, first bigint, tokens bigint, block binary").parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("tokens").alias("n"))  # a row a file: as many as shuffle partitions
    before = files.select(F.col("file"), F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(size, np.uint8))
        for b in batches:
            for at in range(0, b.num_rows, 16):
                part = b.slice(at, 16)
                doc, start, n, last = [], [], [], []
                for found, first in zip(code.unpack(part.column("block").to_pylist()), part.column("start").to_pylist(), strict=True):
                    for i, ids in found:
                        doc.append(i)
                        start.append(first)
                        n.append(len(ids))
                        last.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids)
                        first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    placed = blocks.join(F.broadcast(before), "file").select((F.col("first") + F.col("before")).alias("start"), "block")
    return placed.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids array<int>'}")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Tokenize, write to the shared folder, and read digests back."""
    spark = docs.sparkSession
    rows = cut(token_ids(docs, path, end_id), "token-ids")
    to = f"{shared_dir(spark)}/bidsmith/token-files-{uuid.uuid4().hex}"
    small_batches(spark, 64)
    write(rows, to)
    discard(rows)
    return read(spark, to, digest=True)
