"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Symbols: every training word of at least `least_count` occurrences, N ** (2/3) / GROWTH of N training
tokens, so the vocabulary grows with the corpus and yet has at most GROWTH * N ** (1/3) words; the end;
and BUCKETS symbols for all other words, by their last two characters. Symbols are numbered by falling
frequency, and each stretch of about their square root is a class. In a context of two symbols,

    q = E1[second last] + E2[last],  P(symbol) = P(class | q) * P(symbol | class, q),

both log-bilinear (q . R + b) and normalised exactly by batched matrix products over the classes, then over the
members of the symbol's class. A word of a bucket gets its bucket's probability times its share, (c + 1) / (n + v + 1),
over the n occurrences of the bucket's v training words and one unseen: so probabilities sum to 1.

Training starts at the unigram model and makes one pass over all training texts, in ROUNDS parts (by a hash of
doc_id): tasks take noise-contrastive gradient steps on their own texts, in order, and the changes of each row
of the parameters are averaged by how often tasks met it, summed in the order of tasks. So the same files and settings
give the same scores, however often a task runs.

Scoring needs the count of every word of every text, and the table of counts grows with the
corpus. Texts are coded in chunks of about CHUNK bytes: a chunk lists its distinct words once, so the
join with the counts has a row a chunk and word, not a row a token. No word's rows exceed one a chunk.

Words: see `common.words_of`; each text ends in one further token. Defined results: null and empty
texts have the end token only; rows with a null doc_id are in fold 0, so they train; without
training rows counts are 0 and all symbols are equally likely; an empty table gives no rows; repeated rows
count each time and score alike; words of equal counts are ordered by their bytes; very long texts are a chunk of
their own, coded and scored whole; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import cut, fold, fold_of, pieces, small_batches

SIZE, CHUNK, ROUNDS, BUCKETS, GROWTH, BLOCK = 16, 5_000_000, 2, 256, 256, 256
BATCH, CLASS_NOISE, WORD_NOISE, RATE = 2048, 32, 1, 0.1
_SPACE = r"[\x20\x09-\x0D]+"


def split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words a text, and all words, coded."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.ascii_trim(pc.ascii_lower(texts), "\x20\t\n\x0b\x0c\r")
    lists = pc.split_pattern_regex(texts, _SPACE)
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    count[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
    return count, words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()


def trains(ids: list, modulus: int, held: int) -> np.ndarray:
    return np.fromiter((fold_of(i, modulus) != held for i in ids), bool, len(ids))


#: Rows of words (word, n: how often in training rows) and one row a chunk (docs, counts, codes).
_CODED = "chunk bigint, number int, word string, n bigint, docs array<bigint>, counts array<int>, codes binary"


def coded(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """The texts in chunks. The end is the word ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        seq, held_back, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, texts = table.column("doc_id").to_pylist(), table.column("text").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            count, words = split(texts)
            number, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.string())
            own = trains(ids, modulus, held)
            n = np.bincount(number[np.repeat(own, count)], minlength=len(names))
            width = "<u2" if len(names) < 65536 else "<u4"
            codes = zstandard.ZstdCompressor(level=1).compress(number.astype(width).view(np.uint8).reshape(-1, int(width[-1])).T.tobytes())
            k = len(names)
            none = lambda kind, m: pa.nulls(m, kind)
            arrays = [
                pa.array(np.full(k + 2, seq)),
                pa.array([*range(k), k, -1], pa.int32()),
                pa.concat_arrays([names, pa.array(["", None])]),
                pa.array([*n.tolist(), int(own.sum()), None], pa.int64()),
                pa.concat_arrays([none(pa.list_(pa.int64()), k + 1), pa.array([ids], pa.list_(pa.int64()))]),
                pa.concat_arrays([none(pa.list_(pa.int32()), k + 1), pa.array([count.tolist()], pa.list_(pa.int32()))]),
                pa.concat_arrays([none(pa.binary(), k + 1), pa.array([codes])]),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "number", "word", "n", "docs", "counts", "codes"])

        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                held_back.append(part)
                size += part.column("text").nbytes
                if size >= CHUNK:
                    yield chunk(held_back)
                    held_back, size, seq = [], 0, seq + 1
        if held_back:
            yield chunk(held_back)

    return docs.mapInArrow(run, _CODED)


def _placed(words: np.ndarray, end: float, inside: np.ndarray) -> np.ndarray:
    """A figure of each token: the words' in order, and the ends'."""
    out = np.full(len(inside), end, words.dtype)
    out[inside] = words
    return out


def least_count(tokens: int) -> int:
    """How often a word must occur to be a symbol of its own."""
    return max(2, math.ceil(tokens ** (2 / 3) / GROWTH))


def bucket(word: Column) -> Column:
    """The bucket of a word that is no symbol of its own; `buckets` gives the same."""
    return F.pmod(F.crc32(F.substring(word, -2, 2).cast("binary")), F.lit(BUCKETS)).cast("int")


def buckets(words: pa.Array) -> np.ndarray:
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    own = np.array([zlib.crc32(x.encode()) % BUCKETS for x in ends.dictionary.to_pylist()], np.int64)
    return own[ends.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64)


class Symbols:
    """Numbers of words, buckets and the end, by falling weight; START, for contexts only, is the last."""

    def __init__(self, words: list[str], counts: list[int], rest: np.ndarray, ends: int):
        weight = np.concatenate((np.array(counts, np.float64).reshape(-1), rest + 1.0, [max(ends, 1)]))
        order = np.argsort(-weight, kind="stable")
        number = np.empty(len(weight), np.int64)
        number[order] = np.arange(len(weight))
        self.words, self.weight, n = words, weight[order], len(words)
        self.of_word, self.of_bucket, self.end, self.start = number[:n], number[n:-1], int(number[-1]), len(weight)
        self.width = math.isqrt(len(weight) - 1) + 1
        self.classes = -(-len(weight) // self.width)

    def code(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word."""
        at = pc.index_in(words, pa.array(self.words, words.type)) if self.words else pa.nulls(len(words), pa.int32())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        out = self.of_bucket[buckets(words)]
        out[known] = self.of_word[at.drop_null().to_numpy()] if self.words else 0
        return out


def contexts(now: np.ndarray, count: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, symbol) of every token, ends included. now: the words' symbols; count: words a text."""
    ends = np.cumsum(count + 1) - 1
    all_now = np.full(len(now) + len(count), symbols.end, np.int64)
    inside = np.ones(len(all_now), bool)
    inside[ends] = False
    all_now[inside] = now
    first = ends - count
    last = np.concatenate(([symbols.start], all_now[:-1]))
    last[first] = symbols.start
    before = np.concatenate(([symbols.start], last[:-1]))
    before[first] = symbols.start
    return before, last, all_now


class Parameters:
    """A row a symbol (START too), then one a class: E1, E2, R and b side by side; classes have R and b only."""

    def __init__(self, symbols: Symbols, rows: np.ndarray | None = None, seed: int = 11):
        m, c = symbols.start, symbols.classes
        weight = np.zeros(c * symbols.width)
        weight[:m] = symbols.weight
        self.of_class = weight.reshape(c, -1).sum(axis=1)
        self.share = symbols.weight / np.repeat(self.of_class, symbols.width)[:m]
        self.class_share = self.of_class / self.of_class.sum()
        if rows is None:
            rows = np.random.default_rng(seed).normal(0, 0.1, (m + 1 + c, 3 * SIZE + 1)).astype(np.float32)
            rows[:m, -1], rows[m, -1], rows[m + 1 :, -1] = np.log(self.share), 0, np.log(self.class_share)
            rows[:, 2 * SIZE : 3 * SIZE] = 0
        self.symbols, self.rows = symbols, rows
        self.e1, self.e2, self.r, self.b = rows[: m + 1, :SIZE], rows[: m + 1, SIZE : 2 * SIZE], rows[:m, 2 * SIZE : 3 * SIZE], rows[:m, -1]
        self.rc, self.bc = rows[m + 1 :, 2 * SIZE : 3 * SIZE], rows[m + 1 :, -1]

    def log_probability(self, before: np.ndarray, last: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each symbol in its context."""
        out, width = np.empty(len(now)), self.symbols.width
        for a in range(0, len(now), 100_000):
            w = now[a : a + 100_000]
            q = self.e1[before[a : a + 100_000]] + self.e2[last[a : a + 100_000]]
            own = w // width
            log = np.empty(len(w), np.float32)
            for k in range(0, len(w), 20_000):
                part = slice(k, k + 20_000)
                log[part] = _picked(q[part] @ self.rc.T + self.bc, own[part])
            order = _order(own)
            edges = np.searchsorted(own[order], np.arange(self.symbols.classes + 1))
            for c in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[c] : edges[c + 1]]
                members = slice(c * width, min((c + 1) * width, self.symbols.start))
                for k in range(0, len(at), 20_000):
                    some = at[k : k + 20_000]
                    log[some] += _picked(q[some] @ self.r[members].T + self.b[members], w[some] - c * width)
            out[a : a + 100_000] = log
        return out


def _picked(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each row's score of its own column, minus the log of the row's summed exponentials."""
    if not -60 < scores.min() <= scores.max() < 60:  # else exponentials can't overflow
        scores -= scores.max(axis=1, keepdims=True)
    got = scores[np.arange(len(own)), own]
    np.exp(scores, out=scores)
    return got - np.log(scores.sum(axis=1))


def _order(at: np.ndarray) -> np.ndarray:
    """A stable order; numbers under 65,536 are sorted by radix."""
    return np.argsort(at.astype(np.uint16) if len(at) and at.max() < 65536 else at, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive gradient steps (AdaGrad by row) on a private copy of the parameters."""

    def __init__(self, p: Parameters, seed: int):
        self.p, self.draw = Parameters(p.symbols, p.rows.copy()), np.random.default_rng(seed)
        self.met = np.zeros(len(p.rows), np.int64)
        self.past = np.full((4, len(p.rows)), 1.0, np.float32)
        ends = np.cumsum(p.symbols.weight)
        self.cumulated, self.starts = ends, np.concatenate(([0], ends))
        self.class_ends = np.cumsum(p.class_share)
        self.log_share, self.log_class = np.log(p.share * WORD_NOISE).astype(np.float32), np.log(p.class_share * CLASS_NOISE).astype(np.float32)

    def _move(self, kind: int, table: np.ndarray, at: np.ndarray, grad: np.ndarray, shift: int = 0, bias: np.ndarray | None = None) -> None:
        """Steps of some rows; gradients of a row that comes several times are added up."""
        order = _order(at)
        own = at[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        g = np.add.reduceat(grad[order], first, axis=0)
        rows = own[first]
        self.met[rows + shift] += np.diff(first, append=len(own))
        self.past[kind, rows + shift] += (g * g).mean(axis=1)
        step = RATE / np.sqrt(self.past[kind, rows + shift])
        table[rows] -= g[:, :SIZE] * step[:, None]
        if bias is not None:
            bias[rows] -= g[:, SIZE] * step

    def step(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        p, width = self.p, self.p.symbols.width
        q, c = p.e1[i] + p.e2[j], w // width
        one = np.ones((len(w), 1), np.float32)
        q1 = np.hstack((q, one))
        v = np.minimum(np.searchsorted(self.class_ends, self.draw.random(CLASS_NOISE), side="right"), p.symbols.classes - 1)
        true = _sigmoid((q * p.rc[c]).sum(axis=1) + p.bc[c] - self.log_class[c]) - 1
        false = _sigmoid(q @ p.rc[v].T + p.bc[v] - self.log_class[v])
        dq = true[:, None] * p.rc[c] + false @ p.rc[v]
        low, high = self.starts[c * width], self.starts[np.minimum((c + 1) * width, p.symbols.start)]
        n = np.searchsorted(self.cumulated, low[:, None] + self.draw.random((len(w), WORD_NOISE)) * (high - low)[:, None], side="right")
        n = np.clip(n, (c * width)[:, None], np.minimum((c + 1) * width, p.symbols.start)[:, None] - 1)
        other = p.r[n]
        own = _sigmoid((q * p.r[w]).sum(axis=1) + p.b[w] - self.log_share[w]) - 1
        noise = _sigmoid(np.einsum("nd,nkd->nk", q, other) + p.b[n] - self.log_share[n])
        dq += own[:, None] * p.r[w] + np.einsum("nk,nkd->nd", noise, other)
        many = np.concatenate((own[:, None], noise), axis=1)
        self._move(2, p.r, np.concatenate((w[:, None], n), axis=1).ravel(), (many[:, :, None] * q1[:, None, :]).reshape(-1, SIZE + 1), 0, p.b)
        self._move(3, p.rc, np.concatenate((c, v)), np.concatenate((true[:, None] * q1, false.T @ q1)), p.symbols.start + 1, p.bc)
        self._move(0, p.e1, i, dq)
        self._move(1, p.e2, j, dq)


#: Changes of the rows [block * BLOCK, ...) that a task (or a group of tasks) has met.
_CHANGES = "block int, part bigint, rows binary, met binary, moved binary"


def _summed(table: pa.Table) -> pa.Table:
    """Weights and weighted changes of one block, added up in the order of tasks."""
    met, moved = np.zeros(BLOCK, np.float64), np.zeros((BLOCK, 3 * SIZE + 1))
    for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
        rows = np.frombuffer(r["rows"], "<i4")
        met[rows] += np.frombuffer(r["met"], "<f8")
        moved[rows] += np.frombuffer(r["moved"], "<f4").reshape(len(rows), -1)
    rows = np.flatnonzero(met)
    one = {"block": table.column("block")[0].as_py(), "part": min(table.column("part").to_pylist()), "rows": rows.astype("<i4").tobytes(), "met": met[rows].tobytes(), "moved": moved[rows].astype("<f4").tobytes()}
    return pa.Table.from_pylist([one], pa.schema([(x, table.schema.field(x).type) for x in one]))


def train(docs: DataFrame, symbols: Symbols, modulus: int, held: int) -> Parameters:
    """One pass over all training texts, in ROUNDS parts; after each, the tasks' changes are averaged row by row."""
    spark, p = docs.sparkSession, Parameters(symbols)
    own = docs.where(fold("doc_id", modulus) != held)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((symbols, p.rows))  # at most GROWTH * N ** (1/3) + BUCKETS rows of 196 bytes, and their classes

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            symbols, rows = shared.value
            task = TaskContext.get().partitionId()
            trainer = Trainer(Parameters(symbols, rows), 1000 * k + task)
            for batch in batches:
                for part in pieces(batch, "text", CHUNK):
                    count, words = split(part.column("text"))
                    own = symbols.code(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
                    i, j, w = contexts(own, count, symbols)
                    for a in range(0, len(w), BATCH):
                        trainer.step(i[a : a + BATCH], j[a : a + BATCH], w[a : a + BATCH])
            met = np.flatnonzero(trainer.met)
            moved = (trainer.p.rows[met] - rows[met]) * trainer.met[met, None]
            for block in np.unique(met // BLOCK).tolist():
                a, b = np.searchsorted(met, (block * BLOCK, (block + 1) * BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([(met[a:b] - block * BLOCK).astype("<i4").tobytes()], pa.binary()), pa.array([trainer.met[met[a:b]].astype("<f8").tobytes()], pa.binary()), pa.array([moved[a:b].astype("<f4").tobytes()], pa.binary())], names=["block", "part", "rows", "met", "moved"])

        part = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)
        # a group holds at most 512 tasks' rows of one block (50 kB each), then one row a group
        some = part.mapInArrow(run, _CHANGES).withColumn("some", F.expr("part div 512")).groupBy("block", "some").applyInArrow(_summed, _CHANGES)
        rows = p.rows.copy()
        for r in some.groupBy("block").applyInArrow(_summed, _CHANGES).collect():  # the parameters' size
            at = r["block"] * BLOCK + np.frombuffer(r["rows"], "<i4")
            rows[at] += np.frombuffer(r["moved"], "<f4").reshape(len(at), -1) / np.frombuffer(r["met"], "<f8")[:, None]
        p = Parameters(symbols, rows)
    return p


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = cut(coded(docs, modulus, held), "coded")
    words = rows.where("number >= 0").select("chunk", "number", "word", "n")
    counts = cut(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
    n_all, v_all, least = int(total["n"]), int(total["v"]), least_count(int(total["n"]))
    best = counts.where(F.col("c") >= least).where("word <> ''").orderBy(F.desc("c"), "word").collect()  # at most n / least
    others = {r["bucket"]: r for r in counts.where(F.col("c") < least).where("word <> ''").groupBy(bucket(F.col("word")).alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    rest_n, rest_v = (np.array([int(others[k][x]) if k in others else 0 for k in range(BUCKETS)]) for x in "nv")
    symbols = Symbols([r["word"] for r in best], [r["c"] for r in best], rest_n, int(total["ends"]))
    made = train(docs, symbols, modulus, held)
    share = np.zeros(symbols.start)  # of the symbols that are buckets: n + v + 1
    share[symbols.of_bucket] = rest_n + rest_v + 1
    shared = spark.sparkContext.broadcast((symbols, made.rows, share))  # bounded like the training's
    listed = spark.createDataFrame([*zip(symbols.words, symbols.of_word.tolist(), strict=True), ("", symbols.end)], "word string, symbol int")
    numbers = F.array(*(F.lit(int(x)) for x in symbols.of_bucket))
    rare = F.get(numbers, bucket(F.col("word")))
    known = counts.join(listed, "word", "left").select("word", "c", F.coalesce("symbol", rare).alias("symbol"))
    given = words.select("chunk", "number", "word").join(known, "word", "left")
    given = given.select("chunk", "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.when(F.col("word") == "", symbols.end), rare).alias("symbol"))

    def run(chunk: pa.Table, own: pa.Table) -> pa.Table:
        import zstandard

        symbols, rows, share = shared.value
        p = Parameters(symbols, rows)
        k = own.num_rows
        c, symbol, at = np.zeros(k, np.int64), np.zeros(k, np.int64), own.column("number").to_numpy()
        c[at], symbol[at] = own.column("c").to_numpy(), own.column("symbol").to_numpy()
        within = np.where(share[symbol] > 0, np.log10((c + 1) / np.maximum(share[symbol], 1)), 0.0)  # of a bucket's words
        out = {x: [] for x in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for row in chunk.select(["docs", "counts", "codes"]).to_pylist():
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8)
            count = np.array(row["counts"], np.int64)
            n = int(count.sum())
            planes = raw.reshape(-1, n).astype(np.int64) if n else np.zeros((1, 0), np.int64)
            number = sum(planes[i] << (8 * i) for i in range(len(planes)))
            before, last, now = contexts(symbol[number], count, symbols)
            ends = np.cumsum(count + 1)
            inside = np.ones(len(now), bool)
            inside[ends - 1] = False
            of_word = lambda x: _placed(x[number], x[k - 1], inside)  # noqa: B023, E731
            base, known = of_word(np.log10((c + 1) / (n_all + v_all + 1))), of_word((c > 0).astype(np.int32))
            log = p.log_probability(before, last, now)
            log /= np.log(10)
            log += of_word(within)
            first = ends - count - 1
            out["doc_id"] += row["docs"]
            out["held_out"] += (~trains(row["docs"], modulus, held)).tolist()
            out["n_tokens"] += (count + 1).tolist()
            out["n_known"] += np.add.reduceat(known, first).tolist()
            out["train_tokens"] += [n_all] * len(count)
            out["base_score"] += np.add.reduceat(base, first).tolist()
            out["score"] += np.add.reduceat(log, first).tolist()
        return pa.table({x: pa.array(v, t) for (x, v), t in zip(out.items(), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    chunks = rows.where("number < 0").select(F.col("chunk").alias("own"), "docs", "counts", "codes")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("own").cogroup(given.groupBy("chunk")).applyInArrow(run, schema)
