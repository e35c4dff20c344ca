"""What built-in expressions can't say: dynamic programs and order-dependent loops, in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one addition of len(b) bits a word of a."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a cleared bit is a step of the dynamic program's row
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


@pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence; two empty texts agree."""

    def one(x, y):
        if not len(x) and not len(y):
            return 1.0
        k = lcs(list(x), list(y))
        return 2.0 * k / (len(x) + len(y)) if k else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Rows, and characters, that numpy takes at once within an Arrow batch.
ROWS, CHARS = 256, 1 << 18


def _by_rows(score):
    """score of two arrays, a few rows at a time."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        cuts = [pa.array(np.arange(k, min(len(a), k + ROWS))) for k in range(0, max(1, len(a)), ROWS)]
        return pa.concat_arrays([score(a.take(i), b.take(i)) for i in cuts])

    return run


def _coded(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every element of a, then of b, whose rows are numbered on from a's; and the different texts, by code. A null row has no elements."""
    words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (a, b)])
    return np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy().astype(np.int64), words.dictionary


def _shared(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and both counts of what row i and row n + i have in common."""
    size = int(codes.max(initial=0)) + 1
    (u, c), (v, d) = (np.unique(rows[own] % n * size + codes[own], return_counts=True) for own in (rows < n, rows >= n))
    both, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return both // size, both % size, c[i], d[j]


def shared_grams(most: int):
    """A function of two arrays of text: the sizes of the multiset intersections of their n-grams, n from 1 to most; null for a null array."""

    def score(a: pa.ListArray, b: pa.ListArray) -> pa.Array:
        rows, words, names = _coded(a, b)
        out, grams = np.zeros((len(a), most), np.int32), words
        for n in range(1, most + 1):
            ends = rows[n - 1 :]
            if n > 1:  # the gram before and one word more, numbered anew so that numbers stay small
                grams = np.unique(grams[: len(ends)] * len(names) + words[n - 1 :], return_inverse=True)[1]
            inside = rows[: len(ends)] == ends
            row, _, c, d = _shared(ends[inside], grams[inside], max(1, len(a)))
            out[:, n - 1] = np.bincount(row, np.minimum(c, d), len(a))
        gone = pc.or_(pc.is_null(a), pc.is_null(b))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * most, pa.int32()), pa.array(out.ravel()), mask=gone)

    return arrow_udf(_by_rows(score), ArrayType(IntegerType()))


def _matched(own: pa.ListArray, query: pa.ListArray) -> pa.Array:
    rows, words, names = _coded(own, query)
    row, term, f, times = _shared(rows, words, max(1, len(own)))
    raw = np.bincount(row, math.log(2.0) * f * 2.5 / (f + 1.5) * times, len(own))
    long = np.bincount(row, pc.utf8_length(names).to_numpy()[term] >= 8, len(own)) > 0
    return pa.StructArray.from_arrays([pa.array(raw), pa.array(np.bincount(row, minlength=len(own)), pa.int32()), pa.array(long)], ["raw", "matched", "long"])


#: Of a document's tokens and a query's: the sum of what each shared term adds (the document being the mean length), how many there are, and whether one has eight characters.
matched_terms = arrow_udf(_by_rows(_matched), StructType([StructField("raw", DoubleType()), StructField("matched", IntegerType()), StructField("long", BooleanType())]))


def simhash(texts: list[str], gram: int = 4) -> list[int]:
    """64-bit SimHashes over character grams (a shorter text is one), as signed integers; each different gram is hashed once: md5's first eight bytes."""
    joined = "".join(texts)
    chars = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    wide, windows = int(chars.max(initial=0)) + 1, max(0, len(chars) - gram + 1)
    grams = chars[:windows]
    for k in range(1, gram):
        if wide ** (k + 1) >= 2**62:
            grams = np.unique(grams, return_inverse=True)[1]
        grams = grams * wide + chars[k : k + windows]
    _, first, number = np.unique(grams, return_index=True, return_inverse=True)
    digest = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8]
    hashes = np.frombuffer(b"".join(digest(joined[i : i + gram]) for i in first.tolist()), np.uint8).reshape(-1, 8)
    out, at = [], 0
    for text in texts:
        n = len(text) - gram + 1
        if n < 1:
            bits = np.frombuffer(digest(text), np.uint8)
        else:
            ones = sum(np.unpackbits(hashes[number[k : min(k + CHARS, at + n)]], axis=1).sum(axis=0, dtype=np.int64) for k in range(at, at + n, CHARS))
            bits = np.packbits(2 * ones > n)
        out.append(int.from_bytes(bits.tobytes(), "big", signed=True))
        at += len(text)
    return out


def simhashes(gram: int):
    """simhash of a column of texts, about CHARS characters at a time."""

    def run(texts: pd.Series) -> pd.Series:
        part = (texts.str.len().cumsum() // CHARS).to_numpy()
        cuts = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1)
        return pd.Series([h for cut in cuts for h in simhash(texts.iloc[cut].tolist(), gram)], dtype="int64")

    return pandas_udf(run, LongType())


def greedy_clusters(hashes: list[int], radius: int = 3) -> list[int]:
    """The first earlier cluster head within radius bits (of 64), else the item itself becomes one."""
    own = np.array([h & (2**64 - 1) for h in hashes], np.uint64)
    heads, n, out = np.empty(len(own), np.uint64), 0, []
    for h in own:
        near = np.bitwise_count(heads[:n] ^ h) <= radius
        at = int(near.argmax()) if near.any() else n
        if at == n:
            heads[n] = h
            n += 1
        out.append(at)
    return out


def knee(curve: list[int]) -> int | None:
    n = len(curve)
    if n < 3:
        return None
    if curve[-1] == curve[0]:
        return 1
    gaps = [(y - curve[0]) / (curve[-1] - curve[0]) - i / (n - 1) for i, y in enumerate(curve)]
    best = max(gaps)
    return gaps.index(best) + 1 if best >= 0.05 else None


def best_size(items: list[str], hashes: list[int], bias: float = 1.0, least: int = 3, most: int | None = None, small: int = 8, tolerance: float = 0.15) -> int:
    """All of a few items; else the knee times bias, a fifth more where the kept part compresses much unlike the whole.

    hashes: the items' SimHashes. Diversity is their clusters' share of the items. Without a knee, 0.3 + 0.7 *
    diversity of the items are kept; the same is the floor of a knee where diversity is over 0.7.
    """
    n = len(items)
    most = n if most is None else most
    if n <= small:
        return n
    unique = len(set(greedy_clusters(hashes)))
    if unique <= 3:
        return min(max(least, unique), most)
    seen, curve = set(), []
    for t in items:
        w = t.lower().split()
        seen.update(zip(w, w[1:], strict=False) if len(w) > 1 else [(w[0] if w else "", "")])
        curve.append(len(seen))
    at, varied = knee(curve), unique / n
    floor = max(least, int(n * (0.3 + 0.7 * varied)))
    if at is None:
        at = floor
    elif varied > 0.7:
        at = max(at, floor)
    k = min(max(least, int(at * bias)), most)
    whole, part = ("\n".join(x).encode() for x in (items, items[:k]))
    if k < min(n, most) and len(whole) >= 200:
        ratio = lambda x: len(zlib.compress(x, 1)) / len(x) if x else 1.0
        if abs(ratio(whole) - ratio(part)) > tolerance:
            k = min(int(k * 1.2), most)
    return max(least, min(k, most))


def optimal_size(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("turn")
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "n": [len(pdf)], "k": [best_size(pdf["text"].fillna("").tolist(), pdf["simhash"].tolist())]})


#: The elements of the HTML standard; every other tag is custom.
STANDARD = frozenset(
    """html base head link meta style title body address article aside footer h1 h2 h3 h4 h5 h6 header hgroup main nav section search
    blockquote dd div dl dt figcaption figure hr li menu ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s
    samp small span strong sub sup time u var wbr area audio img map track video embed iframe object param picture portal source svg math
    canvas noscript script del ins caption col colgroup table tbody td tfoot th thead tr button datalist fieldset form input label legend
    meter optgroup option output progress select textarea details dialog summary slot template""".split()
)
#: One tag: a slash if it closes, its name, what follows, a slash if it stands alone.
_TAG = re.compile(r"<(/?)([a-zA-Z_][\w.-]*)(\s[^>]*?)?(/?)>")


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans of custom blocks and custom tags that stand alone, in order; a standard element is passed over whole but for the latter."""
    tags = list(_TAG.finditer(text))
    closing: dict[str, list[re.Match]] = {}
    for m in tags:
        if m[1] and not m[3] and not m[4]:
            closing.setdefault(m[2], []).append(m)
    starts = {name: [m.start() for m in ms] for name, ms in closing.items()}
    spans, alone, done = [], [], 0
    for m in tags:
        if m[1]:
            continue
        custom = m[2].lower() not in STANDARD
        if custom and m[4]:
            alone.append(m.span())
        if m.start() < done or (m[4] and not m[3]):
            continue
        at = bisect_left(starts.get(m[2], []), m.end())
        if at < len(starts.get(m[2], [])):
            done = closing[m[2]][at].end()
            if custom:
                spans.append((m.start(), done))
    ends = [b for _, b in spans]
    free = [(a, b) for a, b in alone if (k := bisect_left(ends, b)) == len(spans) or spans[k][0] > a]
    return sorted(spans + free)


def set_aside(text: str, whole: bool = True) -> tuple[str, dict[str, str]]:
    """The text with marks for its custom blocks (or, not whole, for custom tags only), and each mark's text.

    A block runs from a tag to the first closing one of its name. Blocks inside a standard element stay with it;
    custom tags that stand alone are set aside anywhere. Marks are fenced by more NULs than the text holds in a row.
    """
    fence = "\x00"
    while fence in text:
        fence += "\x00"
    spans = _blocks(text) if whole else [m.span() for m in _TAG.finditer(text) if m[2].lower() not in STANDARD and not (m[1] and (m[3] or m[4]))]
    out, blocks, last = [], {}, 0
    for a, b in spans:
        mark = f"{fence}{len(blocks)}{fence}"
        blocks[mark] = text[a:b]
        out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]]), blocks


def put_back(text: str, blocks: dict[str, str]) -> str:
    """The marks' texts in their places; those whose marks were lost come at the end, a line each."""
    if not blocks:
        return text
    fence = next(iter(blocks)).partition("0")[0]
    found = set()

    def own(m: re.Match) -> str:
        found.add(m[0])
        return blocks.get(m[0], m[0])

    text = re.sub(f"{fence}\\d+{fence}", own, text)
    return "\n".join([text, *(b for mark, b in blocks.items() if mark not in found)])


@pandas_udf(StructType([StructField("n_blocks", IntegerType()), StructField("rest", StringType()), StructField("restored", BooleanType())]))
def protect(html: pd.Series) -> pd.DataFrame:
    """Number of blocks, the text beside them, and whether putting them back gives the text; null is empty."""

    def one(own: str) -> tuple[int, str, bool]:
        text, blocks = set_aside(own)
        return len(blocks), re.sub("\x00+\\d+\x00+", "", text), put_back(text, blocks) == own

    return pd.DataFrame([one(h or "") for h in html], columns=["n_blocks", "rest", "restored"])  # a page at a time
