"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

The kernel of two strings counts their common subsequences of three characters, each occurrence
weighed by DECAY to the power of its span; between its characters up to GAP - 1 others may
stand, so inserted or dropped characters cost a share of the weight only. Strings are the
words of a sentence, with end marks; without ASCII punctuation; a run of single characters parted by spaces is one word. A
sentence, and a document, is as toxic as its worst word: labels belong to documents, so training
alternates between choosing the words that carry a positive label and fitting the machine
(multiple-instance learning); chosen words also count with a character put in or left out.

Nyström: with landmarks L, f(x) = w . K(L,L)^-1/2 k(L,x). As k is an inner product of subsequence
counts, that is one weight a subsequence: documents are scored by adding up weights, exactly.

Training reads at most `sample` labelled rows of either label (the smallest hashes of doc_id)
outside the held-out fold; only the text enters a score. Probabilities come from a logistic fit on
the documents' worst and second-worst words.

Defined results: null, empty and wordless texts get the score of a document whose words all are
harmless; without labels of both kinds on texts with words every score is 0; an empty table gives no rows; repeated rows
score alike, and repeated labels of a doc_id count as the worst; a word that is worst twice in a text is its second-worst
too; very long texts are scored whole, 20,000 words at a time; further columns pass through, and one that has the score's name, in any
letter case, is replaced (the filter takes a name that is free and changes no column).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import annotate, fold, free_name, small_batches

GAP, DECAY, SIGNS = 3, 0.7, 128
_STEPS = [(a, b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]
_SPACED = re.compile(r"(?<!\S)\S(?:[\x20\x09-\x0D]\S){2,}[!-/:-@\[-`{-~]*(?!\S)")
_TRIM = "".join(chr(c) for c in range(9, 127) if not chr(c).isalnum() and (c < 14 or c >= 32))
_EDGE = r"[!-/:-@\[-`{-~]*[\x20\x09-\x0D]+[!-/:-@\[-`{-~]*"
_MANY = r"(^|\s)[^\s]\s[^\s]\s[^\s](\s|$)"
#: Character classes: letters a-z, digits, the rest of ASCII; then SCRIPT classes in turn, so that the letters of one alphabet
#: (all but the largest have fewer) differ. Start and end of a string have classes of their own.
_ASCII = np.full(128, 27, np.int64)
_ASCII[97:123] = np.arange(26)
_ASCII[48:58] = 26
SCRIPT, FIRST, LAST, HARMLESS = 97, 126, 127, -1.5


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all words with end marks, and the word of each."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("\x01" + "\x02\x01".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.empty(0, np.uint32)
    out = np.where(points < 128, _ASCII[np.minimum(points, 127)], 28 + points.astype(np.int64) % SCRIPT)
    ends = np.cumsum(size)
    out[ends - size], out[ends - 1] = FIRST, LAST
    return out, np.repeat(np.arange(len(words)), size)


def triples(classes: np.ndarray, word: np.ndarray):
    """(subsequence code, place of its first character, weight) for each pair of steps."""
    for a, b in _STEPS:
        n = len(classes) - a - b
        if n > 0:
            at = np.flatnonzero(word[:n] == word[a + b :])
            yield (classes[at] * SIGNS + classes[at + a]) * SIGNS + classes[at + a + b], at, DECAY ** (a + b - 1)


def features(words: list[str]) -> list[dict[int, float]]:
    """Subsequence weights of each word, scaled by the root of the sum of squared occurrence weights."""
    classes, word = letters(words)
    out: list[dict[int, float]] = [{} for _ in words]
    for codes, at, w in triples(classes, word):
        for c, i in zip(codes.tolist(), word[at].tolist(), strict=True):
            out[i][c] = out[i].get(c, 0.0) + w
    size = norms(classes, word, len(words))
    return [{c: v / size[i] for c, v in x.items()} for i, x in enumerate(out)]


def norms(classes: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for _, at, w in triples(classes, word):
        out += np.bincount(word[at], minlength=n) * w * w
    return np.sqrt(np.maximum(out, 1e-9))


def gram(x: list[dict], y: list[dict]) -> np.ndarray:
    codes = {c: i for i, c in enumerate({c for d in y for c in d})}

    def dense(rows):
        out = np.zeros((len(rows), len(codes)), np.float32)
        for i, d in enumerate(rows):
            for c, v in d.items():
                if c in codes:
                    out[i, codes[c]] = v
        return out

    return dense(x) @ dense(y).T


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps, summed over blocks of rows; the last column of z is 1, its coefficient the bias."""
    w = np.zeros(z.shape[1])
    keep = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        left, right = keep.copy(), np.zeros(len(w))
        for k in range(0, len(z), 1000):
            own, label = z[k : k + 1000].astype(float), y[k : k + 1000]
            wrong = label * (own @ w) < 1
            own = own[wrong]
            scaled = own * weight[k : k + 1000][wrong, None]
            left += cost * scaled.T @ own
            right += cost * scaled.T @ label[wrong]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


class Model:
    """table: a weight for each subsequence; bias; logistic coefficients of the worst and second-worst word."""

    def __init__(self, table: np.ndarray, bias: float, logistic: tuple[float, float, float]):
        self.table, self.bias, self.logistic = table, bias, logistic
        self.landmarks: list[str] = []
        self.weights = np.empty(0)  # of the landmarks, in f(x) = sum of weight * k(landmark, x) + bias

    def words(self, words: list[str]) -> np.ndarray:
        """f of each word, 20,000 words at a time."""
        if not words:
            return np.empty(0)
        if len(words) > 20_000:
            return np.concatenate([self.words(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        classes, word = letters(words)
        total, square = np.zeros(len(words)), np.zeros(len(words))
        for codes, at, w in triples(classes, word):
            total += np.bincount(word[at], self.table[codes] * w, len(words))
            square += np.bincount(word[at], minlength=len(words)) * (w * w)
        return total / np.sqrt(np.maximum(square, 1e-9)) + self.bias

    def worst(self, texts: pa.Array) -> np.ndarray:
        """Largest and second-largest f among the words of each text, at least HARMLESS."""
        count, number, names = split(texts)
        out = np.full((len(texts), 2), HARMLESS)
        if len(number):
            f = np.maximum(self.words(names), HARMLESS)[number]
            full = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[full]
            out[full, 0] = np.maximum.reduceat(f, begin)
            text = np.repeat(np.arange(len(full)), count[full])
            tops = np.flatnonzero(f == out[full, 0][text])
            f[tops[np.unique(text[tops], return_index=True)[1]]] = HARMLESS
            out[full, 1] = np.maximum.reduceat(f, begin)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        a, b, c = self.logistic
        x = np.clip(self.worst(texts), HARMLESS, 3)
        return 1 / (1 + np.exp(-(x[:, 0] * a + x[:, 1] * b + c)))


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words a text, each word's number, and the distinct words, lower-cased; runs of single characters are joined."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    spaced = pc.fill_null(pc.match_substring_regex(texts, _MANY), False).to_numpy(zero_copy_only=False)
    if spaced.any():
        texts = pa.array([_SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), t) if s else t for t, s in zip(texts.to_pylist(), spaced, strict=True)], pa.large_string())
    lists = pc.split_pattern_regex(pc.fill_null(pc.ascii_trim(texts, _TRIM), ""), _EDGE)
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.replace_substring_regex(lists.flatten(), r"[!-/:-@\[-`{-~]+", "").dictionary_encode()
    return count, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _bent(word: str, draw: np.random.Generator) -> str:
    """The word with one character put in or left out."""
    if len(word) < 4:
        return word
    at = int(draw.integers(1, len(word)))
    return word[:at] + chr(int(draw.integers(97, 123))) + word[at:] if draw.random() < 0.7 else word[: at - 1] + word[at:]


def _parts(rows: list[tuple[str | None, int]], size: int = 200) -> Iterator[pa.Array]:
    """The texts, some at a time: the driver's memory is small."""
    for k in range(0, len(rows), size):
        yield pa.array([t for t, _ in rows[k : k + size]], pa.string())


def train(rows: list[tuple[str | None, int]], landmarks: int = 250, rounds: int = 3, seed: int = 3) -> Model | None:
    """The machine from (text, label) rows."""
    draw = np.random.default_rng(seed)
    y = np.array([label for _, label in rows])
    if not len(rows) or y.min() == y.max():
        return None
    known: dict[str, int] = {}
    bags = []  # the different words of each text
    for part in _parts(rows):
        count, number, words = split(part)
        own = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        ends = np.cumsum(count)
        bags += [np.unique(own[number[e - n : e]]) for e, n in zip(ends, count, strict=True)]
    names = list(known)
    del known
    n_bad, n_good = (np.bincount(np.concatenate([b for b, label in zip(bags, y, strict=True) if label == k]), minlength=len(names)) for k in (1, 0))
    odds = np.log((n_bad + 0.1) / y.sum()) - np.log((n_good + 0.1) / (1 - y).sum()) + np.where(n_bad > 1, np.log(np.maximum(n_bad, 1)), -2)
    telling = (n_bad >= 3) & (n_bad / y.sum() >= 10 * (n_good + 0.5) / (1 - y).sum())
    clean = np.flatnonzero(n_good)
    common = clean[np.argsort(-n_good[clean], kind="stable")[:3000]]
    harmless = np.unique(np.concatenate([common, draw.permutation(clean)[:6000]]))
    score = odds
    for step in range(rounds):
        chosen = Counter()
        for b, label in zip(bags, y, strict=True):
            if label and len(b):
                tops = b[np.argsort(-score[b])[:6]]
                chosen.update(int(i) for k, i in enumerate(tops) if k == 0 and (step == 0 or score[i] > -0.5) or telling[i])
        positive = np.array([i for i in chosen if n_good[i] <= 0.2 * n_bad[i]], np.int64)
        if not len(positive):
            positive = np.array(list(chosen), np.int64)
        if step:
            seen = clean[~np.isin(clean, positive)]
            harmless = np.unique(np.concatenate([harmless, seen[np.argsort(-score[seen])[:2000]]]))
        harmless = harmless[~np.isin(harmless, positive)]
        if not len(positive) or not len(harmless):
            return None
        if step == 0:
            first = sorted(positive.tolist(), key=lambda i: -chosen[i])[: landmarks // 2]
            chosen_marks = [names[i] for i in [*first, *draw.permutation(harmless)[: landmarks - len(first)]]]
            marks = features(chosen_marks)
            own = gram(marks, marks).astype(float)
            values, vectors = np.linalg.eigh(own)
            half = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        rows_in = [*positive.tolist(), *harmless.tolist()]
        bent = [_bent(names[i], draw) for i in positive.tolist() for _ in range(2)]
        near = [names[i] for i in rows_in] + bent
        z = np.ones((len(near), half.shape[1] + 1), np.float32)
        for k in range(0, len(near), 250):
            z[k : k + 250, :-1] = gram(features(near[k : k + 250]), marks) @ half
        target = np.array([1.0] * len(positive) + [-1.0] * len(harmless) + [1.0] * len(bent))
        many = np.array([min(chosen[i], 20) for i in positive.tolist()] + [1.0] * len(harmless), float)
        many[: len(positive)] *= len(harmless) / many[: len(positive)].sum() / 4
        many = np.append(many, np.repeat(many[: len(positive)] / 2, 2))
        w = svm(z, target, many)
        table = np.zeros(SIGNS**3, np.float32)
        for m, v in zip(marks, half @ w[:-1], strict=True):
            for c, x in m.items():
                table[c] += v * x
        model = Model(table, float(w[-1]), (1.0, 0.0, 0.0))
        model.landmarks, model.weights = chosen_marks, half @ w[:-1]
        score = model.words(names)
    x = np.clip(np.concatenate([model.worst(part) for part in _parts(rows)]), HARMLESS, 3)
    z = np.hstack([x, np.ones((len(x), 1))])
    balance = np.where(y == 1, np.sqrt((1 - y).sum() / max(y.sum(), 1)), 1.0)
    free = [0, 1, 2]
    while True:  # a worse word never lowers the score: negative coefficients are left out
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            grad = (z.T @ (balance * (p - y)) + 0.1 * w)[free]
            w[free] -= np.linalg.solve((z[:, free] * (balance * p * (1 - p) + 1e-9)[:, None]).T @ z[:, free] + 0.1 * np.eye(len(free)), grad)
        bent = [i for i in free if i < 2 and w[i] < 0]
        if not bent:
            break
        free.remove(bent[0])
    model.logistic = tuple(w)
    pa.default_memory_pool().release_unused()
    return model


def sampled(docs: DataFrame, labels: DataFrame, sample: int, modulus: int, held: int) -> list[tuple[str | None, int]]:
    """Texts and labels outside the held-out fold: at most sample rows of either label."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()  # the broadcast side: 2 * sample ids
    return [(r["text"], int(r["toxic"])) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, modulus: int = 3, held: int = 1) -> Model | None:
    return train(sampled(docs, labels, sample, modulus, held))


def with_toxicity(docs: DataFrame, model: Model | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def score(_, part):
        texts = part.column("text")
        return {name: shared.value.score(texts) if shared.value else np.zeros(len(texts))}

    return annotate(docs, score, f"`{name}` double", keep)


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """docs without the documents that score threshold or more, columns unchanged."""
    name = free_name(docs, "score")
    return with_toxicity(docs, model, name=name).where(F.col(name) < threshold).select(*docs.columns)
