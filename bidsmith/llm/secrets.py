"""Secret scans: base patterns, and format likelihood under automata inferred from credentials.

Base spans are matches of three fixed patterns. The method infers one probabilistic automaton
for each kind of credential: a prefix tree of labelled credentials, character by character, whose states are
merged, in breadth-first order, where the frequencies of their endings and next characters are statistically
compatible (Hoeffding's bound at ALPHA); a state is held against its parent first, then against the others in
order. So fixed prefixes stay chains of states, and random parts become loops. Probabilities of a state are mixed with
the automaton's character frequencies (MIXED parts in 1), and a run may end anywhere with END at least. All candidates are scored: the runs of credential
characters of any length, less the base spans in them. A candidate's score is its log-likelihood under the best
automaton minus that under the better of two automata of ordinary runs of words, numbers and addresses, one over
characters and one over shapes (small, capital, digit, each mark), which knows words of any language; above
`threshold` it is a span of kind `format`. Full stops at a run's end are not part of it.

The labelled credentials are the fixed FORMATS expanded by a seeded generator (documented,
bounded by `examples` a format) and, where `fit` is given documents, the access and hex matches in at most
`sample` of them.

Spans are [start, end) in code points of the whole match. Defined results: null and empty
texts have no spans (base_sha256 of the empty string); an empty table gives no rows; repeated rows give equal
spans; spans that start at one place are ordered by kind, then end; of equal likelihoods the first kind counts; very
long runs are scored whole; a column of the table that has a new one's name, in any letter case, is replaced
(masking changes text alone and keeps every column).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict, deque
from functools import cache
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import annotate, free_name, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
ALPHA, MIXED, END = 0.05, 0.1, 1e-9
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")

#: Formats of credentials, as prefix, alphabet and shortest and longest length of the rest.
HEXADECIMAL, UPPER, LETTERS, URLSAFE, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FORMATS = {
    "hex": [("", HEXADECIMAL, 32, 64), ("", HEXADECIMAL.upper(), 32, 64)],
    "access": [("AKIA", UPPER, 16, 16), ("ASIA", UPPER, 16, 16)],
    "platform": [("ghp_", LETTERS, 36, 36), ("gho_", LETTERS, 36, 36), ("sk_live_", LETTERS, 24, 32), ("xoxb-", "0123456789-" + LETTERS, 40, 50), ("AIza", URLSAFE, 35, 35)],
    "random": [("", LETTERS, 20, 48), ("", URLSAFE, 22, 48), ("", BASE64, 24, 64)],
    "jwt": [("eyJ", URLSAFE, 60, 120)],
}
#: Parts of ordinary long runs.
PARTS = ["get", "set", "value", "config", "user", "data", "list", "index", "http", "www", "com", "html", "page", "long", "word", "the", "and", "tion", "ing", "ment", "heit", "keit", "lich", "que", "elle", "ción", "est", "ter", "over", "under", "count", "2024", "01", "10", "v2"]
JOINTS = ["", "", "", "", "_", "-", "/"]

#: Number of each credential character.
_CODE = np.zeros(256, np.int8)
_CODE[np.frombuffer((LETTERS + "+/_=.-").encode(), np.uint8)] = np.arange(len(LETTERS) + 6)
SYMBOLS = len(LETTERS) + 6
#: Shapes: capital 0, small 1, digit 2, the marks 3 to 8.
SHAPES = np.array([*[0] * 26, *[1] * 26, *[2] * 10, *range(3, 9)], np.int8)


class Automaton:
    """A deterministic probabilistic automaton over credential characters, inferred by state merging."""

    def __init__(self, samples: list[str], alpha: float = ALPHA, shapes: np.ndarray | None = None):
        """shapes: the symbol of each character (a character is drawn evenly from its symbol's); each its own by default."""
        self.symbol = np.arange(SYMBOLS, dtype=np.int8) if shapes is None else shapes
        follow: list[dict[int, int]] = [{}]
        passed: list[dict[int, int]] = [defaultdict(int)]
        ended: list[int] = [0]
        for s in samples:
            at = 0
            for c in self.symbol[_CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]].tolist():
                passed[at][c] += 1
                if c not in follow[at]:
                    follow[at][c] = len(follow)
                    follow.append({})
                    passed.append(defaultdict(int))
                    ended.append(0)
                at = follow[at][c]
            ended[at] += 1
        self.follow, self.passed, self.ended, self.bound = follow, passed, ended, sqrt(0.5 * log(2 / alpha))
        self._merge()
        self._table()
        del self.follow, self.passed, self.ended  # the tree: large, and of no use any more

    def _total(self, q: int) -> int:
        return self.ended[q] + sum(self.passed[q].values())

    def _differ(self, a: int, m: int, b: int, n: int) -> bool:
        return m > 0 and n > 0 and abs(a / m - b / n) > self.bound * (1 / sqrt(m) + 1 / sqrt(n))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self._total(p), self._total(q)
            if self._differ(self.ended[p], m, self.ended[q], n):
                return False
            for c in self.passed[p].keys() | self.passed[q].keys():
                if self._differ(self.passed[p].get(c, 0), m, self.passed[q].get(c, 0), n):
                    return False
                if c in self.follow[p] and c in self.follow[q]:
                    todo.append((self.follow[p][c], self.follow[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ended[p] += self.ended[q]
            for c, n in self.passed[q].items():
                self.passed[p][c] += n
            for c, t in self.follow[q].items():
                if c in self.follow[p]:
                    todo.append((self.follow[p][c], t))
                else:
                    self.follow[p][c] = t

    def _merge(self) -> None:
        red, seen = [0], {0}
        blue = deque()

        def fringe(states) -> None:
            for r in states:
                for c, t in sorted(self.follow[r].items()):
                    if t not in seen:
                        seen.add(t)
                        blue.append((t, r, c))

        fringe(red)
        while blue:
            q, parent, c = blue.popleft()
            if self.follow[parent].get(c) != q:
                continue
            for p in (parent, *(r for r in red if r != parent)):
                if self._compatible(p, q):
                    self.follow[parent][c] = p
                    self._fold(p, q)
                    fringe(red)
                    break
            else:
                red.append(q)
                fringe([q])
        self.red = red

    def _table(self) -> None:
        """next[state, character] and log-probability, and that of ending; a state without the character stays."""
        number = {q: i for i, q in enumerate(self.red)}
        wide = np.bincount(self.symbol)
        follow = np.repeat(np.arange(len(self.red), dtype=np.int32)[:, None], len(wide), axis=1)
        counts = np.zeros((len(self.red), len(wide)))
        for q, i in number.items():
            for c, n in self.passed[q].items():
                counts[i, c] = n
                follow[i, c] = number.get(self.follow[q].get(c), i)
        ended = np.array([self.ended[q] for q in self.red])
        often = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * len(wide))
        share = (counts + often) / (counts.sum(axis=1) + ended + 1)[:, None]
        self.end = np.log(np.maximum((1 - MIXED) * ended / (counts.sum(axis=1) + ended + 1), END))
        self.next, self.logp = follow[:, self.symbol], np.log(((1 - MIXED) * share + MIXED * often) / wide)[:, self.symbol]

    def score(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood of each row; rows are in descending order of length."""
        state, total = np.zeros(len(lengths), np.int32), np.zeros(len(lengths))
        for k in range(codes.shape[1]):
            n = int(np.searchsorted(-lengths, -k, side="left"))
            c = codes[:n, k]
            total[:n] += self.logp[state[:n], c]
            state[:n] = self.next[state[:n], c]
        return total + self.end[state]


class Model:
    """One automaton for each kind, and two for ordinary runs."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {k: Automaton(v) for k, v in credentials.items() if v}
        self.ordinary = [Automaton(ordinary), Automaton(ordinary, shapes=SHAPES)]

    def score(self, runs: list[str]) -> np.ndarray:
        """Best format's log-likelihood minus that of ordinary runs, over the whole run."""
        out = np.empty(len(runs))
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(-lengths, kind="stable")
        start = 0
        while start < len(order):
            width = lengths[order[start]]
            own = order[start : start + max(1, min(4096, int(4_000_000 // max(width, 1))))]
            table = _CODE[np.array([runs[r].encode() for r in own.tolist()], f"S{width}").view(np.uint8).reshape(len(own), width)]
            of = lambda automata: np.max([a.score(table, lengths[own]) for a in automata], axis=0)  # noqa: B023, E731
            out[own] = of(self.kinds.values()) - of(self.ordinary)
            start += len(own)
        return out


def examples(per_format: int = 150, seed: int = 7) -> tuple[dict[str, list[str]], list[str]]:
    """Credentials by kind, and ordinary runs, from the fixed formats and parts."""
    import random

    draw = random.Random(seed)
    made = {kind: [prefix + "".join(draw.choices(alphabet, k=draw.randint(low, high))) for prefix, alphabet, low, high in formats for _ in range(per_format)] for kind, formats in FORMATS.items()}
    ordinary = []
    while len(ordinary) < 8 * per_format:
        joint = draw.choice(JOINTS)
        run = joint.join(draw.choice([str.lower, str.lower, str.capitalize])(draw.choice(PARTS)) for _ in range(draw.randint(3, 14)))
        ordinary.append(re.sub("[^!-~]", "o", draw.choice([str, str, str, str.upper])(run)))
    for _ in range(2 * per_format):
        digits = lambda k: "".join(draw.choices("0123456789", k=k))
        ordinary.append(draw.choice([digits(draw.randint(8, 24)), f"{digits(3)}-{digits(4)}-{digits(4)}", f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}", f"{digits(4)}-{digits(2)}-{digits(2)}", "-" * 20, "=" * 20, "." * 20]))
    for _ in range(8 * per_format):  # short runs, of any characters
        ordinary.append("".join(draw.choices(LETTERS + "+/_=.-", k=draw.randint(1, 5))))
    for _ in range(4 * per_format):
        ordinary.append(re.sub("[^!-~]", "o", "".join(draw.choice([str, str, str.capitalize, str.upper])(draw.choice(PARTS)) for _ in range(draw.randint(1, 2)))))
    return made, ordinary


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base matches; kinds 0 assign, 1 access, 2 hex."""
    out = []
    if _WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


KINDS = ("assign", "access", "hex", "format")


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of the runs' parts outside base spans, without full stops at their ends. base: in order."""
    if not base:
        found = [(m.start(), m[0].rstrip(".")) for m in _RUN.finditer(text)]
        return [(a, a + len(run), run) for a, run in found if run]
    out, k, covered = [], 0, 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][0] < end:
            a, _, b = base[k]
            out.append((max(at, covered), a))
            covered = max(covered, b)
            k += 1
        out.append((max(at, covered), end))
    parts = [(a, text[a:b].rstrip(".")) for a, b in out if a < b]
    return [(a, a + len(run), run) for a, run in parts if run]


def scan(texts: list[str | None], model: Model, threshold: float) -> list[tuple[list, list]]:
    """(base spans, further spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    runs: set[str] = set()
    for t, own in zip(texts, base, strict=True):
        if t:
            runs.update(run for _, _, run in candidates(t, own)) if own else runs.update(x.rstrip(".") for x in set(_RUN.findall(t)))
    distinct = sorted(runs - {""})
    scores = model.score(distinct)
    likely = {distinct[i] for i in np.flatnonzero(scores > threshold).tolist()}
    # places are looked up only in the texts that hold a likely run
    more = [[(a, 3, b) for a, b, run in candidates(t, own) if run in likely] if t and any(x in t for x in likely) else [] for t, own in zip(texts, base, strict=True)]
    return list(zip(base, more, strict=True))


@cache
def standard() -> Model:
    return Model(*examples())


def fit(docs: DataFrame | None = None, sample: int = 300) -> Model:
    """The model from the fixed formats and, where docs is given, the hex and access matches in a sample of at most that many documents (smallest hashes)."""
    if docs is None:
        return standard()
    made, ordinary = examples()
    likely = docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}")).select("doc_id", F.slice(F.regexp_extract_all("text", F.lit("(AKIA[A-Z0-9]{16,100}|[0-9a-f]{24,100})")), 1, 5).alias("found"))
    for r in likely.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
        for x in r["found"]:
            made["access" if x.startswith("AKIA") else "hex"].append(x)
    return Model(made, ordinary)


#: In nats: a run must be e ** 5 times likelier as a credential than as an ordinary run.
THRESHOLD = 5.0


def scan_secrets(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    small_batches(docs.sparkSession)
    model = model or fit()

    def score(texts, _):
        found = scan(texts, model, threshold)
        count = lambda k: [sum(x[1] == k for x in b) for b, _ in found]
        return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in found], "spans": [shown(b + m) for b, m in found]}

    return annotate(docs, score, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", keep)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span's characters replaced by one mark; overlapping spans give one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b > at:
            out.append(text[at : max(a, at)] + ("[SECRET]" if a >= at else ""))
            at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets masked in text, columns unchanged."""
    small_batches(docs.sparkSession)
    model = model or fit()
    raw = free_name(docs, "raw")
    marked = annotate(docs.withColumn(raw, F.col("text")), lambda texts, _: {"text": [masked(t, b + m) for t, (b, m) in zip(texts, scan(texts, model, threshold), strict=True)]}, "text string", docs.columns, text=raw)
    return marked.select(*docs.columns)
