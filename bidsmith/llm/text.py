"""Words and shingles of many texts at once, in numpy: no Python loop over words."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[_LOWER]
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse for i < n; kept for the largest n so far."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _ODD), ("down", _UNDO)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """Words of a batch of texts (null: none): hash of each lower-cased (A-Z) word, byte span, and the text it is in."""

    def __init__(self, texts: list[str | None], marks: bool = True):
        """marks: ASCII punctuation belongs to words; otherwise it parts them."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))[: len(raw)]
        chars = np.frombuffer(self.data, np.uint8)
        space = (_SPACE if marks else _PARTS)[chars]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[::2], edge[1::2]
        if not len(raw):
            self.start = self.end = np.empty(0, np.int64)
        up, down = _powers(len(chars) + 1)
        sums = np.empty(len(chars) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTER[chars] * up[:-1], out=sums[1:])
        self.hash = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.text = np.repeat(np.arange(len(raw)), self.count)

    def windows(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of width words, and where each text's begin (one more entry ends the last).

        A text of fewer words has its whole sequence as its one window, and none without words.
        """
        n = len(self.hash)
        out = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            out = (out ^ self.hash[k : n - width + 1 + k]) * _ODD
            out ^= out >> np.uint64(31)
        out = _mixed(out)
        number = np.where(self.count >= width, self.count - width + 1, (self.count > 0).astype(np.int64))
        begin = np.concatenate(([0], np.cumsum(number)))
        result = np.empty(begin[-1], np.uint64)
        whole = self.text[: len(out)] == self.text[width - 1 :] if len(out) else np.empty(0, bool)
        long = np.repeat(self.count >= width, number)
        result[long] = out[whole]
        for i in np.flatnonzero((self.count > 0) & (self.count < width)):
            h = np.uint64(self.count[i])
            for x in self.hash[self.first[i] : self.first[i] + self.count[i]]:
                h = (h ^ x) * _ODD
                h ^= h >> np.uint64(31)
            result[begin[i]] = _mixed(np.array([h], np.uint64))[0]
        return result, begin


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of each text, sorted within it, and where each text's begin."""
    with np.errstate(over="ignore"):
        h, begin = Words(texts).windows(width)
    sets = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
