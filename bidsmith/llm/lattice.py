"""Piece lattices of many words at once: best paths and sampled paths, in numpy.

The vocabulary is a SentencePiece model file's; its pieces get unigram log-probabilities by
rule from their rank r in the file, -ln(r + 2) rounded to 1/256 (so sums are exact in 32-bit
floats, and ties are true ties). A space is the mark of a word: a text is taken as if one space
stood before it, no piece has a space after another character, and so the lattice of a
text falls apart at each space that follows a non-space. Characters without a piece of their
own become UTF-8 byte pieces, at the score of the worst piece minus 10.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNITS, UNKNOWN = 256, 10 * 256
_CHUNK = re.compile(" *[^ ]+| +")


def _step(h, code):
    """The hash of a string from that of all but its last character."""
    h = (h ^ (code + np.uint64(0x9E3779B9))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hash(text: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = _step(h, np.uint64(ord(c)))
    return h[0]


class Pieces:
    """The vocabulary of a model file, with an Aho-Corasick automaton over its pieces."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.text: list[bytes] = [b""] * len(model.pieces)
        self.byte = np.zeros(256, np.int32)
        self.length = np.zeros(len(model.pieces) + 1, np.int32)
        self.score = np.zeros(len(model.pieces) + 1, np.int64)
        rank = 0
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                own = p.piece.replace("▁", " ")
                self.automaton.add_word(own, i)
                self.text[i] = own.encode()
                self.length[i] = len(own)
                self.score[i] = -round(UNITS * np.log(rank + 2))
                rank += 1
        self.automaton.make_automaton()
        normal = np.flatnonzero(self.length[:-1])
        with np.errstate(over="ignore"):
            keys = np.array([_hash(self.text[i].decode()) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order].astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True
        self.score[-1] = self.score.min() - UNKNOWN  # at -1: an unknown character
        self.length[-1] = 1


    def enumerated(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of every match, by end, the longest first: from the automaton."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int32).reshape(-1, 2)
        return found[:, 0] + 1, found[:, 1]

    def looked_up(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The same matches, from hashes of all substrings that are no longer than a piece."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at, h, ends, found = np.flatnonzero(codes), None, [], []
        with np.errstate(over="ignore"):
            for n in range(1, int(self.length.max()) + 1):
                if n > 1:
                    inside = at + n <= len(codes)
                    inside[inside] = codes[at[inside] + n - 1] > 0
                    at, h = at[inside], h[inside]
                h = _step(np.zeros(len(at), np.uint64) if h is None else h, codes[at + n - 1])
                near = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                place = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
                hit = self.keys[place] == h[near]
                ends.append((at[near[hit]] + n).astype(np.int32))
                found.append(self.ids[place[hit]])
        end, piece = np.concatenate(ends[::-1]), np.concatenate(found[::-1])
        order = np.argsort(end, kind="stable")
        return end[order], piece[order]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text (counts), each word's number, and the distinct words.

    A word leaves out its first space: "a b" has words "a" and "b". Null and the empty text have none.
    """
    texts = texts.cast(pa.large_string())
    texts = pc.if_else(pc.equal(texts, ""), None, texts)
    odd = pc.fill_null(pc.match_substring_regex(texts, "^ |  | $"), False).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    if odd.any():
        lists = pa.array([[c[1:] for c in _CHUNK.findall(" " + t)] if o else w for t, o, w in zip(texts.to_pylist(), odd, lists.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class Lattice:
    """All pieces' matches in words (each after its space). Node numbers are places in the joined words."""

    def __init__(self, own: Pieces, words: list[str], automaton: bool = True):
        """automaton: matches come from Aho-Corasick, else from hashes; they are the same."""
        self.pieces = own
        joined = "\0".join(" " + w for w in words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.base = np.cumsum(size + 1) - size - 1
        self.last = self.base + size
        self.joined = joined
        end, piece = own.enumerated(joined) if automaton else own.looked_up(joined)
        length = own.length[piece]
        alone = np.zeros(len(joined) + 1, bool)
        alone[self.last] = True
        alone[end[length == 1] - 1] = True
        unknown = np.flatnonzero(~alone[: len(joined)]).astype(np.int32)
        if len(unknown):
            end, piece, length = np.concatenate((end, unknown + 1)), np.concatenate((piece, np.full(len(unknown), -1, np.int32))), np.concatenate((length, np.ones(len(unknown), np.int32)))
            order = np.argsort(end, kind="stable")
            end, piece, length = end[order], piece[order], length[order]
        where = np.zeros(len(joined) + 2, np.int32)
        where[self.base[1:]] = np.diff(self.base)
        depth = np.arange(len(joined) + 2, dtype=np.int32) - np.cumsum(where, dtype=np.int32)
        deep = depth[end]
        order = np.argsort(deep.astype(np.uint16) if len(deep) and deep.max() < 65536 else deep, kind="stable")
        self.end, self.piece, self.length, deep = end[order], piece[order], length[order], deep[order]
        self.start = self.end - self.length
        self.levels = np.flatnonzero(np.diff(deep, prepend=-1))
        self.levels = np.append(self.levels, len(deep))
        self.group = np.flatnonzero(np.diff(self.end, prepend=-1) != 0)

    def _rounds(self):
        """Edge ranges of one depth, and where in each its nodes' edges begin."""
        at = np.searchsorted(self.group, self.levels)
        for a, b, g, h in zip(self.levels[:-1], self.levels[1:], at[:-1], at[1:], strict=True):
            yield a, b, self.group[g:h] - a

    def _bytes_at(self, edges: np.ndarray) -> list[bytes]:
        return [self.joined[s].encode("utf-8", "surrogatepass") for s in self.start[edges].tolist()]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Score (in UNITS) and piece count of each word's best path; of equal scores the longest last piece wins."""
        score, count = np.zeros(len(self.joined) + 2, np.int64), np.zeros(len(self.joined) + 2, np.int64)
        worth, longest = np.ones(len(self.end), np.int64), int(self.pieces.length.max()) + 1
        unknown = np.flatnonzero(self.piece < 0)
        worth[unknown] = [len(b) for b in self._bytes_at(unknown)]
        for a, b, groups in self._rounds():
            key = (score[self.start[a:b]] + self.pieces.score[self.piece[a:b]]) * longest + self.length[a:b]
            top = np.maximum.reduceat(key, groups)
            won = np.flatnonzero(key == np.repeat(top, np.diff(np.append(groups, b - a)))) + a
            score[self.end[won]] = score[self.start[won]] + self.pieces.score[self.piece[won]]
            count[self.end[won]] = count[self.start[won]] + worth[won]
        return score[self.last], count[self.last]

    def weigh(self, sharpness: float) -> None:
        """Forward filtering: the probability of each edge given that the path reaches its end.

        Kept as whole numbers of 2 ** -38, whose running sum is exact: what a node draws from depends on its word alone.
        """
        log = self.pieces.score * (sharpness / UNITS)
        alpha = np.zeros(len(self.joined) + 2)
        share = np.empty(len(self.end))
        for a, b, groups in self._rounds():
            value = alpha[self.start[a:b]] + log[self.piece[a:b]]
            total = np.logaddexp.reduceat(value, groups)
            alpha[self.end[a:b][groups]] = total
            share[a:b] = np.exp(value - np.repeat(total, np.diff(np.append(groups, b - a))))
        self.sums = np.cumsum((share * 2.0**38).astype(np.int64))
        self.rank = np.zeros(len(self.joined) + 2, np.int32)
        self.rank[self.end[self.group]] = np.arange(len(self.group))
        self.bounds = np.append(self.group, len(self.end))

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: piece ids of one path for each occurrence, and each one's number of ids.

        words: the word of each occurrence; seeds: 64 bits each, which alone decide its path.
        """
        node, active, steps = self.last[words], np.arange(len(words)), []
        while len(active):
            with np.errstate(over="ignore"):
                x = (seeds[active] + np.uint64(len(steps) + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
            u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
            rank = self.rank[node]
            edge, high = self.bounds[rank], self.bounds[rank + 1] - 1
            before = np.where(edge > 0, self.sums[edge - 1], 0)
            aim = before + (u * (self.sums[high] - before)).astype(np.int64)
            for _ in range(int((high - edge).max()).bit_length()):  # the first edge of the node whose running sum is beyond aim
                middle = (edge + high) >> 1
                below = self.sums[middle] <= aim
                edge, high = np.where(below & (edge < high), middle + 1, edge), np.where(below, high, middle)
            steps.append((active, edge))
            node = self.start[edge]
            more = node > self.base[words[active]]
            active, node = active[more], node[more]
        n = np.zeros(len(words), np.int64)
        for own, _ in steps:
            n[own] += 1
        first = np.cumsum(n) - n
        edges = np.empty(n.sum(), np.int64)
        for k, (own, edge) in enumerate(steps):
            edges[first[own] + n[own] - 1 - k] = edge
        ids = self.piece[edges]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            raw = self._bytes_at(edges[unknown])
            wide = np.ones(len(ids), np.int64)
            wide[unknown] = [len(b) for b in raw]
            place = np.cumsum(wide) - wide
            grown = np.repeat(ids, wide)
            for at, b in zip(place[unknown].tolist(), raw, strict=True):
                grown[at : at + len(b)] = self.pieces.byte[np.frombuffer(b, np.uint8)]
            n = np.add.reduceat(wide, first) if len(first) else n
            ids = grown
        return ids, n


def decode(own: Pieces, ids: np.ndarray) -> str:
    """The text whose pieces these are; the first piece's space was added."""
    return b"".join([own.text[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]
