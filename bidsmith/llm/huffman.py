"""Canonical length-limited Huffman codes of token ids, and their block format.

`lengths` finds optimal code lengths of at most LIMIT bits by package-merge; codes are canonical
(ordered by length, then id), so the lengths alone restore them. A block holds whole
documents and can be decoded without any other block:

    "TIDB", version, tokens, documents, checkpoint interval     4 bytes, 4 little-endian uint32
    document ids, with a flag for null                          int64 and uint8 each
    tokens of each document                                     uint32 each
    bit offset of every INTERVAL-th token                       uint64 each
    the codes, most significant bit first, then 8 zero bytes

Decoding looks the next LIMIT bits up in a table; all stretches between checkpoints, of all
blocks at hand, take each step together.
"""

from __future__ import annotations

import numpy as np

LIMIT, INTERVAL = 16, 256


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id (0: no code) by package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids cannot have codes of at most {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        row = both[order]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, size = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        size[:n] += 1
        take = 2 * (take - n)
    out[used] = size
    return out


class Code:
    """Codes by id, and the decoding table, from code lengths."""

    def __init__(self, size: np.ndarray):
        self.size = size.astype(np.uint64)
        order = np.lexsort((np.arange(len(size)), size))
        order = order[size[order] > 0]
        self.codes = np.zeros(len(size), np.uint64)
        self.table = np.zeros(1 << LIMIT, np.uint32)  # for each next LIMIT bits: the id, and in the low 5 bits its length
        if len(order):
            spans = np.uint64(1) << (np.uint64(LIMIT) - self.size[order])
            begin = np.cumsum(spans) - spans
            self.codes[order] = begin >> (np.uint64(LIMIT) - self.size[order])
            self.table[: int(spans.sum())] = np.repeat(order << 5 | size[order], spans.astype(np.int64))

    def pack(self, documents: list[tuple[int | None, np.ndarray]]) -> bytes:
        """A block of whole documents: (id, token ids)."""
        ids = np.concatenate([x for _, x in documents]) if documents else np.empty(0, np.int64)
        # four codes of at most 16 bits make one of at most 64; the last are filled up with empty ones
        size, codes = (np.append(x[ids], np.zeros(-len(ids) % 4, np.uint64)) for x in (self.size, self.codes))
        if len(ids) and not size[: len(ids)].all():
            raise ValueError("an id without a code")
        for _ in range(2):
            codes, size = codes[::2] << size[1::2] | codes[1::2], size[::2] + size[1::2]
        ends = np.cumsum(size)
        begin = ends - size
        words = np.zeros(int(ends[-1] // 64 + 2 if len(ids) else 2), np.uint64)
        if len(ids):
            word, room = begin >> np.uint64(6), np.uint64(64) - (begin & np.uint64(63))
            spare = room.astype(np.int64) - size.astype(np.int64)
            here = np.where(spare >= 0, codes << np.maximum(spare, 0).astype(np.uint64), codes >> np.maximum(-spare, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word.astype(np.int64), prepend=-1))
            words[word[first]] = np.bitwise_or.reduceat(here, first)
            over = np.flatnonzero(spare < 0)
            words[word[over] + np.uint64(1)] |= codes[over] << (64 + spare[over]).astype(np.uint64)
        head = np.array([1, len(ids), len(documents), INTERVAL], "<u4").tobytes()
        names = np.array([0 if d is None else d for d, _ in documents], "<i8").tobytes() + np.array([d is None for d, _ in documents], np.uint8).tobytes()
        return b"TIDB" + head + names + np.array([len(x) for _, x in documents], "<u4").tobytes() + begin[:: INTERVAL // 4].astype("<u8").tobytes() + words.astype(">u8").tobytes()

    def unpack(self, blocks: list[bytes]) -> list[list[tuple[int | None, np.ndarray]]]:
        """The documents of each block."""
        parts, lanes, left, shift, heads = [], [], [], 0, []
        for b in blocks:
            if b[:4] != b"TIDB":
                raise ValueError("not a block of token ids")
            version, n, m, every = np.frombuffer(b, "<u4", 4, 4).tolist()
            if version != 1:
                raise ValueError(f"unknown version {version}")
            names, at = np.frombuffer(b, "<i8", m, 20), 20 + 8 * m
            null, at = np.frombuffer(b, np.uint8, m, at), at + m
            sizes, at = np.frombuffer(b, "<u4", m, at), at + 4 * m
            marks, at = np.frombuffer(b, "<u8", -(-n // every), at), at + 8 * -(-n // every)
            parts.append(np.frombuffer(b, np.uint8, -1, at))
            lanes.append(marks.astype(np.int64) + 8 * shift)
            left.append(np.minimum(every, n - every * np.arange(len(marks))))
            shift += len(parts[-1])
            heads.append((names, null, sizes, n, len(marks), every))
        out: list[list] = []
        if not heads:
            return out
        data = np.concatenate([*parts, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        place, left = np.concatenate(lanes), np.concatenate(left)
        most = int(left.max()) if len(left) else 0
        found = np.zeros((most, len(place)), np.uint32)
        short = bool((left < most).any())
        for k in range(most):
            bits = window[place >> 3] >> (16 - (place & 7)).astype(np.uint32) & 0xFFFF
            found[k] = self.table[bits]
            place += found[k] & 31
            if short:
                place = np.minimum(place, 8 * (len(window) - 1))
        found = np.ascontiguousarray((found >> 5).T)
        lane = 0
        for names, null, sizes, n, k, every in heads:
            ids = found[lane : lane + k, :every].ravel()[:n] if every <= most else found[lane : lane + k].ravel()[:n]
            lane += k
            ends = np.cumsum(sizes.astype(np.int64))
            out.append([(None if z else int(i), ids[e - s : e]) for i, z, s, e in zip(names, null, sizes.astype(np.int64), ends, strict=True)])
        return out
