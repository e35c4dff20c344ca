"""Greedy clusters in rounds against the loop over a group, chains of items that wait for one another, and large groups."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from bidsmith.functions.sequences import greedy_clusters
from bidsmith.operators import greedy, memory


def flipped(draw, h, n):
    for k in draw.sample(range(64), n):
        h ^= 1 << k
    return h


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_hash_clusters_equal_the_loop(spark):
    draw, rows = random.Random(2), []
    for g in (1, 2, 3, None):
        seeds = [draw.getrandbits(64) for _ in range(6)]
        for i in range(80):
            rows.append((g, i, signed(flipped(draw, draw.choice(seeds), draw.randint(0, 4)))))
    rows += [(9, i, signed((1 << (2 * i)) - 1)) for i in range(20)]  # each within 2 bits of the next: a chain
    got = greedy.simhash_clusters(spark.createDataFrame(rows, "g int, turn int, h bigint"), "g", "turn", "h").collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((t, h) for k, t, h in rows if k == g)
        want |= {(g, t): c for (t, _), c in zip(own, greedy_clusters([h for _, h in own]), strict=True)}
    assert {(r.g, r.turn): r.cluster for r in got} == want and len(got) == len(rows)


def merged_by_loop(rows, least):
    out = []
    for g in {r[0] for r in rows}:
        heads, groups = [], []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            words = set((r[2] or "").lower().split())
            k = next((k for k, h in enumerate(heads) if words and h and len(words & h) / len(words | h) > least), len(heads))
            if k == len(heads):
                heads.append(words)
                groups.append([])
            groups[k].append(r)
        for own in groups:
            best = max(own, key=lambda r: r[3])
            out.append((g, best[1], best[3], max(r[4] for r in own), tuple(sorted({x for r in own for x in (r[5] or ())})), len(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0.5, 0.6, 0.85])
def test_merged_equals_the_loop(spark, least):
    draw, rows = random.Random(int(least * 100)), []
    for g in range(3):
        for i in range(70):
            base = draw.choice(["a b c d e f g h", "a b c d x y", "one two three four five six seven", ""])
            words = [w for w in base.split() if draw.random() > 0.15] + draw.sample(["q", "r", "s"], draw.randint(0, 1))
            rows.append((g, i, draw.choice([" ".join(words), " ".join(words).upper(), None if not words else "  ".join(words)]), draw.randint(0, 3) / 2, draw.randint(0, 9), draw.choice([None, ["u"], ["v", "u"]])))
    df = spark.createDataFrame(rows, "g int, n int, t string, w double, c bigint, e array<string>")
    got = [(r.g, r.n, r.w, r.c, tuple(r.e), r.n_merged) for r in memory.merged(df, "g", "n", "t", "w", "c", "e", least).collect()]
    assert sorted(got, key=str) == merged_by_loop(rows, least)


def test_a_group_of_a_hundred_thousand(spark):
    """One group, 2,000 seeds with 50 members each within 2 bits; as many clusters as a loop over them finds."""
    draw = random.Random(6)
    seeds = [draw.getrandbits(64) for _ in range(2000)]
    hashes = [flipped(draw, draw.choice(seeds), draw.randint(0, 1)) for _ in range(100_000)]
    df = spark.createDataFrame([(1, i, signed(h)) for i, h in enumerate(hashes)], "g int, turn int, h bigint").repartition(8)
    began = time.time()
    got = {r.turn: r.cluster for r in greedy.simhash_clusters(df, "g", "turn", "h").select("turn", "cluster").collect()}
    assert time.time() - began < 240
    heads: dict[int, list] = {}
    blocks, number = [{} for _ in range(4)], []
    for i, h in enumerate(hashes):  # the loop, with the same blocks so that it ends
        near = {j for k in range(4) for j in blocks[k].get(h >> 16 * k & 0xFFFF, ()) if (hashes[j] ^ h).bit_count() <= 3}
        if near:
            number.append(number[min(near)])
        else:
            number.append(len(heads))
            heads[i] = []
            for k in range(4):
                blocks[k].setdefault(h >> 16 * k & 0xFFFF, []).append(i)
    assert [got[i] for i in range(len(hashes))] == number


def test_no_links(spark):
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, ""), (1, 2, None), (2, 0, "c")], "g int, n int, t string").select("*", F.lit(0.5).alias("w"), F.lit(1).cast("bigint").alias("c"), F.array(F.lit("x")).alias("e"))
    assert memory.merged(df, "g", "n", "t", "w", "c", "e").count() == 4


def test_words_are_joined_without_their_sets(spark, monkeypatch):
    """A row a word must not carry the whole set: what is written for the join would grow with the square of a text's length."""
    from bidsmith.operators import greedy

    written, real = {}, greedy.settled
    monkeypatch.setattr(greedy, "settled", lambda df, name: written.setdefault(name, df) and real(df, name))
    base = [f"w{i}" for i in range(40)]
    rows = [(1, 0, base), (1, 1, base[1:]), (1, 2, [*base[:30], "x"]), (None, 3, base), (None, 4, [*base, "y"]), (2, 5, base), (2, 6, [])]
    items = spark.createDataFrame(rows, "g int, o int, words array<string>")
    got = sorted((str(r.g), r.earlier, r.later) for r in greedy.alike_sets(items, "g", "o", "words", 0.85).collect())
    assert got == [("1", 0, 1), ("None", 3, 4)]
    assert "array" not in str(written["rare"].schema).lower()
