"""The bit-sliced index against exhaustive scores in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from bidsmith.llm import impact_index as ix
from tests.llm.test_edges import TEXTS, table


def terms(text):
    return re.findall(ix.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, all_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c in held:
            m = 10 + (90 * c.total() * n) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(map(str, out))


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize(("block", "deal"), [(8192, 1), (16, 5), (3, 40), (1, 2)])
def test_search_by_hand(spark, sf_dir, block, deal):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    got = ix.ranked_search(docs.repartition(deal), items, 7, block)
    assert shown(got) == by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 7)


def test_ties_copies_and_edges(spark):
    texts = [*TEXTS, *((100 + i, "One copy, one LINE") for i in range(40)), (None, "one copy one line")]
    items = [(1, "one line"), (1, "one line"), (1, "Ünïcode"), (None, "words"), (2, None), (3, "--"), (4, "nothing_such zzzz")]
    docs, asked = table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (8192, 4):
        assert shown(ix.ranked_search(docs.repartition(3), asked, 10, block)) == by_hand(texts, items, 10)


def test_empty_tables(spark):
    docs, none = table(spark, TEXTS), spark.createDataFrame([], "item_id bigint, text string")
    assert ix.ranked_search(docs, none).collect() == []
    assert ix.ranked_search(table(spark, []), spark.createDataFrame([(1, "one")], "item_id bigint, text string")).collect() == []


def test_bitwise_arithmetic():
    draw = np.random.default_rng(3)
    values, weights = draw.integers(0, 1 << 20, 500), draw.integers(0, 30_000, 500)
    slices = [ix.packed((values >> s & 1).astype(np.uint8)) for s in range(20)]
    out = ix.multiplied(slices, weights)
    back = sum(np.unpackbits(x.view(np.uint8), bitorder="little")[:500].astype(np.int64) << s for s, x in enumerate(out))
    assert (back == values * weights).all()
    scores = draw.integers(0, 9, (6, 300))
    places = ix.best([ix.packed((scores >> s & 1).astype(np.uint8)) for s in range(4)], 12)
    for row, (at, found) in zip(scores, places, strict=True):
        want = sorted(range(300), key=lambda i: (-row[i], i))[:12]
        assert sorted(at.tolist()) == sorted(want) and (row[at] == found).all()


def test_terms_in_chunks(monkeypatch):
    """More terms than are taken at once give the same scores; long texts are cut between terms."""
    draw = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in draw.integers(0, 60, 30)) for _ in range(90)]
    hashes, places = ix.hashed(texts)
    row = ix.block_row(list(range(90)), hashes, places, 90, len(hashes))
    wanted = np.unique(hashes)
    items = [np.sort(draw.choice(len(wanted), 25, replace=False)) for _ in range(8)]
    weights = draw.integers(0, 9000, len(wanted))
    whole = ix.search_block(row, items, wanted, weights, 5)
    monkeypatch.setattr(ix, "TERMS", 7)
    for a, b in zip(whole, ix.search_block(row, items, wanted, weights, 5), strict=True):
        assert dict(zip(*map(np.ndarray.tolist, a), strict=True)) == dict(zip(*map(np.ndarray.tolist, b), strict=True))
    long = " ".join(f"wörd{i}" for i in range(5000))
    assert [t for p in ix.parted(long, 100) for t in terms(p)] == terms(long)
    assert ix.parted(None) == [""]
