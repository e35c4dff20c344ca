"""Importance resampling against plain Python, for several orders."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from bidsmith.llm import queries, resampling


def features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)


def by_hand(docs, target, order, buckets, percent, least, seed):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, order)[0])

    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        own, n = features(text, order)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    rank = {r: k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], rank.get(r)) for r in rows]


def shown(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_python(spark, sf_dir, order):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resampling.resample(docs, target, order=order, buckets=997, percent=30, least_words=40, seed=7)
    want = by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in target.select("item_id", "text").collect()], order, 997, 30, 40, 7)
    assert shown(map(tuple, got.collect())) == shown(want)


def test_query_draws_a_tenth(spark, sf_dir):
    rows = queries.op13_importance_resampling(spark, sf_dir).collect()
    drawn = sorted(r.rank for r in rows if r.rank)
    fit = sum(r.n_features >= 20 for r in rows)
    assert drawn == list(range(1, fit // 10 + 1))
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_equal_scores_and_odd_letters(spark):
    texts = [(5, "Ä b Ä b"), (None, "É É"), (3, "x"), (9, "a_b-c\x00d"), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    target = spark.createDataFrame([(1, "b É"), (2, None)], "item_id bigint, text string")
    got = resampling.resample(docs, target, order=2, buckets=11, percent=100, least_words=1)
    assert shown(map(tuple, got.collect())) == shown(by_hand(texts, [(1, "b É"), (2, None)], 2, 11, 100, 1, 2024))
    twins = spark.createDataFrame([(4, "k l m")] * 3, "doc_id bigint, text string")
    assert sorted(r["rank"] for r in resampling.resample(twins, target, percent=100, least_words=1).collect()) == [1, 2, 3]
