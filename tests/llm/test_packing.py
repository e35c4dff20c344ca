"""Packing: every id in one piece, gapless sequences, fixed counts a class, and little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bidsmith.llm import packing, queries
from bidsmith.llm.queries import tokenizer

BPE = tokenizer("byte_bpe_50k.json")


def padding(rows, capacity):
    """Tokens of padding and of text; a sequence as long as a power of two has none."""
    filled = defaultdict(int)
    for r in rows:
        filled[r.sequence_id] += r.length
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in filled.values()), sum(filled.values())


def checked(rows, docs, capacity, end_id):
    own = Tokenizer.from_file(BPE)
    want = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, end_id], "<u4") for i, t in docs}
    assert {r.doc_id for r in rows} == set(want)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(want[i][r.start : at].tobytes())
        assert at == len(want[i])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    own_round = {k: v for k, v in sequences.items() if k < packing.LAST}
    for found in own_round.values():  # pieces of one size, as many as fit
        assert {n for _, n in found} == {found[0][1]} and len(found) == capacity // found[0][1]


def test_query_by_the_library(spark, sf_dir):
    rows = queries.op12_packing(spark, sf_dir).collect()
    checked(rows, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], 1024, 0)
    pad, tokens = padding(rows, 1024)
    assert pad < 0.01 * tokens


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_many_workers_and_capacities(spark, capacity):
    docs = [(i, " ".join(["word", "ünd", "x1"][j % 3] for j in range(i * 7 % 90))) for i in range(300)] + [(300, None), (301, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9)
    rows = packing.pack(table, BPE, 5, capacity).collect()
    checked(rows, docs, capacity, 5)
    pad, tokens = padding(rows, capacity)
    assert pad <= 0.12 * tokens


def test_class_sizes():
    size = packing.sizes(1024)
    assert list(size[:6]) == [1024, 512, 341, 256, 204, 170] and list(size[-3:]) == [3, 2, 1]
    for n in range(1, 3000):
        parts = packing.cut_lengths(n, size)
        assert sum(parts) == n and set(parts) <= set(size.tolist())
        assert len(parts) <= n // 1024 + 4
