"""Whole decisions against plain versions, and ties: rules as a conditional, document scores, equally similar windows, equal paths."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidsmith.llm import decontaminate, quality, queries, sampling, toxicity
from bidsmith.llm.queries import tokenizer


def test_verdict_is_the_rules_in_order(spark, sf_dir):
    """The conditional keeps what the base keeps and no rule covers, for learned rules and others."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.statistics(docs.select("doc_id", "text"))
    learned = quality.learn(quality.labelled(docs, labels, 10_000))
    names = list(quality.FIGURES)
    others = [quality.Rule(((names[0], True, 0.4), (names[1], False, 2.0))), quality.Rule(((names[-1], True, 0.2),)), quality.Rule(())]
    for rules in (learned, others[:2], others, []):
        rows = stats.select(quality.base_failed().alias("bad"), quality.verdict(rules).alias("kept"), *(F.expr(e).alias(n) for n, e in quality.FIGURES.items())).collect()
        for r in rows:
            row = {n: -math.inf if r[n] is None else r[n] for n in names}
            assert r.kept == (not r.bad and not any(rule.covers(row) for rule in rules))


def test_rules_of_equal_gain():
    """Two figures that say the same: the same rules each time."""
    draw, names = random.Random(3), list(quality.FIGURES)
    rows = []
    for _ in range(200):
        x = draw.random()
        rows.append(({n: x if n in names[:2] else 0.5 for n in names}, int(x < 0.6)))
    first = quality.learn(rows)
    assert first and all(f in names[:2] for r in first for f, _, _ in r.conditions)
    assert quality.learn(list(rows)) == first


@pytest.fixture(scope="module")
def machine():
    good = ["a fine day in the garden", "words of summer and rain", "reading books at home", "the table and the chair"] * 12
    return toxicity.train([*((t, 0) for t in good), *((t + " you idiot", 1) for t in good[:24]), *((t + " stupid moron", 1) for t in good[:24])], landmarks=20)


def test_document_score_is_the_logistic_of_its_two_worst_words(machine):
    texts = ["you idiot", "a moron and an idiot", "idiot idiot", "idiot", "fine words", "", None, "i d i o t here", "day day day"]
    a, b, c = machine.logistic
    for text, got in zip(texts, machine.score(pa.array(texts)), strict=True):
        names = toxicity.split(pa.array([text or ""]))
        own = sorted((max(toxicity.HARMLESS, machine.words([names[2][i]])[0]) for i in names[1].tolist()), reverse=True)
        one, two = ([*own, toxicity.HARMLESS, toxicity.HARMLESS])[:2]
        clip = lambda v: min(3.0, max(toxicity.HARMLESS, v))
        assert got == pytest.approx(1 / (1 + math.exp(-(a * clip(one) + b * clip(two) + c))), abs=1e-9)


def test_equal_worst_words(machine):
    """The same word twice is the worst and the second-worst; where it stands makes no difference."""
    pair = machine.score(pa.array(["idiot day idiot", "idiot idiot day", "day idiot idiot"]))
    assert pair[0] == pair[1] == pair[2] >= machine.score(pa.array(["idiot day"]))[0]


def test_equally_similar_windows(spark):
    """An item that a text holds twice is one leak, at its first place; two items with one text both leak."""
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{item} between {item}"), (2, item)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item), (6, item)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.leak_pairs(docs, bench).collect())
    assert got == [(1, 5, 1.0, 0), (1, 6, 1.0, 0), (2, 5, 1.0, 0), (2, 6, 1.0, 0)]


def test_equal_keys_draw_equal_paths(spark):
    """Rows of one key and text have the same sampled pieces, wherever they are, and other keys may have others."""
    text = "internationalization of representative considerations " * 5
    docs = spark.createDataFrame([(7, text)] * 3 + [(8, text), (9, "x " + text)], "doc_id bigint, text string").repartition(3)
    rows = sampling.digests(docs, tokenizer("piece_bpe_32k.model")).collect()
    assert all(r.lossless for r in rows)
    assert len({r.ids_crc32 for r in rows if r.doc_id == 7}) == 1
    assert len({r.ids_crc32 for r in rows}) >= 2
    assert "op10_sentencepiece_sampling" in queries.QUERIES
