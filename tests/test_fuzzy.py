"""Alike names against all pairs, and flags and nearest facts against nested loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidsmith.operators import fuzzy, joins


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(seed, n):
    """Families of texts a few edits apart, with much in common between families."""
    draw, out = random.Random(seed), {"", "a", "b", "ab", "é", "日本語の会社名です"}
    for _ in range(n):
        base = "".join(draw.choice("ab ") for _ in range(draw.randint(1, 8))) + draw.choice(["", " holdings", " inc", "company limited"])
        for _ in range(3):
            t = list(base)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(t) + 1)
                t[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "aé", "b"])
            out.add("".join(t))
    return sorted(out)


@pytest.mark.parametrize(("least", "hot"), [(61, 1000), (75, 1000), (85, 3), (90, 1000), (100, 2)])
def test_alike_is_complete(spark, monkeypatch, least, hot):
    monkeypatch.setattr(fuzzy, "HOT", hot)
    xs, ys = texts(least, 25), texts(least, 20) + texts(3, 10)
    ys = sorted(set(ys))
    got = {(r.x, r.y): r.ratio for r in fuzzy.alike(spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string"), least).collect()}
    want = {}
    for x in filter(None, xs):
        for y in filter(None, ys):
            ratio = int(100 * (1 - edits(x, y) / max(len(x), len(y))) // 1)
            if ratio >= least:
                want[x, y] = ratio
    assert got == want


@pytest.mark.parametrize("hot", [1, 5])
def test_numbered_names_are_looked_up_by_rests(spark, monkeypatch, hot):
    """Names of one form share long segments: the pairs compared must stay few, and none may be lost."""
    monkeypatch.setattr(fuzzy, "HOT", hot)
    ys = sorted({f"firm #0000{i:03d}" for i in range(0, 900, 13)} | {f"firm #0000{i:03d} ltd" for i in range(0, 900, 29)} | {"", "aab", "aba", "ééé"})
    xs = sorted({f"firm # 0000{i:03d}" for i in range(0, 900, 17)} | {f"xirm #0000{i:03d}a" for i in range(0, 900, 19)} | {f"xfirm #00{i:03d} lld" for i in range(0, 900, 31)} | {"", "ab", "aaba", "éé"})
    df = fuzzy.alike(spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string"), 85)
    got = {(r.x, r.y): r.ratio for r in df.collect()}
    ratios = {(x, y): int(100 * (1 - edits(x, y) / max(len(x), len(y))) // 1) for x in xs for y in ys if x and y}
    assert got == {p: r for p, r in ratios.items() if r >= 85}
    own = spark.createDataFrame([("aabb",), ("abab",), ("é",)], "x string")
    rests = {r.x: r.h for r in own.select("x", fuzzy._rests("x", "2").alias("h")).collect()}
    want = lambda *v: sorted(h for (h,) in spark.createDataFrame([(x,) for x in v], "v string").select(F.xxhash64("v")).collect())
    assert sorted(rests["aabb"]) == want("aa", "ab", "bb") and sorted(rests["abab"]) == want("ab", "aa", "bb", "ba")


def test_alike_names_keep_rows(spark):
    names = spark.createDataFrame([(1, "ACME Optics"), (2, "acme optics"), (3, None), (4, ""), (5, "Zcme Optics")], "i int, name string")
    firms = spark.createDataFrame([(0, "Acme Optics", "A"), (1, None, "N"), (2, "ACME OPTICS", "B")], "ordinal int, company string, ticker string")
    got = sorted((r.i, r.ticker, r.ratio) for r in fuzzy.alike_names(names, "name", firms, 85).collect())
    assert got == [(1, "A", 100), (1, "B", 100), (2, "A", 100), (2, "B", 100), (5, "A", 90), (5, "B", 90)]
    with pytest.raises(ValueError):
        fuzzy.alike_names(names, "name", firms, 50)


def test_flags_and_nearest_facts(spark):
    draw, start = random.Random(5), dt.datetime(2023, 12, 1, 7)
    when = lambda: start + dt.timedelta(hours=draw.randint(0, 24 * 200))
    left = [(i, draw.choice([1, 1, 1, 2, None]), when()) for i in range(150)] + [(150, 1, None)]
    facts = [(draw.choice([1, 2, 3, None]), draw.choice([when(), None]), draw.choice("xyz")) for _ in range(120)]
    a, b = spark.createDataFrame(left, "i int, k int, at timestamp"), spark.createDataFrame(facts, "k int, then timestamp, kind string")

    def hits(k, at, low, high, kind="xyz"):
        return sorted(f.date() for key, f, t in facts if key == k and key is not None and f and at and t in kind and low <= (f.date() - at.date()).days <= high)

    flags = joins.having(a, b, "k", "at", "then", {"x_7": (F.col("kind") == "x", 7), "any_60": (F.lit(True), 60), "y_0": (F.col("kind") == "y", 0)})
    assert flags.columns == [*a.columns, "x_7", "any_60", "y_0"]
    assert {r.i: (r.x_7, r.any_60, r.y_0) for r in flags.collect()} == {i: (bool(hits(k, at, -7, 0, "x")), bool(hits(k, at, -60, 0)), bool(hits(k, at, 0, 0, "y"))) for i, k, at in left}
    for after, low, high in ((False, -9, 0), (True, 0, 9)):
        near = {i for i, k, at in left if hits(k, at, low, high)}
        assert {r.i for r in joins.recent(a, b, "k", "at", "then", 9, after).collect()} == near
        assert {r.i for r in joins.not_recent(a, b, "k", "at", "then", 9, after).collect()} == {i for i, *_ in left} - near
    band = joins.earliest_in_band(a, b, "k", "at", "then", 3, 40, "first")
    assert {r.i: r["first"] for r in band.collect()} == {i: min(hits(k, at, -3, 40), default=None) for i, k, at in left}


def test_held_by_whole_names_where_parts_are_common(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 2)
    short, long = ["abc 1", "abc 12", "bc", "é", "zz", "abc", ""], [f"the abc {i} é" for i in range(30)] + ["abc 1", "", "abcabc"]
    side = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = sorted(map(tuple, joins.held(side(short, "s"), side(long, "l")).collect()))
    assert got == sorted((s, x) for s in short for x in long if s and x and s in x)


def test_names_found_are_not_sought_again(spark, monkeypatch):
    """A name that is a company's own, or a part of one, is not compared by edits."""
    sought, real = [], joins.alike_names
    monkeypatch.setattr(joins, "alike_names", lambda names, *a: sought.extend(r[0] for r in names.collect()) or real(names, *a))
    awards = spark.createDataFrame([(1, "ACME OPTICS", "", None), (2, "Acme Optics Holdings", "", None), (3, "Acme Optica", "Acme Optics", None)], "id int, name string, parent string, cage_code string")
    firms = spark.createDataFrame([(0, "Acme Optics", "A", 1), (1, "Acme Opticz", "B", 2)], "ordinal int, company string, ticker string, cik int")
    empty = lambda s: spark.createDataFrame([], s)
    out = joins.resolved(awards, "id", "name", "parent", firms, empty("cage string, lei string"), empty("lei string, ticker string"), empty("ticker string, market_cap double"))
    assert sorted((r.id, r.resolved_ticker, r.evidence_type) for r in out.collect()) == [(1, "A", "exact"), (2, "A", "substring"), (3, "A", "fuzzy_90")]
    assert sought == ["Acme Optica"]
