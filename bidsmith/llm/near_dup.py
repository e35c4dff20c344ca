"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

The forest keeps TREES orders of the same signature, each starting at another place. In
each order documents that share the first DEPTH values are a region. A small region (at
most SMALL members) gives all its pairs. A larger region is sorted by the deeper values, and
each document is paired with its neighbours of longest common prefix, whatever the depth at
which that region thins out; it is also paired with the region's centre, the document whose
signature values are the most frequent, which catches copies that are alike only through
their original. Pairs whose signatures estimate a similarity more than five standard
deviations under the threshold are left; all others are confirmed on the full sets, in
two rounds: first each document's best partner, then the pairs that still join two
different components. Then no pair of a large region is left out: where such a region still
holds more than one component, its members' full sets are joined on the rarest part of each set,
which two sets alike enough must share (see `shared_prefixes`), and new pairs are confirmed too.
A pair of similarity 0.85 shares no region in any tree with probability
(1 - 0.85 ** 4) ** 20 = 4e-7, and its signatures agree too little with probability 8e-6.

Documents with equal sets are one class first, so exact copies cost one row each.

Defined results: null and wordless texts have no shingles and are linked with nothing; fewer
than five words are one shingle; a null doc_id is its own component (null) and kept; rows
that repeat a doc_id are one node; an empty table gives no rows; of members that could be a region's centre, and of partners equally
alike, the smallest doc_id is taken (this orders the work and changes no result); very long texts are signed and compared
whole; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import annotate, cut, discard, hot_join, partitions, small_batches
from bidsmith.llm.graph import components
from bidsmith.llm.text import shingle_sets

TREES, DEPTH, SMALL, NEAR, POSTED, WAYS = 20, 4, 8, 2, 256, 16
SIZE = TREES * DEPTH
BATCH = 2_000_000
_DRAWN = np.random.default_rng(20240229)
_A = _DRAWN.integers(1, 2**32, SIZE, dtype=np.uint32) | np.uint32(1)
_B = _DRAWN.integers(0, 2**32, SIZE, dtype=np.uint32)


def signatures(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two digests of each set (64 bits each), and MinHash values (0 where the set is empty)."""
    sets, begin = shingle_sets(texts, width)
    n = np.diff(begin)
    full = np.flatnonzero(n)
    sig = np.zeros((len(n), SIZE), np.uint32)
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        at = begin[:-1][full]
        with np.errstate(over="ignore"):
            one[full] = np.add.reduceat(sets, at)
            two[full] = np.add.reduceat((sets ^ (sets >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F), at)
            short = (sets >> np.uint64(32)).astype(np.uint32)
            for k in range(SIZE):
                sig[full, k] = np.minimum.reduceat(short * _A[k] + _B[k], at)
    return n, one, two, sig


def regions(sig: np.ndarray) -> np.ndarray:
    """A key for each row and tree: tree and the DEPTH values its order starts with."""
    out = np.empty((len(sig), TREES), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(TREES):
            h = np.full(len(sig), t + 1, np.uint64)
            for k in range(DEPTH):
                h = (h ^ sig[:, t * DEPTH + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, t] = h
    return out.view(np.int64)


def _sign(texts: list[str | None], width: int) -> dict:
    n, one, two, sig = signatures(texts, width)
    return {"n_shingles": n, "one": one.view(np.int64), "two": two.view(np.int64), "keys": [k if m else None for k, m in zip(regions(sig), n, strict=True)], "sig": [x.tobytes() for x in sig.astype(">u4")]}


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by region and deeper values: pairs of rows next to each other in a region."""
    last: list[tuple[int, int]] = []
    for pdf in frames:
        a, b = [], []
        for key, doc in zip(pdf["key"].tolist(), pdf["doc"].tolist(), strict=True):
            for k, other in last:
                if k == key:
                    a.append(doc)
                    b.append(other)
            last = [*last[-NEAR + 1 :], (key, doc)]
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _agreement(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        if len(pdf):
            x, y = (np.frombuffer(b"".join(pdf[c]), ">u4").reshape(-1, SIZE) for c in ("sig_a", "sig_b"))
            share = (x == y).mean(axis=1)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "share": share})[share >= least]


def _confirm(frames: Iterator[pd.DataFrame], percent: int, width: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for start in range(0, len(pdf), 128):
            part = pdf.iloc[start : start + 128]
            x, bx = shingle_sets(part["text_a"].tolist(), width)
            y, by = shingle_sets(part["text_b"].tolist(), width)
            keep = []
            for i in range(len(part)):
                p, q = x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield part.loc[keep, ["a", "b"]]


def shared_regions(classes: DataFrame) -> DataFrame:
    """doc, tree, key and count of every region of more than one class. classes: doc, keys, sig; one row a class."""
    entries = classes.select("doc", F.posexplode("keys").alias("tree", "key"))
    sizes = entries.groupBy("key").count().where("count > 1")
    return cut(hot_join(entries, sizes.withColumn("often", F.col("count")), ["key"], "often"), "regions")


def candidates(classes: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """Pairs (a > b) of classes that are neighbours in the forest, with the share of equal signature values."""
    small = active.where(F.col("count") <= SMALL).select("key", "doc")
    pairs = small.select("key", F.col("doc").alias("a")).join(small.select("key", F.col("doc").alias("b")), "key").where("a > b").select("a", "b").distinct()
    large = active.where(F.col("count") > SMALL)
    members = cut(large.select("doc").distinct().join(classes.select("doc", "sig"), "doc"), "members")
    values = members.select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.substring(F.col("sig"), i * 4 + 1, F.lit(4)))).alias("place", "value"))
    often = values.groupBy("place", "value").count()
    weight = hot_join(values, often.withColumn("often", F.col("count")), ["place", "value"], "often").groupBy("doc").agg(F.sum("count").alias("weight"))
    placed = cut(large.join(members.join(weight, "doc"), "doc").select("key", "doc", "weight", F.concat(F.expr("substring(sig, tree * 16 + 1)"), F.expr("substring(sig, 1, tree * 16)")).alias("order")), "placed")
    centre = placed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("less"))).alias("c"), F.count("*").alias("often")).select("key", (-F.col("c.less")).alias("b"), "often")
    star = hot_join(placed.select("key", F.col("doc").alias("a")), centre, ["key"], "often").where("a <> b").select("a", "b")
    deep = placed.select("key", "doc", F.substring("order", 1, 64).alias("order"))
    beside = deep.repartitionByRange(partitions(classes.sparkSession), "key", "order", "doc").sortWithinPartitions("key", "order", "doc").mapInPandas(_neighbours, "a bigint, b bigint")
    found = pairs.union(star).union(beside).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return agreeing(found, classes, least)


def agreeing(found: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least that share of values."""
    sig = classes.select(F.col("doc"), "sig")
    both = found.hint("merge").join(sig.toDF("a", "sig_a"), "a").hint("merge").join(sig.toDF("b", "sig_b"), "b")
    return both.mapInPandas(lambda frames: _agreement(frames, least), "a bigint, b bigint, share double")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    both = pairs.select("a", "b").hint("merge").join(texts.toDF("a", "text_a"), "a").hint("merge").join(texts.toDF("b", "text_b"), "b")
    return both.mapInPandas(lambda frames: _confirm(frames, percent, width), "a bigint, b bigint")


def divided(active: DataFrame, roots: DataFrame) -> DataFrame:
    """doc and root of the members of large regions that hold more than one component."""
    rooted = active.where(F.col("count") > SMALL).select("key", "doc").join(roots.toDF("doc", "root"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("often")).where("x < y").select("key", "often")
    return hot_join(rooted, several, ["key"], "often").select("doc", "root").distinct()


def shared_prefixes(members: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a > b) of different roots whose sets may be alike enough; no pair that is alike enough is left out.

    members: doc, root, text. Shingles are ordered by how many members have them, those of one
    root first. Sets of similarity percent share all but a few shingles, so their first common
    one lies among the first n - ceil(percent * n / 100) + 1 of either, with enough of both sets
    after it: `after` of a set's shingles allow partners of at most `most` shingles. So the smaller
    set of a pair has a first common shingle with most >= n (it leads), which most entries haven't;
    of a shingle's list, only members that some leader's size allows are compared, leaders with all.
    Leaders and all are dealt into blocks of about POSTED, at most WAYS of either, and each pair of
    blocks is a group of its own: the rows dealt are at most WAYS times the entries, however long a list is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), 128):
                part = pdf.iloc[start : start + 128]
                sets, begin = shingle_sets(part["text"].tolist(), width)
                n = np.diff(begin)
                yield pd.DataFrame({"doc": np.repeat(part["doc"].to_numpy(), n), "root": np.repeat(part["root"].to_numpy(), n), "n": np.repeat(n, n), "shingle": sets.view(np.int64)})

    # lists of one root are joined too and left after it: hot_join spreads only keys that both sides have
    across = [F.count("*").alias("often"), F.min("root").alias("x"), F.max("root").alias("y")]
    entries = cut(members.mapInPandas(run, "doc bigint, root bigint, n bigint, shingle bigint"), "entries")
    often = entries.groupBy("shingle").agg(*across).where("often > 1").withColumn("c", F.col("often"))
    ranked = hot_join(entries, often, ["shingle"], "often").where("x < y").groupBy("doc", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("own"))
    some = F.greatest(F.lit(0), F.expr(f"size(own) - ({percent} * n + 99) div 100 + 1")).cast("int")
    first = ranked.select("doc", "root", "n", F.size("own").alias("all"), F.posexplode(F.slice("own", F.lit(1), some)).alias("k", "s"))
    first = cut(first.select("doc", "root", "n", F.expr(f"{100 + percent} * (all - k) div {percent} - n").alias("most"), "s.shingle"), "prefixes", entries)
    leads = F.col("most") >= F.col("n")
    sizes = first.groupBy("shingle").agg(*across, F.min(F.when(leads, F.col("n"))).alias("low"), F.max(F.when(leads, F.col("most"))).alias("high")).where("often > 1")
    met = cut(hot_join(first, sizes, ["shingle"], "often").where("x < y and n <= high and most >= low").select(*first.columns), "met", first)
    blocks = lambda count: F.least(F.lit(WAYS), F.ceil(count / POSTED)).cast("int")
    lists = met.groupBy("shingle").agg(*across, blocks(F.count(F.when(leads, 1))).alias("i_of"), blocks(F.count("*")).alias("j_of")).where("often > 1")
    dealt = hot_join(met, lists, ["shingle"], "often").where("x < y")
    block = lambda of: F.pmod(F.xxhash64("doc"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a = dealt.where(leads).select("shingle", block("i_of").alias("i"), every("j_of").alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("doc", "root", "n", "most")))
    b = dealt.select("shingle", every("i_of").alias("i"), block("j_of").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("doc", "root", "n", "most")))
    enough = "(n_a < n_b or n_a = n_b and doc_a < doc_b) and root_a <> root_b and n_b <= most_a and n_a <= most_b"
    both = a.hint("merge").join(b, ["shingle", "i", "j"]).where(enough)
    return both.select(F.greatest("doc_a", "doc_b").alias("a"), F.least("doc_a", "doc_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked where 100 * intersection >= percent * union of their distinct
    width-word shingles; component_id is the smallest doc_id reachable over links.
    """
    small_batches(docs.sparkSession)
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SIZE) ** 0.5
    docs = docs.select("doc_id", "text")
    signed = cut(annotate(docs, lambda texts, _: _sign(texts, width), "n_shingles bigint, one bigint, two bigint, keys array<bigint>, sig binary", ["doc_id"], BATCH), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "one", "two"]
    classed = cut(known.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.count("*").alias("often")), "classes")
    # by doc_id: a join by class alone would bring all copies of a text together
    classes = known.select("doc_id", *same, "keys", "sig").join(classed.select(*same, F.col("doc").alias("doc_id")), ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("doc"), "keys", "sig")
    regions_of = shared_regions(classes)
    pairs = cut(candidates(classes, regions_of, least), "pairs")
    ends = pairs.select("a", "b", "share").union(pairs.select("b", "a", "share")).toDF("a", "b", "share")
    active = ends.select(F.col("a").alias("doc_id")).distinct()
    texts = cut(docs.join(active.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    best = ends.groupBy("a").agg(F.max(F.struct("share", (-F.col("b")).alias("less"))).alias("x")).select(F.col("a"), (-F.col("x.less")).alias("b"))
    best = best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = cut(confirmed(best, texts, percent, width), "links")
    roots = components(first)
    root = lambda c: roots.toDF(c, f"root_{c}")
    apart = pairs.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = confirmed(apart.join(best, ["a", "b"], "left_anti"), texts, percent, width)
    roots = components(first.union(cut(second, "links")))
    members = cut(divided(regions_of, roots), "members", first)
    if not members.isEmpty():
        whole = cut(docs.join(members.hint("merge").withColumnRenamed("doc", "doc_id"), "doc_id").groupBy(F.col("doc_id").alias("doc"), "root").agg(F.min("text").alias("text")), "texts")
        left = shared_prefixes(whole, percent, width).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        alike = cut(agreeing(left, classes, least), "pairs")
        third = cut(confirmed(alike, whole.select("doc", "text"), percent, width), "links", alike, whole)
        if not third.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third))
        discard(third)
    discard(members, regions_of, pairs, texts)
    named = classed.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(*same, F.coalesce("root", "doc").alias("component_id"), "often")
    out = hot_join(known.select("doc_id", *same), named, same, "often")
    out = out.unionByName(signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", *same), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the documents that aren't the smallest of their group, columns unchanged."""
    gone = near_duplicates(docs, percent, width).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
