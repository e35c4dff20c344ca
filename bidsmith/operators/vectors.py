"""Nearest vectors by cosine: inverted lists with product-quantised codes, and an exact way over the same index.

Vectors are scaled to length one, so that the nearest are those of the largest cosine. Centroids of lists and codebooks
are learned from a bounded sample; every vector is then filed under its nearest centroid, with a code of one byte a
subspace of what is left, its distance from the centroid, and itself. The index lies in a folder: `vectors`, `lists` (a row a
list: number, radius and size) and `model`.

`search` reads the codes of the lists nearest to a query (how many is measured on the sample), takes some times k of the best sums of table entries, and rescores them
exactly: fast, and right for most. `exact` then scores whatever could still be nearer than the k-th found: by the triangle
inequality lists whose sphere is too far are left out, and vectors whose distance from their centroid rules them out.

A list that is large is scored in parts of PART vectors, and its queries QUERIES at a time, so no group grows with the
tables. Null vectors, those without length and those of another dimension than most aren't indexed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidsmith.sources.sinks import settled

#: Vectors learned from at most; lists at most; vectors and queries of a group; subspaces.
SAMPLE, LISTS, PART, QUERIES, SUBSPACES = 20_000, 4096, 65_536, 4096, 16
#: Rows of (query, list) that a task holds at a time, and scores of a group.
ROWS, SCORES = 16_384, 2_000_000
#: Share of the nearest vectors that lie in the lists a search reads, as measured on the sample.
REACHED = 0.97


def unit(rows) -> np.ndarray:
    """Vectors of length one, as doubles."""
    x = np.array([np.asarray(v, np.float64) for v in rows])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x.reshape(0, 1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def centers(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k means of the rows; a mean without rows is moved to the row farthest from its own."""
    c = x[draw.permutation(len(x))[:k]]
    for _ in range(rounds):
        d = squares(x, c)
        at = d.argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = sums / np.maximum(n, 1)[:, None]
        far = np.argsort(-d.min(axis=1))[: int((n == 0).sum())]
        c[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return c


class Model:
    """Centroids of the lists, and a codebook for each stretch of dimensions."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.centroids = centers(sample, min(lists, len(sample)), draw)
        rest = sample - self.centroids[squares(sample, self.centroids).argmin(axis=1)]
        self.edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [centers(rest[:, a:b], min(256, len(sample)), draw) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

        # lists to read so that REACHED of the ten nearest of some of the sample lie in them
        at = squares(sample, self.centroids).argmin(axis=1)
        some = sample[:256]
        near = np.argsort(squares(some, sample), axis=1, kind="stable")[:, :10]
        place = np.argsort(np.argsort(squares(some, self.centroids), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
        self.probes = int(needed[max(0, int(np.ceil(REACHED * len(needed))) - 1)]) + 1

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, distance from its centroid, code) of each vector."""
        d = squares(x, self.centroids)
        at = d.argmin(axis=1)
        rest = x - self.centroids[at]
        code = np.stack([squares(rest[:, a:b], book).argmin(axis=1) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], axis=1).astype(np.uint8)
        return at, np.sqrt((rest * rest).sum(axis=1)), code

    def approximate(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries from a list's vectors, as their codes stand for them."""
        rest, out = queries - self.centroids[number], np.zeros((len(queries), len(codes)))
        for m, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            out += squares(rest[:, a:b], book)[:, codes[:, m]]
        return out


def build(vectors: DataFrame, ident: str, vector: str, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index. lists: how many, the root of the number of vectors by default; sample: how many vectors are learned from."""
    spark, v = vectors.sparkSession, F.col(vector)
    kind = vectors.schema[ident].dataType.simpleString()
    long = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0
    own = vectors.where(v.isNotNull() & long).select(F.col(ident).alias("ident"), v.cast("array<float>").alias("vector"), F.size(v).alias("_size"))
    sizes = own.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_size").first()
    if sizes is None:
        return
    own, n = own.where(F.col("_size") == sizes["_size"]).drop("_size"), sizes["n"]
    some = unit(r["vector"] for r in own.orderBy(F.xxhash64("ident"), "ident").limit(sample).collect())
    model = Model(some, min(LISTS, lists or max(1, round(n**0.5))))
    spark.createDataFrame([(bytearray(pickle.dumps(model)), kind)], "model binary, kind string").coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast(model)  # LISTS centroids and 256 codes a subspace at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, far, code = shared.value.filed(unit(f["vector"]))
            yield f.assign(list=at.astype("int32"), far=far, code=[c.tobytes() for c in code])

    filed = own.mapInPandas(run, f"ident {kind}, vector array<float>, list int, far double, code binary")
    filed.repartition("list").sortWithinPartitions("list").write.parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/lists")


class Index:
    """An index read from its folder."""

    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.parquet(f"{path}/model").first()
        self.kind, self.shared = row["kind"], spark.sparkContext.broadcast(pickle.loads(bytes(row["model"])))
        self.vectors = spark.read.schema(f"ident {self.kind}, vector array<float>, list int, far double, code binary").parquet(f"{path}/vectors")
        self.lists = {r["list"]: (r["radius"], r["n"]) for r in spark.read.parquet(f"{path}/lists").collect()}  # LISTS rows at most


def _dealt(index: Index, asked: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and (query, vector, list) rows, each with the part of its group."""
    parts = F.create_map(*(x for k, (_, n) in index.lists.items() for x in (F.lit(k), F.lit(-(-n // PART)))))
    rows = -(-number // QUERIES)
    vectors = index.vectors.withColumn("part", F.pmod(F.xxhash64("ident"), parts[F.col("list")]).cast("int"))
    vectors = vectors.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (parts[F.col("list")] - 1).cast("int"))))
    return vectors, asked.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(rows)).cast("int"))


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the k smallest, and all that equal the last of them."""
    for i, row in enumerate(scores):
        if len(row) > k:
            yield i, np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        else:
            yield i, np.arange(len(row))


def _slices(f: pd.DataFrame, each: int, most: int) -> Iterator[pd.DataFrame]:
    """f in pieces, of so few rows that they make about `most` of what a row makes `each` of."""
    step = max(1, most // max(1, each))
    for start in range(0, len(f), step):
        yield f.iloc[start : start + step]


def _unit_queries(queries: DataFrame, ident: str, vector: str) -> DataFrame:
    return queries.select(F.col(ident).alias("query"), F.col(vector).cast("array<float>").alias("asked")).where(F.aggregate("asked", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "ident")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "ident", "similarity")


def search(spark: SparkSession, path: str, queries: DataFrame, ident: str, vector: str, k: int = 10, probes: int | None = None, refine: int = 16) -> DataFrame:
    """query, rank, ident, similarity (cosine, six decimals): about the k nearest vectors of each query.

    probes: lists read for a query, by default as many as the sample needed; refine: so many times k candidates are rescored exactly.
    """
    index = Index(spark, path)
    asked = settled(_unit_queries(queries, ident, vector), "queries")
    qkind, shared, number = asked.schema["query"].dataType.simpleString(), index.shared, asked.count()

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (part for whole in frames for part in _slices(whole, len(shared.value.centroids), ROWS)):
            at = np.argsort(squares(unit(f["asked"]), shared.value.centroids), axis=1)[:, : probes or shared.value.probes]
            yield f.loc[f.index.repeat(at.shape[1])].assign(list=at.ravel().astype("int32"))

    def scan(key, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"query": [], "ident": [], "about": []})
        codes = np.stack([np.frombuffer(c, np.uint8) for c in held["code"]])
        names, found = held["ident"].to_numpy(), []
        for some in _slices(wanted, len(held), SCORES):
            about, q = shared.value.approximate(unit(some["asked"]), int(key[0]), codes), some["query"].to_numpy()
            found += [(q[i], names[at], about[i, at]) for i, at in _best(about, names, k * refine)]
        return pd.DataFrame({"query": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "ident": np.concatenate([f[1] for f in found]), "about": np.concatenate([f[2] for f in found])})

    vectors, wanted = _dealt(index, asked.mapInPandas(near, f"query {qkind}, asked array<float>, list int"), number)
    keys = ["list", "part", "turn"]
    found = vectors.select("ident", "code", *keys).groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(scan, f"query {qkind}, ident {index.kind}, about double")
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("about", "ident"))).where(F.col("r") <= k * refine)
    both = few.join(asked, "query").join(index.vectors.select("ident", "vector"), "ident")
    return _ranked(both.select("query", "ident", F.round(_cosine("asked", "vector"), 6).alias("similarity")), k)


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact(spark: SparkSession, path: str, queries: DataFrame, ident: str, vector: str, k: int = 10, probes: int | None = 4) -> DataFrame:
    """As `search`, but always the k nearest: whatever the triangle inequality doesn't rule out is scored."""
    index = Index(spark, path)
    about = search(spark, path, queries, ident, vector, k, probes)
    worst = about.where(F.col("rank") == k).select("query", F.col("similarity").alias("least"))
    asked = settled(_unit_queries(queries, ident, vector).join(worst, "query", "left").na.fill(-1.0, ["least"]), "asked")
    qkind, shared, lists, number = asked.schema["query"].dataType.simpleString(), index.shared, index.lists, asked.count()
    numbers = np.array(sorted(lists))
    radii = np.array([lists[i][0] for i in sorted(lists)])

    def reach(f: pd.DataFrame) -> np.ndarray:
        """How far the k-th found is, with room for the rounding of its similarity."""
        return np.sqrt(np.maximum(2 - 2 * (f["least"].to_numpy() - 1e-6), 0)) + 1e-9

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (part for whole in frames for part in _slices(whole, len(numbers), ROWS)):
            gap = np.sqrt(squares(unit(f["asked"]), shared.value.centroids[numbers])) - radii[None, :]
            row, at = np.nonzero(gap <= reach(f)[:, None] + 1e-6)
            yield f.iloc[row].assign(list=numbers[at].astype("int32"))

    def scan(key, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "ident": [], "similarity": []})
        if not len(held) or not len(wanted):
            return none
        v, names, far, out = unit(held["vector"]), held["ident"].to_numpy(), held["far"].to_numpy(), []
        for some in _slices(wanted, len(held), SCORES):
            q = unit(some["asked"])
            away = np.sqrt(squares(q, shared.value.centroids[int(key[0])][None, :]))
            open_ = np.abs(away - far[None, :]) <= reach(some)[:, None] + 1e-6
            similar = np.where(open_, np.round(q @ v.T, 6), -2.0)
            found = [(i, at[similar[i, at] > -2]) for i, at in _best(-similar, v, k)]
            out += [(some["query"].iloc[i], names[at], similar[i, at]) for i, at in found]
        return pd.DataFrame({"query": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "ident": np.concatenate([o[1] for o in out]), "similarity": np.concatenate([o[2] for o in out])})

    vectors, wanted = _dealt(index, asked.mapInPandas(near, f"query {qkind}, asked array<float>, least double, list int"), number)
    keys = ["list", "part", "turn"]
    found = vectors.select("ident", "vector", "far", *keys).groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(scan, f"query {qkind}, ident {index.kind}, similarity double")
    return _ranked(found, k)
