"""The vector index: recall of the quick way, the exact way against all pairs, groups in parts, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from bidsmith.operators import vectors


def clustered(n, size=24, seed=1):
    draw = np.random.default_rng(seed)
    means = draw.normal(size=(12, size))
    x = means[draw.integers(0, 12, n)] + 0.35 * draw.normal(size=(n, size))
    x[:40] = x[40:80]  # copies
    return x.astype(np.float32)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "i bigint, v array<float>")


def nearest(x, queries, k):
    u = vectors.unit(x)
    s = np.round(vectors.unit(queries) @ u.T, 6)
    return [[(int(i), float(row[i])) for i in np.lexsort((np.arange(len(x)), -row))[:k]] for row in s]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query, [])) + 1
        out[r.query].append((r.ident, r.similarity))
    return out


@pytest.mark.parametrize(("part", "turn", "lists"), [(65_536, 4096, None), (30, 7, 5), (30, 4096, 1)])
def test_exact_equals_all_pairs(spark, tmp_path, monkeypatch, part, turn, lists):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "QUERIES", turn)
    x = clustered(600)
    vectors.build(table(spark, x), "i", "v", str(tmp_path), lists, sample=300)
    got = found(vectors.exact(spark, str(tmp_path), table(spark, x[::20]), "i", "v", 7))
    for q, want in enumerate(nearest(x, x[::20], 7)):
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1.1e-6)
        assert [i for i, _ in got[q]] == [i for i, _ in want]


def test_recall_of_the_quick_way(spark, tmp_path, sf_dir):
    """At least 0.9 on every 20th vector of the given table, by the number of lists that the sample needed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows])
    vectors.build(e, "vec_id", "embedding", str(tmp_path))
    asked = e.where("vec_id % 20 = 0")
    got = found(vectors.search(spark, str(tmp_path), asked, "vec_id", "embedding", 10))
    hits = [len({i for i, _ in got[q]} & {rows[i].vec_id for i, _ in want}) for q, want in zip(sorted(got), nearest(x, x[[i for i, r in enumerate(rows) if r.vec_id % 20 == 0]], 10), strict=True)]
    assert sum(hits) / (10 * len(hits)) >= 0.9


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0]), (5, [1.0, 1.0, 1.0]), (6, [-3.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    vectors.build(df, "i", "v", str(tmp_path / "a"))
    for way in (vectors.search, vectors.exact):
        got = found(way(spark, str(tmp_path / "a"), df.where("i in (1, 2, 3)"), "i", "v", 5))
        assert got == {1: [(1, 1.0), (4, 0.0), (6, -1.0)]}
    vectors.build(df.where("i in (2, 3)"), "i", "v", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_tasks_hold_few_rows_at_a_time(spark, monkeypatch, tmp_path):
    """Queries times lists, and queries times vectors, are gone through in pieces; the result is that of all at once."""
    import numpy as np
    import pandas as pd

    from bidsmith.operators import vectors

    frame = pd.DataFrame({"x": range(10)})
    assert [len(f) for f in vectors._slices(frame, 5, 20)] == [4, 4, 2] and [len(f) for f in vectors._slices(frame, 50, 20)] == [1] * 10
    v = np.random.default_rng(3).normal(size=(300, 8))
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "i long, v array<float>")
    vectors.build(table, "i", "v", f"{tmp_path}/index", lists=12)
    monkeypatch.setattr(vectors, "ROWS", 30)
    monkeypatch.setattr(vectors, "SCORES", 40)
    asked = table.where("i % 20 = 0")
    got = {}
    for r in vectors.exact(spark, f"{tmp_path}/index", asked, "i", "v", 5).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["ident"]
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q, ranks in got.items():
        want = sorted(range(300), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:5]
        assert [ranks[k] for k in range(1, 6)] == want
    assert len(got) == 15
