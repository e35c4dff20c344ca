"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from bidsmith import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v.replace(tzinfo=None))
    return str(v) if isinstance(v, datetime.date) else v


def ordered(rows):
    return sorted((tuple(map(norm, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert ordered(got) == ordered([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
