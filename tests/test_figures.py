"""Rounded figures against those of SQL, where the decimal form of a double ends in a five that it isn't."""

from __future__ import annotations

import datetime as dt

import duckdb

from bidsmith import catalog

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string"


def test_positions_round_as_sql(spark, tmp_path):
    d, day = str(tmp_path), dt.datetime(1997, 1, 1)
    spark.createDataFrame([(i, i, "O", 1000.0 * i + 5, day) for i in range(2000)], ORDER).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, i, 1, 52805.0 + 2 * i + (i % 2) * 1.01, "R") for i in range(2000)], LINE).write.parquet(f"{d}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    for name in ("position_transition", "pnl"):
        df = catalog.QUERIES[name](spark, d)
        want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]}) order by all").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    first = catalog.QUERIES["position_transition"](spark, d).where("position_id = 0").first()
    assert first.exit_price == 264.02


def test_pages_come_in_small_batches(spark, sf_dir):
    """Whole pages go to Python a thousand at a time."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        pages = catalog.QUERIES["protected_tags"](spark, sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
        assert pages.where("restored").count() == pages.count() > 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
