"""Queries of names alike by edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.operators import fuzzy
from bidsmith.plans.registry import query, table

_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS {} FROM {}"
_RATIO = "floor(100 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))))"


@query(f"WITH a AS ({_WORDS.format('x', 'benchmark')}), b AS ({_WORDS.format('y', 'documents')}) SELECT x, y, CAST({_RATIO.format('x', 'y')} AS INT) AS ratio FROM a, b WHERE {_RATIO.format('x', 'y')} >= 85")
def alike_words(spark: SparkSession, d: str) -> DataFrame:
    """Long words of the benchmark and those of all documents that are at least 85 in 100 alike."""
    words = lambda t, n: table(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias(n)).distinct()
    return fuzzy.alike(words("benchmark", "x"), words("documents", "y"), 85)


_NAMES = "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'x' || substr(upper(c_name), 2) WHEN c_custkey % 3 = 1 THEN replace(c_name, '#', ' # ') ELSE c_name || 'a' END AS spelled FROM customer"


@query(f"WITH n AS ({_NAMES}), f AS (SELECT 'S' || s_suppkey AS ticker, replace(replace(s_name, 'Supplier', 'Customer'), '#000000', '#00000') AS company FROM supplier) SELECT c_custkey, ticker, CAST({_RATIO.format('lower(spelled)', 'lower(company)')} AS INT) AS ratio FROM n, f WHERE {_RATIO.format('lower(spelled)', 'lower(company)')} >= 85")
def alike_companies(spark: SparkSession, d: str) -> DataFrame:
    """Misspelled names, some in their first letter, and the listed companies they are like; all names share long parts."""
    k = F.col("c_custkey")
    spelled = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.concat(F.lit("x"), F.substr(F.upper("c_name"), F.lit(2)))).when(k % 3 == 1, F.replace("c_name", F.lit("#"), F.lit(" # "))).otherwise(F.concat("c_name", F.lit("a")))
    firms = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.replace(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), F.lit("#000000"), F.lit("#00000")).alias("company"))
    return fuzzy.alike_names(table(spark, d, "customer").select("c_custkey", spelled.alias("spelled")), "spelled", firms, 85).select("c_custkey", "ticker", "ratio")
