"""Relevance, selection and rollups over text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.functions.text import line_score, tokens
from bidsmith.operators.rows import top_per_key


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, ident: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75, average: bool = True) -> DataFrame:
    """docs with bm25: idf ln 2, scaled by 10 to at most 1, 0.3 more if a matched term has 8 characters.

    The query is a literal, so each document is scored in place; with average, document lengths
    are set against the corpus mean (one number).
    """
    own = docs.withColumn("_t", tokens(F.col(text))).withColumn("_n", F.size("_t"))
    if average:
        mean = own.agg(F.coalesce(F.avg("_n"), F.lit(1.0)).alias("_mean"))
        own = own.crossJoin(F.broadcast(mean))  # one row
    else:
        own = own.withColumn("_mean", F.col("_n").cast("double"))
    raw, matched, long = F.lit(0.0), F.lit(0), F.lit(False)
    for term in dict.fromkeys(query):
        f = _times("_t", term)
        scale = f + k1 * (1 - b + b * F.col("_n") / F.col("_mean"))
        raw = raw + F.when(f > 0, F.ln(F.lit(2.0)) * f * (k1 + 1) / scale * query.count(term)).otherwise(0.0)
        matched = matched + (f > 0).cast("int")
        long = long | (f > 0) if len(term) >= 8 else long
    base = F.least(F.lit(1.0), raw / 10.0)
    return own.withColumn("matched", matched).withColumn("bm25", F.when(long, F.least(F.lit(1.0), base + 0.3)).otherwise(base)).drop("_t", "_n", "_mean")


def blend_weight(query: Column, base: float = 0.5) -> Column:
    """The share of exact matching: more where the query has identifiers, hosts or mail addresses."""
    uuids = F.regexp_count(query, F.lit(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"))
    numbers = F.regexp_count(query, F.lit(r"\b\d{4,}\b"))
    hosts = F.regexp_count(F.lower(query), F.lit(r"\b[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}\b"))
    mails = F.regexp_count(F.lower(query), F.lit(r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"))
    best = F.when(uuids > 0, 0.85).when(numbers >= 2, 0.75).when(numbers == 1, 0.65).when((hosts > 0) | (mails > 0), 0.6).otherwise(0.0)
    return F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.greatest(F.lit(base), best)))


def fused(exact: Column, similar: Column, weight: Column) -> Column:
    return weight * exact + (1 - weight) * similar


def exact_only(exact: Column, matched: Column) -> Column:
    """Without vectors: at least 0.3 for any match, 0.2 more for two terms."""
    return F.when(matched >= 2, F.least(F.lit(1.0), F.greatest(exact, F.lit(0.3)) + 0.2)).when(matched == 1, F.greatest(exact, F.lit(0.3))).otherwise(exact)


def selected_lines(docs: DataFrame, ident: str, text: str, context: list[str], head: int = 10, tail: int = 10, most: int = 50, every: int = 10) -> DataFrame:
    """(ident, line_no, line): the first and last lines, the best-scored, then every tenth of the middle, up to `most`."""
    lines = docs.select(ident, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    size = F.count("*").over(Window.partitionBy(ident))
    lines = lines.withColumns({"_n": size, "_s": F.round(line_score(F.col("line"), context), 4)})
    edge = (F.col("line_no") < head) | (F.col("line_no") >= F.col("_n") - tail)
    middle = ((F.col("line_no") - head) % every == 0) & (F.col("line_no") >= head) & (F.col("line_no") < F.col("_n") - tail)
    order = F.when(edge, 0).when(F.col("_s") >= 0.3, 1).when(middle, 2)
    ranked = lines.withColumn("_o", order).where("_o is not null")
    rank = F.row_number().over(Window.partitionBy(ident).orderBy("_o", F.when(F.col("_o") == 1, -F.col("_s")).otherwise(0.0), "line_no"))
    return ranked.withColumn("_r", rank).where((F.col("_o") == 0) | (F.col("_r") <= most)).select(ident, "line_no", "line")


def first_of_content(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """One row for each content (SHA-256), the first in order."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return df.withColumn("content_hash", F.substring(key, 1, 16)).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def common_keys(items: DataFrame, group: str, order: list[str], json: str, first: int = 50, most: int = 8) -> DataFrame:
    """(group, key, n): the commonest keys of each group's first items; of equal counts the first by name."""
    own = top_per_key(items, [group], [F.col(c) for c in order], first)
    counted = own.select(group, F.explode(F.map_keys(F.from_json(json, "map<string, string>"))).alias("key")).groupBy(group, "key").agg(F.count("*").alias("n"))
    return top_per_key(counted, [group], [F.desc("n"), F.col("key")], most).select(group, "key", "n")


def last_query(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's last user text of more than ten characters; the empty text where there is none."""
    own = F.trim(F.col(text))
    asked = F.when((F.col(role) == "user") & (F.length(own) > 10), own)
    return messages.groupBy(conversation).agg(F.coalesce(F.max_by(asked, F.when(asked.isNotNull(), F.col(turn))), F.lit("")).alias("query"))


def bigram_curve(items: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, order, seen): distinct word pairs up to each item of its group."""
    w = F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+"), lambda x: x != "")
    n = F.size("_w")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get("_w", i), F.lit(" "), F.get("_w", i + 1)))).otherwise(F.array(F.concat(F.coalesce(F.get("_w", F.lit(0)), F.lit("")), F.lit(" "))))
    each = items.withColumn("_w", w).select(group, order, F.explode(pairs).alias("_p"))
    new = each.groupBy(group, "_p").agg(F.min(order).alias(order)).groupBy(group, order).agg(F.count("*").alias("_new"))
    full = items.select(group, order).join(new, [group, order], "left")
    return full.select(group, order, F.sum(F.coalesce("_new", F.lit(0))).over(Window.partitionBy(group).orderBy(order)).alias("seen"))


def knees(curve: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, knee): how many items lie up to the point furthest above the diagonal; null without a clear one."""
    w = Window.partitionBy(group)
    df = curve.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order)) - 1, "_lo": F.min(value).over(w), "_hi": F.max(value).over(w)})
    gap = F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")) - F.try_divide(F.col("_i").cast("double"), (F.col("_n") - 1).cast("double"))
    best = df.withColumn("_gap", F.round(gap, 9)).groupBy(group).agg(F.max(F.struct(F.coalesce("_gap", F.lit(-1.0)).alias("g"), (-F.col("_i")).alias("i"))).alias("b"), F.max("_n").alias("_n"), F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    knee = F.when(F.col("_n") < 3, F.lit(None)).when(F.col("_hi") == F.col("_lo"), 1).when(F.col("b.g") >= 0.05, 1 - F.col("b.i"))
    return best.select(group, knee.cast("bigint").alias("knee"))


def neighbours(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(vertex, neighbour), edges read both ways, each pair once."""
    return edges.select(F.col(source).alias("vertex"), F.col(target).alias("neighbour")).union(edges.select(target, source)).where("vertex <> neighbour").distinct()


def category(columns: list[str]) -> Column:
    """The first filled field, cleaned."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.col(c), r"[\r\n]+", " ")), F.lit("")) for c in columns))


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]], model: str, default: tuple[float, float]) -> DataFrame:
    """usage (tokens_in, tokens_out) with cost in dollars at prices a million tokens; unknown models at the default."""
    cases_in, cases_out = None, None
    for name, (p, q) in prices.items():
        cases_in = F.when(F.col(model) == name, p) if cases_in is None else cases_in.when(F.col(model) == name, p)
        cases_out = F.when(F.col(model) == name, q) if cases_out is None else cases_out.when(F.col(model) == name, q)
    return usage.withColumn("cost", (F.col("tokens_in") * cases_in.otherwise(default[0]) + F.col("tokens_out") * cases_out.otherwise(default[1])) / 1e6)


def memory_blocks(df: DataFrame, text: str) -> DataFrame:
    """df with memory (the first block's JSON, null if malformed) and bare (the text without any block)."""
    block = F.regexp_extract(F.col(text), r"(?is)<memory>\s*(.*?)\s*</memory>", 1)
    return df.withColumns({"memory": F.from_json(F.nullif(block, F.lit("")), "struct<memories: array<string>>"), "bare": F.trim(F.regexp_replace(F.col(text), r"(?is)<memory>.*?</memory>", ""))})
