"""Text and vector queries over documents, pages, conversations, embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidsmith.config import CODE_MARKS
from bidsmith.functions import text as X
from bidsmith.operators import greedy, inverted, vectors
from bidsmith.operators import relevance as R
from bidsmith.plans.registry import query, table
from bidsmith.streaming.state import shared


@query("""SELECT event_type AS model, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, count(*) FILTER (value > 10) AS large FROM events GROUP BY 1""")
def request_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") > 10).alias("large"))


QUERY = ["the", "that", "the", "from", "anything"]
TOKENS = r"regexp_extract_all(lower(text), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b\d{4,}\b|[a-z0-9_]+')"
_TERM = lambda t, k: f"CASE WHEN {t} > 0 THEN ln(2.0::DOUBLE) * {t} * 2.5 / ({t} + 1.5 * (0.25 + 0.75 * n / m)) * {k} ELSE 0 END"
BM25 = f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'that')) AS b, len(list_filter(t, lambda x: x = 'from')) AS c, len(list_filter(t, lambda x: x = 'anything')) AS e FROM t),
 s AS (SELECT c.*, (SELECT avg(n) FROM c) AS m FROM c), r AS (SELECT doc_id, e, least(1.0, ({_TERM('a', 2)} + {_TERM('b', 1)} + {_TERM('c', 1)} + {_TERM('e', 1)}) / 10) AS x, CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT) + CAST(e > 0 AS INT) AS matched FROM s)"""


@query(BM25 + " SELECT doc_id, matched, round(CASE WHEN e > 0 THEN least(1.0, x + 0.3) ELSE x END, 6) AS bm25 FROM r")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", QUERY).select("doc_id", "matched", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), m AS (SELECT avg(len(t)) AS m FROM d), f AS (SELECT doc_id, t, n, count(*) AS f FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
 q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS}) AS t FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id, doc_id, round(sum(ln(2.0::DOUBLE) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / m)) * qf), 6) AS raw, CAST(count(*) AS INT) AS matched, max(length(t)) >= 8 AS long FROM q JOIN f USING (t), m GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) AS INT) AS rank FROM s)
 SELECT item_id, rank, doc_id, raw, matched, round(CASE WHEN long THEN least(1.0, least(1.0, raw / 10) + 0.3) ELSE least(1.0, raw / 10) END, 9) AS bm25 FROM r WHERE rank <= 10""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query over all documents, by the inverted index."""
    path = shared(spark, "inverted")
    inverted.build(table(spark, d, "documents"), "doc_id", "text", path)
    found = inverted.search(spark, path, table(spark, d, "benchmark"), "item_id", "text", 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "raw", "matched", F.round("bm25", 9).alias("bm25"))


@query(BM25 + """, l AS (SELECT doc_id, CASE WHEN e > 0 THEN least(1.0, x + 0.3) ELSE x END AS y, matched FROM r), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
 v AS (SELECT vec_id, greatest(0.0, least(1.0, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))))) AS cosine FROM embeddings, q)
 SELECT doc_id, round(CASE WHEN cosine IS NOT NULL THEN 0.5 * y + 0.5 * cosine ELSE f END, 6) AS hybrid, round(f, 6) AS fallback FROM (SELECT *, CASE WHEN matched >= 2 THEN least(1.0, greatest(y, 0.3) + 0.2) WHEN matched = 1 THEN greatest(y, 0.3) ELSE y END AS f FROM l) LEFT JOIN v ON vec_id = doc_id""")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents for one query, its vector being the seventh; a document's vector is that of its number, and some have none."""
    s, e = R.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", QUERY), table(spark, d, "embeddings")
    asked = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    similar = e.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("doc_id"), X.cosine(F.col("embedding"), F.col("q")).alias("similar"))  # one row
    alone = R.exact_only(F.col("bm25"), F.col("matched"))
    both = R.fused(F.col("bm25"), F.col("similar"), R.blend_weight(F.lit(" ".join(QUERY))))
    return s.join(similar, "doc_id", "left").select("doc_id", F.round(F.coalesce(both, alone), 6).alias("hybrid"), F.round(alone, 6).alias("fallback"))


@query("""WITH c AS (SELECT label AS center, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT center, vec_id, round(greatest(0.0, least(1.0, list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))))), 6) AS similarity FROM embeddings, c)
 SELECT center, vec_id, similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of each label's mean vector; labels are few, so their means are one array."""
    from bidsmith.operators.rows import top_per_key

    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("v"))
    packed = means.agg(F.collect_list(F.struct(F.col("label").alias("center"), "v")).alias("c"))
    scored = e.crossJoin(F.broadcast(packed)).select("vec_id", "embedding", F.inline("c"))  # one row, a vector a label
    scored = scored.select("center", "vec_id", F.round(X.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))
    return top_per_key(scored, ["center"], [F.desc("similarity"), F.col("vec_id")], 10)


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
 SELECT query, CAST(r AS INT) AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every 20th, by the exact way over an index of inverted lists and codes."""
    e, path = table(spark, d, "embeddings"), shared(spark, "vectors")
    vectors.build(e, "vec_id", "embedding", path)
    return vectors.exact(spark, path, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumnRenamed("ident", "vec_id")


#: A document's context is a benchmark item, some with an identifier, numbers or a host; its vector, if any, that of its number.
_CONTEXT = "text || CASE item_id % 5 WHEN 1 THEN ' 12345' WHEN 2 THEN ' 12345 67890' WHEN 3 THEN ' see host.example.com' WHEN 4 THEN ' 550e8400-e29b-41d4-a716-446655440000' ELSE '' END"


@query(f"""WITH b AS (SELECT item_id, {_CONTEXT} AS text FROM benchmark), c AS (SELECT item_id, {TOKENS} AS q, CASE item_id % 5 WHEN 1 THEN 0.65 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 WHEN 4 THEN 0.85 ELSE 0.5 END::DOUBLE AS weight FROM b),
 t AS (SELECT doc_id, {TOKENS} AS t FROM documents), j AS (SELECT doc_id, item_id, t, q, weight FROM t JOIN c ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
 f AS (SELECT doc_id, item_id, any_value(weight) AS weight, w, any_value(len(list_filter(t, lambda x: x = w))) AS f, count(*) AS qf FROM (SELECT *, unnest(q) AS w FROM j) GROUP BY doc_id, item_id, w),
 r AS (SELECT doc_id, any_value(weight) AS weight, any_value(item_id) AS item_id, sum(CASE WHEN f > 0 THEN ln(2.0::DOUBLE) * f * 2.5 / (f + 1.5) * qf ELSE 0 END) AS raw, CAST(count(*) FILTER (f > 0) AS INT) AS matched, coalesce(max(length(w) >= 8) FILTER (f > 0), false) AS long FROM f GROUP BY 1),
 x AS (SELECT *, CASE WHEN long THEN least(1.0, least(1.0, raw / 10) + 0.3) ELSE least(1.0, raw / 10) END AS bm25 FROM r),
 v AS (SELECT x.*, CASE WHEN e.embedding IS NOT NULL AND q.embedding IS NOT NULL THEN greatest(0.0, least(1.0, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))) END AS cosine FROM x LEFT JOIN embeddings e ON e.vec_id = doc_id LEFT JOIN embeddings q ON q.vec_id = item_id)
 SELECT doc_id, matched, round(bm25, 6) AS bm25, round(CASE WHEN cosine IS NOT NULL THEN weight * bm25 + (1 - weight) * cosine WHEN matched >= 2 THEN least(1.0, greatest(bm25, 0.3) + 0.2) WHEN matched = 1 THEN greatest(bm25, 0.3) ELSE bm25 END, 6) AS hybrid FROM v""")
def context_score(spark: SparkSession, d: str) -> DataFrame:
    """Each document against a context of its own: exact matches of the one document, fused with the cosine of vectors by the
    context's weight; without a vector, the matches alone."""
    b, e, i = table(spark, d, "benchmark"), table(spark, d, "embeddings"), F.col("item_id") % 5
    more = F.when(i == 1, " 12345").when(i == 2, " 12345 67890").when(i == 3, " see host.example.com").when(i == 4, " 550e8400-e29b-41d4-a716-446655440000").otherwise("")
    contexts = b.select("item_id", F.concat("text", more).alias("context"))
    own = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % b.count()).alias("item_id")).join(contexts, "item_id")
    scored = own.select("doc_id", "item_id", R.blend_weight(F.col("context")).alias("weight"), X.single_bm25(X.tokens(F.col("text")), X.tokens(F.col("context"))).alias("s")).select("doc_id", "item_id", "weight", "s.*")
    found = scored.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a")), "doc_id", "left").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("b")), "item_id", "left")
    similar = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), X.cosine(F.col("a"), F.col("b")))
    return found.select("doc_id", "matched", F.round("bm25", 6).alias("bm25"), F.round(F.coalesce(R.fused(F.col("bm25"), similar, F.col("weight")), R.exact_only(F.col("bm25"), F.col("matched"))), 6).alias("hybrid"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn beside the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))


NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORMAL}, ' '), lambda w: w <> '')"
TURNS = f"WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), w AS (SELECT conv_id, turn, {WORDS.format('text')} AS a, {WORDS.format('before')} AS b FROM t)"
CLIP = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"


@query(TURNS + f", c AS (SELECT *, coalesce({CLIP.format('a', 'b')}, 0) AS k FROM w) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2.0 * k / (len(a) + len(b)) END::DOUBLE, 6) AS f1 FROM c")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    df = turns(spark, d).select("conv_id", "turn", X.words(F.col("text")).alias("a"), X.words(F.col("before")).alias("b"))
    return df.select("conv_id", "turn", F.round(X.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(TURNS + " SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0), 6) AS jaccard FROM w")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    df = turns(spark, d).select("conv_id", "turn", X.words(F.col("text")).alias("a"), X.words(F.col("before")).alias("b"))
    return df.select("conv_id", "turn", F.round(X.jaccard(F.array_distinct("a"), F.array_distinct("b")), 6).alias("jaccard"))


_GRAMS = lambda x, n: x if n == 1 else f"CASE WHEN len({x}) >= {n} THEN list_transform(generate_series(1, len({x}) - {n} + 1), lambda i: array_to_string({x}[i:i + {n} - 1], ' ')) ELSE [] END"
BLEU = TURNS + ", g AS (SELECT conv_id, turn, " + ", ".join(f"{_GRAMS(x, n)} AS {x}{n}" for n in range(1, 5) for x in "ab") + " FROM w), p AS (SELECT conv_id, turn, [" + ", ".join(f"coalesce({CLIP.format(f'a{n}', f'b{n}')}, 0)::DOUBLE / nullif(len(a{n}), 0)" for n in range(1, 5)) + "] AS s FROM g)"


@query(BLEU + ", l AS (SELECT conv_id, turn, list_transform(list_filter(s, lambda x: x > 0), lambda x: ln(x)) AS l FROM p) SELECT conv_id, turn, round(CASE WHEN len(l) > 0 THEN exp(list_sum(l) / len(l)) ELSE 0.0 END, 6) AS bleu FROM l")
def bleu(spark: SparkSession, d: str) -> DataFrame:
    df = turns(spark, d).select("conv_id", "turn", X.words(F.col("text")).alias("a"), X.words(F.col("before")).alias("b"))
    return df.select("conv_id", "turn", F.round(X.bleu(F.col("a"), F.col("b")), 6).alias("bleu"))


@query(TURNS.replace(", w AS", ", p AS", 1) + """, c AS (SELECT conv_id, turn, a, b, list_transform(a, lambda x: [coalesce(list_position(b, x), 0)]) AS x, list_transform(b, lambda y: list_position(b, y)) AS y, list_transform(range(1, len(b) + 1), lambda j: [j]) AS js FROM p),
 r AS (SELECT *, list_reduce(x, lambda row, x: list_reduce(js, lambda acc, j: list_append(acc, greatest(row[j[1] + 1], acc[-1], CASE WHEN y[j[1]] = x[1] THEN row[j[1]] + 1 ELSE 0 END)), [0::BIGINT]), list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT)) AS last FROM c)
 SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * coalesce(last[-1], 0) / (len(a) + len(b)), 6) END AS rouge_l FROM r""")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Longest common word subsequence of a turn and the one before it: an Arrow-batched function."""
    from bidsmith.functions.sequences import rouge_l as score

    df = turns(spark, d).select("conv_id", "turn", X.words(F.col("text")).alias("a"), X.words(F.col("before")).alias("b"))
    return df.select("conv_id", "turn", F.round(score("a", "b"), 6).alias("rouge_l"))


@query(TURNS.replace(", w AS", ", n AS (SELECT conv_id, turn, " + NORMAL.format("text") + " AS x, " + NORMAL.format("before") + " AS y FROM t), w AS") + " SELECT conv_id, count(*) FILTER (x = y) AS exact, count(*) FILTER (contains(x, y) OR contains(y, x)) AS contained FROM n GROUP BY 1")
def answer_equivalence(spark: SparkSession, d: str) -> DataFrame:
    df = turns(spark, d).select("conv_id", X.normal(F.col("text")).alias("x"), X.normal(F.col("before")).alias("y"))
    return df.groupBy("conv_id").agg(F.count_if(F.col("x") == F.col("y")).alias("exact"), F.count_if(F.contains("x", F.col("y")) | F.contains("y", F.col("x"))).alias("contained"))


CURVE = r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda x: x <> '') AS w FROM conversations),
 g AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE [coalesce(w[1], '') || ' '] END) AS p FROM w),
 n AS (SELECT conv_id, turn, count(*) AS k FROM (SELECT conv_id, p, min(turn) AS turn FROM g GROUP BY 1, 2) GROUP BY 1, 2), c AS (SELECT conv_id, turn, CAST(sum(coalesce(k, 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seen FROM conversations LEFT JOIN n USING (conv_id, turn))"""


@query(CURVE + " SELECT conv_id, turn, seen FROM c")
def bigram_curve(spark: SparkSession, d: str) -> DataFrame:
    return R.bigram_curve(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(CURVE + """, x AS (SELECT conv_id, seen, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, min(seen) OVER (PARTITION BY conv_id) AS lo, max(seen) OVER (PARTITION BY conv_id) AS hi FROM c),
 y AS (SELECT conv_id, n, lo, hi, i, coalesce(round((seen - lo)::DOUBLE / nullif(hi - lo, 0) - i::DOUBLE / nullif(n - 1, 0), 9), -1.0) AS gap FROM x), z AS (SELECT conv_id, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, max(gap) AS g, arg_min(i, (-gap, i)) AS i FROM y GROUP BY 1)
 SELECT conv_id, CAST(CASE WHEN n < 3 THEN NULL WHEN hi = lo THEN 1 WHEN g >= 0.05 THEN i + 1 END AS BIGINT) AS knee FROM z""")
def knee(spark: SparkSession, d: str) -> DataFrame:
    return R.knees(R.bigram_curve(table(spark, d, "conversations"), "conv_id", "turn", "text"), "conv_id", "turn", "seen")


_CODE = CODE_MARKS.replace("'", "''")
_COUNT = f"""CASE WHEN length({{0}}) = 0 THEN 0 ELSE greatest(1, CAST(floor(length({{0}}) / CASE WHEN len(regexp_extract_all({{0}}, '{_CODE.replace('{', '{{').replace('}', '}}')}')) > length({{0}}) / 500 THEN 3.5 ELSE 4.0 END + 0.5) AS BIGINT)
 + length(regexp_replace(array_to_string(regexp_extract_all({{0}}, 'https?://\\S+'), ''), '[^/?&]', '', 'g')) + 2 * len(regexp_extract_all({{0}}, '(?i)[0-9a-f]{{{{8}}}}-[0-9a-f]{{{{4}}}}-[0-9a-f]{{{{4}}}}-[0-9a-f]{{{{4}}}}-[0-9a-f]{{{{12}}}}'))) END"""


@query(f"SELECT page_id, CAST({_COUNT.format('t')} AS BIGINT) AS tokens FROM (SELECT page_id, url || ' ' || html AS t FROM pages)")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.estimated_tokens(F.concat_ws(" ", "url", "html")).alias("tokens"))


@query(f"SELECT conv_id, CAST(sum({_COUNT.format('role')} + {_COUNT.format('t')} + 4) + 3 AS BIGINT) AS tokens, count(*) AS messages FROM (SELECT *, text || CASE WHEN turn % 3 = 1 THEN ' see http://a.example/b?c=1&d=2 for 550e8400-e29b-41d4-a716-446655440000' ELSE '' END AS t FROM conversations) GROUP BY 1")
def conversation_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Roles and texts, four for each message and three for the reply; every third turn names a URL and an identifier."""
    text = F.concat("text", F.when(F.col("turn") % 3 == 1, " see http://a.example/b?c=1&d=2 for 550e8400-e29b-41d4-a716-446655440000").otherwise(""))
    each = X.estimated_tokens(F.col("role")) + X.estimated_tokens(text) + 4
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(each) + 3).cast("bigint").alias("tokens"), F.count("*").alias("messages"))


_MARKS = " + ".join(f"CAST(contains(substr(h, 1, 2000), '{m}') AS INT)" for m in ("<head", "<body", "<div", "<script", "<style", "<meta", "<link", "<!doctype"))


@query(f"SELECT page_id, starts_with(h, '<!doctype html') OR starts_with(h, '<html') OR {_MARKS} >= 2 AS is_html FROM (SELECT page_id, lower(trim(CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN regexp_replace(html, '^<!DOCTYPE html><html[^>]*>', '') ELSE url END)) AS h FROM pages)")
def html_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    own = F.when(k == 0, F.col("html")).when(k == 1, F.regexp_replace("html", r"^<!DOCTYPE html><html[^>]*>", "")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.is_html(own).alias("is_html"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query("SELECT conv_id, coalesce(arg_max(trim(text), turn) FILTER (role = 'user' AND length(trim(text)) > 10), '') AS query FROM conversations GROUP BY 1")
def last_user_query(spark: SparkSession, d: str) -> DataFrame:
    return R.last_query(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(r"""SELECT lang, count(*) FILTER (regexp_matches(lower(text), 'error|fail|exception|traceback|fatal|panic|crash')) AS with_errors, count(*) FILTER (regexp_matches(lower(text), '\b(security|auth|password|secret|token)\b')) AS security, count(*) AS n FROM documents GROUP BY 1""")
def error_lines(spark: SparkSession, d: str) -> DataFrame:
    from bidsmith.config import SECURITY_WORDS

    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(X.has_errors(F.col("text"))).alias("with_errors"), F.count_if(F.lower("text").rlike(SECURITY_WORDS)).alias("security"), F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 s AS (SELECT *, round(least(1.0, CASE WHEN contains(lower(line), 'the') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(line), 'token') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(line), '\b(error|exception|fail(ed|ure)?|fatal|critical|crash|panic)\b') OR regexp_matches(lower(line), '\b(important|note|todo|fixme|hack|xxx|bug|fix)\b') OR regexp_matches(line, '^#+\s') OR regexp_matches(line, '^\*\*') OR regexp_matches(line, '^>\s') THEN 0.2 ELSE 0 END + CASE WHEN trim(line) <> '' THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS s FROM l),
 o AS (SELECT *, CASE WHEN i < 10 OR i >= n - 10 THEN 0 WHEN s >= 0.3 THEN 1 WHEN (i - 10) % 10 = 0 AND i >= 10 AND i < n - 10 THEN 2 END AS o FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, CASE WHEN o = 1 THEN -s ELSE 0 END, i) AS r FROM o WHERE o IS NOT NULL)
 SELECT doc_id, CAST(i AS INT) AS line_no, line FROM r WHERE o = 0 OR r <= 50""")
def line_select(spark: SparkSession, d: str) -> DataFrame:
    return R.selected_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["the", "token", "of"])


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of_content(table(spark, d, "documents").select("doc_id", "text"), "text", [F.col("doc_id")]).select("doc_id", "content_hash")


AGED = "SELECT event_id, user_id, value / 20 AS importance, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS age, event_id % 5 AS accesses, CAST(value AS BIGINT) AS v FROM events"


def aged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 20).alias("importance"), F.datediff(F.to_date(F.lit("2024-02-01")), F.to_date("ts")).alias("age"), (F.col("event_id") % 5).alias("accesses"), "value")


@query(f"SELECT event_id, round(s, 6) AS score FROM (SELECT event_id, CASE WHEN accesses > 0 THEN least(1.0, i + least(0.3, accesses * 0.05)) ELSE i END::DOUBLE AS s FROM (SELECT *, importance * exp(-0.03::DOUBLE * age) AS i FROM ({AGED}))) WHERE s >= 0.15")
def decay_score(spark: SparkSession, d: str) -> DataFrame:
    df = aged(spark, d).select("event_id", X.decayed(F.col("importance"), F.col("age"), F.col("accesses"), 0.03).alias("s"))
    return df.where("s >= 0.15").select("event_id", F.round("s", 6).alias("score"))


@query(f"SELECT user_id, count(*) AS n, round(max(importance * (1 / (1 + age * 0.1::DOUBLE)) * least(1.0, 0.5::DOUBLE + accesses * 0.1)), 6) AS best FROM ({AGED}) GROUP BY 1")
def rank_score(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max(X.ranking(F.col("importance"), F.col("age"), F.col("accesses"))), 6).alias("best"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(event_id % 23 + 1 AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
 s(user_id, r, used, kept) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e UNION ALL SELECT s.user_id, e.r, CASE WHEN s.used + e.cost <= 100 THEN s.used + e.cost ELSE s.used END, CASE WHEN s.used + e.cost <= 100 THEN s.kept + 1 ELSE s.kept END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
 SELECT user_id, max(used) AS used, max(kept) AS kept FROM s GROUP BY 1""")
def budget_rank(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice under a budget per user; a user's entries are one bounded list."""
    e = table(spark, d, "events").select("user_id", F.struct((-F.col("value")).alias("o"), "event_id", (F.col("event_id") % 23 + 1).alias("cost")).alias("x"))
    kept = e.groupBy("user_id").agg(X.fitting(F.sort_array(F.collect_list("x")), 100).alias("k"))
    return kept.select("user_id", F.aggregate("k", F.lit(0).cast("bigint"), lambda s, x: s + x["cost"]).alias("used"), F.size("k").cast("bigint").alias("kept"))


@query("""SELECT event_type, round(sum(c), 4) AS cost, round(sum(c), 4) > 1 AS over_budget FROM (SELECT event_type, (event_id % 1000 * (CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 0.25 ELSE 1.0 END) + event_id % 300 * (CASE event_type WHEN 'click' THEN 15.0 WHEN 'view' THEN 1.25 ELSE 5.0 END))::DOUBLE / 1e6 AS c FROM events) GROUP BY 1""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "events").select("event_type", (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"))
    priced = R.priced(usage, {"click": (3.0, 15.0), "view": (0.25, 1.25)}, "event_type", (1.0, 5.0))
    return priced.groupBy("event_type").agg(F.round(F.sum("cost"), 4).alias("cost")).withColumn("over_budget", F.col("cost") > 1)


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, count(*) AS n FROM events GROUP BY 1")
def failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("failure_rate"), F.count("*").alias("n"))


@query("SELECT category, n FROM (SELECT CASE WHEN source IN ('src0','src1') THEN source ELSE lang END AS category, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, category LIMIT 5")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select(F.when(F.col("source").isin("src0", "src1"), F.col("source")).alias("kind"), "lang")
    return df.groupBy(R.category(["kind", "lang"]).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("""WITH f AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), k AS (SELECT event_type, unnest(CASE event_id % 4 WHEN 0 THEN ['k', 'even', 'fourth'] WHEN 2 THEN ['k', 'even'] ELSE ['k', 'odd'] END) AS key FROM f WHERE r <= 50)
 SELECT event_type, key, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, key) AS p FROM (SELECT event_type, key, count(*) AS n FROM k GROUP BY 1, 2)) WHERE p <= 3""")
def common_keys(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest keys of each kind's first 50 items."""
    i = F.col("event_id")
    more = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.when(i % 2 == 0, 1).alias("even"), F.when(i % 2 == 1, 1).alias("odd"), F.when(i % 4 == 0, 1).alias("fourth")))
    return R.common_keys(table(spark, d, "events").select("event_type", "event_id", more.alias("item")), "event_type", ["event_id"], "item", 50, 3)


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'note ' || turn END AS memory, trim('a ' || text) AS bare FROM conversations""")
def memory_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a memory block put in: its JSON is read (null where malformed) and the text left bare."""
    block = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<memory>{"memories": ["note '), F.col("turn").cast("string"), F.lit('"]}</memory>'))).otherwise(F.lit("<memory>{bad</memory>"))
    df = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("a "), F.col("text"), block).alias("t"))
    return R.memory_blocks(df, "t").select("conv_id", "turn", F.get("memory.memories", F.lit(0)).alias("memory"), "bare")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id % 4 <> 0 OR role = 'user') AND turn < 5")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a scope: a null scope holds for all, and only current versions count."""
    c = table(spark, d, "conversations")
    scoped = c.withColumns({"owner": F.when(F.col("conv_id") % 4 == 0, F.col("role")), "valid_until": F.when(F.col("turn") >= 5, F.lit("x"))})
    return scoped.where((F.col("owner").isNull() | (F.col("owner") == "user")) & F.col("valid_until").isNull()).select("conv_id", "turn", "role")


@query("""WITH RECURSIVE g AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
 h AS (SELECT conv_id, turn, greatest(1, length(t) - 3) AS n, list_transform(range(1, greatest(1, length(t) - 3) + 1), lambda i: ('0x' || md5(substr(t, i, 4))[1:16])::UBIGINT) AS x FROM g),
 u AS (SELECT conv_id, turn, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN 2 * len(list_filter(x, lambda v: (v >> k::UBIGINT) & 1 = 1)) > n THEN (1::UBIGINT << k::UBIGINT)::HUGEINT ELSE 0::HUGEINT END)) AS v FROM h),
 e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, (CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT AS v FROM u),
 s(conv_id, r, heads, cluster) AS (SELECT conv_id, r, [v], 0 FROM e WHERE r = 1 UNION ALL
 SELECT conv_id, r, CASE WHEN place > 0 THEN heads ELSE list_append(heads, v) END, CASE WHEN place > 0 THEN place - 1 ELSE len(heads) END FROM
 (SELECT e.conv_id, e.r, s.heads, e.v, coalesce(list_position(list_transform(s.heads, lambda x: bit_count(xor(x, e.v)) <= 3), true), 0) AS place FROM s JOIN e ON e.conv_id = s.conv_id AND e.r = s.r + 1))
 SELECT conv_id, turn, v AS simhash, bit_count(xor(v, lag(v) OVER (PARTITION BY conv_id ORDER BY turn))) AS distance, cluster FROM e JOIN s USING (conv_id, r)""")
def simhash_clusters(spark: SparkSession, d: str) -> DataFrame:
    """SimHash of every turn, its Hamming distance to the turn before, and its cluster: the conversation's first cluster head within 3 bits."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, d, "conversations").select("conv_id", "turn", X.simhash(F.col("text")).alias("h"))
    df = df.select("conv_id", "turn", F.col("h").alias("simhash"), F.bit_count(F.col("h").bitwiseXOR(F.lag("h").over(w))).alias("distance"))
    return greedy.simhash_clusters(df, "conv_id", "turn", "simhash")


@query()
def optimal_k(spark: SparkSession, d: str) -> DataFrame:
    """How many turns of each conversation carry its content: knee of the bigram curve, held by a compression check."""
    from bidsmith.functions.sequences import optimal_size

    df = table(spark, d, "conversations").select("conv_id", "turn", "text", X.simhash(F.col("text")).alias("simhash"))
    return df.groupBy("conv_id").applyInPandas(optimal_size, "conv_id bigint, n bigint, k bigint")


@query("""SELECT page_id, CAST(page_id % 3 AS INT) AS n_blocks, md5(CASE page_id % 3 WHEN 0 THEN html || '<br/>' WHEN 1 THEN 'see ' || html ELSE html || ' end' END) AS rest, true AS restored FROM pages""")
def protected_tags(spark: SparkSession, d: str) -> DataFrame:
    """Pages with nothing, a call or a note and a memo around them: custom tags set aside and put back; the round trip gives the page."""
    from bidsmith.functions.sequences import protect

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # whole pages: a batch of 10,000 is several times a worker's memory
    call = F.concat(F.lit("see <Tool_call id='1'>"), F.lit("<p>a</p><b>"), F.lit("</Tool_call>"), "html")
    noted = F.concat("html", F.lit("<x.note>\n<x.note/></x.note> end<memo at='2' />"))
    own = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<br/>"))).when(F.col("page_id") % 3 == 1, call).otherwise(noted)
    return table(spark, d, "pages").select("page_id", protect(own).alias("p")).select("page_id", "p.n_blocks", F.md5("p.rest").alias("rest"), "p.restored")
