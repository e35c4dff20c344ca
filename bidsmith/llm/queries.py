"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.llm import decontaminate, impact_index, language_model, near_dup, packing, quality, resampling, sampling, secrets, sharding, token_counts, token_ids, toxicity
from bidsmith.llm.common import documents, fold


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return secrets.scan_secrets(docs, secrets.fit(docs), keep=["doc_id"])


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer("piece_bpe_32k.model"), keep=["doc_id"])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_pairs(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir, "doc_id", "text"), modulus=7, held=2)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), percent=85, width=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir, "doc_id", "text"), 16, "bytes")


def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.ranked_search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), order=1, buckets=10_000, percent=10, least_words=20, seed=2024)


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_token_id_output, op3_token_counts, op4_benchmark_decontamination, op5_lm_scoring, op6_minhash_near_dedup, op7_quality_rules, op8_toxicity, op9_sharding, op10_sentencepiece_sampling, op11_ranked_search, op12_packing, op13_importance_resampling)}
_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SETS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"""

#: SQL for the operators that it can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_minhash_near_dedup": f"""WITH RECURSIVE {_SETS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
 SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    # crc32 by a table of its 256 steps, over each distinct word's bytes
    "op13_importance_resampling": f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
 d AS (SELECT doc_id, {_RUNS} AS w FROM documents),
 dw AS (SELECT doc_id, unnest(w) AS w FROM d),
 bw AS (SELECT unnest({_RUNS}) AS w FROM benchmark),
 v AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab.t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
 s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b),
 t AS (SELECT b, count(*) AS t FROM bw JOIN v USING (w) GROUP BY b),
 g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
 x AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
 y AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN x USING (doc_id)),
 z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, sum((n_features >= 20)::INT) OVER () AS fit FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM z""",
    "op11_ranked_search": rf"""WITH dw AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
 p AS (SELECT doc_id, t, count(*) AS tf FROM dw GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY 1), a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
 w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, docs),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN n USING (doc_id), a GROUP BY 1, 2),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
 SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
