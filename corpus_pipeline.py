"""From raw documents to token ids: each stage applies one operator to all its predecessor kept.

STAGES are (name, function) with functions of (spark, docs, sf_dir); all but the last return the
columns of documents. Toxic documents go; of near duplicates the smallest doc_id of a group stays;
documents with a benchmark passage go; secrets are masked in the text; the rest is encoded.

Defined results: an empty table stays empty; null and empty texts pass every stage and have no
ids; rows with a null doc_id are kept; repeated rows stay together; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsmith.llm import decontaminate, near_dup, sampling, secrets, toxicity
from bidsmith.llm.common import cut, documents
from bidsmith.llm.queries import tokenizer


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more; the machine learns from a bounded sample of labelled documents of the training folds.

    Null and empty texts score as harmless; without labels, or in an empty table, nothing goes; equal texts score alike; columns stay, whatever their names.
    """
    model = toxicity.fit(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model, 0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 on five-word shingles): that of the smallest doc_id.

    Null and empty texts are like nothing and stay, as do rows with a null doc_id; repeated rows of the doc_id that stays all stay; an empty table stays empty.
    """
    return near_dup.deduplicate(docs, percent=80, width=5)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item (weighted similarity 0.8).

    Null and empty texts hold none, and null and empty items are in none; equal texts fare alike; an empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets masked, and n_chars of the new text. Null and empty texts, and all other columns, stay as they are; overlapping spans are one mask."""
    out = secrets.mask_secrets(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of a sampled segmentation.

    A null or empty text has no ids (n_pieces 0); rows of one doc_id and text have equal ids; an empty table gives no rows; other columns are dropped.
    """
    return sampling.encode(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids")


STAGES = [("toxicity", not_toxic), ("near_dedup", one_of_each), ("decontamination", not_leaked), ("secrets", masked), ("sentencepiece", encoded)]

#: The machine's decisions, the sampled ids and the forest's candidates aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(done, name, docs)
    return done
