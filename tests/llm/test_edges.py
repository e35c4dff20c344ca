"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest

import corpus_pipeline
from bidsmith.llm import decontaminate, impact_index, language_model, near_dup, packing, quality, resampling, sampling, secrets, sharding, token_counts, token_ids, toxicity
from bidsmith.llm.queries import tokenizer

PIECES, BPE = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} the and" for i in range(30_000))
RUN = "abcdefghij" * 10_000
TEXTS = [(None, None), (None, "null id and text"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, RUN), (7, LONG), (8, "Ünïcode ☃ 日本語 \U0001f600 ▁ x"), (9, "a  b   c "), (10, "the same words again and again and again here")]
CLASH = "score double, ids int, spans string, leaks string, leaks2 int, n_tokens string, kept string, raw string, none string, shard string, n bigint, `key` string"
#: A model without a labelled document: every score is 0.
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, *[None] * len(CLASH.split(", "))) for i, t in texts], SCHEMA)


OPERATORS = {
    "secrets": lambda s, d: secrets.scan_secrets(d, keep=["doc_id"]),
    "mask": lambda s, d: secrets.mask_secrets(d),
    "token_ids": lambda s, d: token_ids.round_trip(d, BPE),
    "token_counts": lambda s, d: token_counts.count_tokens(d, PIECES, ["doc_id"]),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "no such words in any of these texts at all"), (None, None), (2, "")], "item_id bigint, text string")),
    "language_model": lambda s, d: language_model.score_documents(d),
    "near_dup": lambda s, d: near_dup.near_duplicates(d),
    "quality": lambda s, d: quality.quality_rules(d, s.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id bigint, quality int")),
    "toxicity": lambda s, d: toxicity.with_toxicity(d, toxicity.fit(d, s.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id bigint, toxic int")), ["doc_id"]),
    "not_toxic": lambda s, d: toxicity.without_toxic(d, None),
    "shard_bytes": lambda s, d: sharding.shard_documents(d, 16, "bytes"),
    "shard_rows": lambda s, d: sharding.shard_documents(d, 16, "rows"),
    "shard_key": lambda s, d: sharding.shard_documents(d, 16, "key"),
    "packing": lambda s, d: packing.pack(d, BPE, 0, 64).where("start = 0"),
    "resample": lambda s, d: resampling.resample(d, s.createDataFrame([(1, "the same words"), (None, None)], "item_id bigint, text string"), least_words=2),
    "resample_pairs": lambda s, d: resampling.resample(d, s.createDataFrame([], "item_id bigint, text string"), order=2),
    "sampling": lambda s, d: sampling.digests(d, PIECES),
}
SAME_COLUMNS = ("mask", "decontaminate", "not_toxic")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, name):
    docs = table(spark, TEXTS)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_pipeline_on_edges(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, TEXTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this occurs anywhere")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    kept = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in TEXTS if i != 7)


def test_pipeline_on_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
