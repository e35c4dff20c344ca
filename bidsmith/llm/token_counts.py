"""Token counts without tokens: Viterbi over piece matches that carries score and count only.

See `lattice` for vocabulary, scores and ties; a text's count is the sum over its words, and each
distinct word of a batch is solved once.

Defined results: null and the empty text have no tokens; an empty table gives no rows; of paths with equal scores the
one whose last piece is longest counts, as in the library; repeated rows count alike; very long texts are one batch of
their own and are counted whole; further columns pass through, and one with a new one's name, in any letter case, is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidsmith.llm import lattice
from bidsmith.llm.common import annotate, small_batches


def counted(texts: pa.Array, path: str) -> dict:
    """Tokens, words and log-probability of the best segmentation of each text."""
    number, words, distinct = lattice.split(texts)
    if not len(words):
        return {"n_tokens": number, "n_pieces_words": number, "score": number.astype(float)}
    score, count = lattice.Lattice(lattice.pieces(path), distinct).best()
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[words])))[np.concatenate(([0], np.cumsum(number)))])
    return {"n_tokens": total(count), "n_pieces_words": number, "score": total(score) / lattice.UNITS}


def count_tokens(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, n_pieces_words (space-parted words) and score; path: the model file, which every executor has."""
    small_batches(docs.sparkSession)
    return annotate(docs, lambda _, part: counted(part.column("text"), path), "n_tokens bigint, n_pieces_words bigint, score double", keep, 2_000_000)
