"""Operator 10: token counts for every context limit, from an exact histogram of encoded lengths.

Documents are encoded, counted by length, and sums over all longer lengths answer how many tokens a
context limit keeps. Lengths are dealt into bins of ``BIN`` for the running sums, so no task gets them all.

Defined results: null or empty text has length 0; an empty table gives no rows; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.bpe import Vocabulary
from sievework.llm.common import staged, texts
from sievework.llm.kernels import pretoken_codes, utf8

BIN = 1024
_KNOWN_WORDS = 1 << 18


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; a batch encodes each distinct pre-token once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoding = vocabulary.ranks(), vocabulary.encoding()
        known: dict[bytes, int] = {}
        for b in batches:
            codes, words, before = pretoken_codes(*utf8(b["text"]))
            size = np.ones(len(words), np.int64)
            for i, w in enumerate(words.cast(pa.binary()).to_pylist()):
                if w not in ranks:
                    if (n := known.get(w)) is None:
                        if len(known) >= _KNOWN_WORDS:
                            known.clear()
                        n = known[w] = len(encoding._encode_single_piece(w))
                    size[i] = n
            total = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(size[codes], out=total[1:])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(total[before]))], names=["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """n_tokens, n_docs and tokens of each length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))


def context_table(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: documents and tokens in those as long or longer, and the tokens that remain after truncation.

    ``quantile`` is the share of documents of that length or less. The bins' totals are far fewer than
    the lengths, and are summed from the longest down in the same way.
    """
    lengths = staged(lengths).withColumn("bin", F.floor(F.col("n_tokens") / BIN))
    # One row for each 1024 lengths: its number is bounded by the longest text, not by the documents.
    later = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = lengths.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    bins = bins.select("bin", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"))
    total = lengths.agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).first()
    docs, tokens = total["d"] or 0, total["t"] or 0
    down = Window.partitionBy("bin").orderBy(F.col("n_tokens").desc())
    at_least = F.sum("n_docs").over(down) + F.col("docs_after")
    tokens_at_least = F.sum("tokens").over(down) + F.col("tokens_after")
    return (
        lengths.join(bins, "bin")
        .select("n_tokens", "n_docs", "tokens", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"))
        .withColumn("truncated_tokens", F.lit(tokens) - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("quantile", (F.lit(docs) - F.col("docs_at_least") + F.col("n_docs")) / F.lit(docs or 1))
    )


def context_totals(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return context_table(histogram(token_counts(docs, vocabulary)))
