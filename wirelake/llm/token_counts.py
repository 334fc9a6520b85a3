"""Exact token counts from a histogram of encoded lengths.

Workers count documents by encoded length before anything is shuffled, so the histogram has at most as
many rows as there are different lengths. Running sums over it answer totals, quantiles and truncated
totals for every context limit without another look at a text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import trimmed
from .bpe import encoded_chunks, piece_cache

BLOCK = 1024


def length_histogram(df: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many rows have texts of exactly so many tokens, ascending lengths not sorted.

    A null or empty text has 0 tokens. Repeated rows count as often as they occur; no rows give no rows.
    """

    def run(batches):
        cache, counts = piece_cache(vocab_path), Counter()
        for batch in batches:
            for _, _, _, at in encoded_chunks(batch.column(0), cache):
                counts.update(np.diff(at).tolist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])

    partial = df.select(text).mapInArrow(trimmed(run), "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def running_sums(histogram: DataFrame) -> DataFrame:
    """Per length, as a context limit: n_docs, docs_over (longer ones), docs_upto, tokens_upto (in documents of at most
    this length), truncated_tokens (if every document were cut to this limit), total_docs, total_tokens.

    Sums run within blocks of 1,024 lengths side by side, and over one row per block. For a limit c between two lengths the
    truncated total is tokens_upto of the lower one plus c times its docs_over; see ``truncated_totals``.
    """
    h = histogram.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "mass": F.col("n_tokens") * F.col("n_docs")})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("mass").alias("block_mass"))
    upto, all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    offsets = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(upto), zero).alias("docs_before"), F.coalesce(F.sum("block_mass").over(upto), zero).alias("mass_before"),
        F.sum("block_docs").over(all_).alias("total_docs"), F.sum("block_mass").over(all_).alias("total_tokens"),
    )
    inner = Window.partitionBy("block").orderBy("n_tokens")
    summed = h.withColumns({"d": F.sum("n_docs").over(inner), "m": F.sum("mass").over(inner)}).join(offsets, "block")
    docs, tokens = F.col("docs_before") + F.col("d"), F.col("mass_before") + F.col("m")
    over = F.col("total_docs") - docs
    return summed.select(
        "n_tokens", "n_docs", docs.alias("docs_upto"), over.alias("docs_over"), tokens.alias("tokens_upto"), (tokens + F.col("n_tokens") * over).alias("truncated_tokens"), "total_docs", "total_tokens"
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents doesn't exceed."""
    each = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_upto") >= s * F.col("total_docs"), F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_over) for any limits, present as lengths or not."""
    cut = lambda c: F.col("n_tokens") <= c
    each = [
        F.struct(
            F.lit(c).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(cut(c), F.col("n_tokens") * F.col("n_docs")).otherwise(c * F.col("n_docs"))), F.lit(0)).alias("truncated_tokens"),
            F.coalesce(F.sum(F.when(~cut(c), F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        )
        for c in limits
    ]
    return sums.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")
