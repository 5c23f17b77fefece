"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the lengths then answer totals,
quantiles and truncated totals for every context limit without reading a text again.

Defined results: null text is the empty text; with the end id it has one token; repeated rows
count each; lengths that tie are one row of the histogram; an empty table has an empty histogram;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, pieces, text_of
from .tokens import default_tokenizer, encoder, id_arrays

#: Lengths that one window task sums; their totals are summed in a second step.
STEP = 64


def token_lengths(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", end_ids: int = 1) -> DataFrame:
    """n_tokens of each row."""
    file = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file)
        for batch in pieces(batches):
            _, ends = id_arrays(coder.encode(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends) + end_ids)], names=["n_tokens"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", end_ids: int = 1) -> DataFrame:
    """n_tokens, n_docs: one row per encoded length that occurs."""
    return token_lengths(docs, tokenizer, text_col, end_ids).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of a histogram: documents and tokens of at least L, and the tokens left when every document is cut to L.

    Sums run within steps of lengths and over the steps' totals, so no task reads all lengths. The
    histogram is read twice, so it is checkpointed and the texts are encoded once.
    """
    h = checkpointed(histogram).select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / STEP).alias("step"))
    steps = h.groupBy("step").agg(F.sum("n_docs").alias("step_docs"), F.sum("tokens").alias("step_tokens"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    steps = steps.select(
        "step", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("step_docs", "step_tokens")),
        *(F.sum(c).over(every).alias(f"{c}_all") for c in ("step_docs", "step_tokens")),
    )
    own = Window.partitionBy("step").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("d", F.sum("n_docs").over(own)).withColumn("t", F.sum("tokens").over(own)).join(steps, "step")
    docs, tokens = F.col("d") + F.col("step_docs_above"), F.col("t") + F.col("step_tokens_above")
    return h.select(
        "n_tokens", "n_docs", "tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("step_tokens_all") - tokens + docs * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("step_docs_all") - docs + F.col("n_docs")).alias("docs_at_most"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to limit, for any limit."""
    longer = F.coalesce(F.max(F.when(F.col("n_tokens") > limit, F.col("docs_at_least"))), F.lit(0))
    below = F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("tokens"))), F.lit(0))
    return sums.agg((below + longer * limit).alias("truncated_tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share q of documents doesn't exceed (null: no documents)."""
    n = F.max("docs_at_most").over(Window.partitionBy())
    return sums.select("n_tokens", "docs_at_most", n.alias("n")).where(F.col("docs_at_most") >= F.ceil(F.col("n") * F.lit(q))).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram and its suffix sums over every whole document."""
    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
