"""Token counts from an exact length histogram.

Documents are counted by encoded length; sums over the greater lengths then answer, for any context limit, how many
documents exceed it, how many tokens are left when each document is cut there, and where quantiles lie. Null counts as
empty: length 0. Rows that repeat count each, ids aren't read, nor any other column than the text; a text of any length is
one number. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import cut_lineage, small_batches

#: Lengths that one window of the suffix sums spans.
SPAN = 256


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """n_tokens of each document, and nothing else."""
    path = tokenizer or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x.as_py())) for x in batch.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def summary(hist: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs of it, docs_over (longer), tokens_total of all
    documents, tokens_kept when each is cut there, tokens_lost, and share_at_most, the share of documents that fit. Between
    two lengths tokens_kept is linear in the limit with slope docs_over; a quantile q is the least length with
    share_at_most >= q."""
    hist = hist.withColumn("_span", F.floor(F.col("n_tokens") / span)).withColumn("_tokens", F.col("n_docs") * F.col("n_tokens"))
    spans = hist.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    over = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each SPAN lengths
    every = Window.partitionBy()
    spans = spans.select("_span", F.coalesce(F.sum("_d").over(over), F.lit(0)).alias("_d_over"), F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("tokens_total"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t_over"))
    within = Window.partitionBy("_span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.join(spans, "_span").withColumn("docs_over", F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("_d_over"))
    rows = rows.withColumn("_longer", F.coalesce(F.sum("_tokens").over(within), F.lit(0)) + F.col("_t_over"))
    kept = F.col("tokens_total") - F.col("_longer") + F.col("docs_over") * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_over", "tokens_total", kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_lost"), ((F.col("_docs") - F.col("docs_over")) / F.col("_docs")).alias("share_at_most"))


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    return summary(cut_lineage(histogram(lengths(docs, text_col, tokenizer))))


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left of all documents when each is cut at limit, from a token_counts() table."""
    row = table.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).first()
    if row is None:
        docs = table.agg(F.sum("n_docs")).first()[0] or 0
        return limit * docs
    return row.tokens_kept + row.docs_over * (limit - row.n_tokens)


def quantile(table: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents don't exceed."""
    return table.where(F.col("share_at_most") >= q - 1e-12).agg(F.min("n_tokens")).first()[0]
