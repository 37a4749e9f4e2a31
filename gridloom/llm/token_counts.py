"""Operator 8: token counts by an exact length histogram.

Documents are encoded where they lie and aggregated by encoded length, so what moves is a
row per task and length. Suffix and prefix sums over the histogram then answer, for every
context limit that is some document's length, how many documents and tokens lie below and
above, what truncation to the limit leaves, and the quantile of the limit. The sums run
within ranges of 256 lengths and over the ranges, so no single task gets the histogram.

Cases: a null or empty text has length 0; repeated rows count each; doc_id plays no part;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, read
from .token_ids import default_tokenizer, encoder

RANGE = 256


def _lengths(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for big in it:
            n: list[int] = []
            for b in W.pieces(big, "text", 1 << 21):
                n += [len(x) // 4 for x in enc.encode([x or "" for x in b.column("text").to_pylist()])]
            length, docs = np.unique(np.array(n, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs.astype(np.int64))], ["length", "n_docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows (length, n_docs) for all lengths that occur."""
    d = docs.select(F.col("text").cast("string").alias("text"))
    n = d.mapInArrow(_lengths(tokenizer or default_tokenizer()), "length long, n_docs long")
    return n.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """Per length as a context limit, from sums over ``hist(length, n_docs)``:

    n_docs, n_tokens of that length; docs_over, tokens_over with more; docs_within,
    tokens_within; truncated_total, the sum of min(length, limit); dropped_tokens;
    quantile, the share of documents within the limit.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / RANGE).alias("range"))
    h = materialize(h)
    by_range = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = lambda w, n: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{n}") for c in "dt"]
    by_range = by_range.select("range", *sums(after, "after"), *sums(every, "all"))
    inner = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    h = h.join(by_range, "range").withColumn("docs_over", F.col("d_in") + F.col("d_after")).withColumn("tokens_over", F.col("t_in") + F.col("t_after"))
    within = F.col("t_all") - F.col("tokens_over")
    return h.select(
        "length", "n_docs", "n_tokens", "docs_over", "tokens_over",
        (F.col("d_all") - F.col("docs_over")).alias("docs_within"),
        within.alias("tokens_within"),
        (within + F.col("length") * F.col("docs_over")).alias("truncated_total"),
        (F.col("tokens_over") - F.col("length") * F.col("docs_over")).alias("dropped_tokens"),
        ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"),
    )


def quantile(limits_table: DataFrame, q: float) -> int | None:
    """The least length within which a share of ``q`` of the documents lies."""
    r = limits_table.filter(F.col("quantile") >= q).agg(F.min("length").alias("x")).head()
    return r.x if r else None


def truncated_total(limits_table: DataFrame, limit: int) -> int:
    """Tokens left after truncation to any ``limit``: the next lower length answers."""
    r = limits_table.filter(F.col("length") <= limit).agg(F.max(F.struct("length", "tokens_within", "docs_over")).alias("r")).head().r
    over = r.docs_over if r else (limits_table.agg(F.max(F.col("docs_over") + F.col("docs_within"))).head()[0] or 0)
    return (r.tokens_within if r else 0) + limit * over


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(read(spark, sf_dir, "documents")))
