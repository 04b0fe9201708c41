"""Operator 8: token counts by an exact histogram of encoded lengths.

Documents are counted by length. Sums over the histogram from its long end answer, for
every context limit, how many documents and tokens lie beyond it and what truncation
leaves; sums from its short end give quantiles. The histogram is cut into ranges of
lengths, so no task needs all of it: ranges are summed first, and each length adds what
lies in its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.bpe import token_count
from glyphmill.llm.shared import ship, written

#: Lengths of one range.
RANGE = 1024


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): null and empty texts have length 0; every row counts, repeated ones too."""
    ship(docs.sparkSession)
    return docs.select(token_count(F.col(f"`{text_col}`"), path).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def length_answers(histogram: DataFrame, limits: Sequence[int] | None = None) -> DataFrame:
    """For each length L of the histogram as the limit of a context: what lies beyond, what is left, and L's quantile.

    With ``limits`` the answers are for these, whether documents have such a length or
    not: they join the histogram with no documents. Without any document their quantile is null.

    docs_over and tokens_over are of documents longer than L; truncated_total is the sum
    of min(length, L) over all documents; quantile is the share of documents of at most
    L tokens. An empty histogram gives no rows.
    """
    if limits is not None:
        asked = histogram.sparkSession.createDataFrame([(k, 0) for k in set(limits)], "length long, n_docs long")
        histogram = histogram.select("length", "n_docs").unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    rows = histogram.withColumn("range", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    ranges = rows.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(beyond), zero).alias("later_docs"),
        F.coalesce(F.sum("all_tokens").over(beyond), zero).alias("later_tokens"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("all_tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, "range").select(
        "length",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(within), zero) + F.col("later_docs")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(within), zero) + F.col("later_tokens")).alias("tokens_over"),
        "total_docs",
        "total_tokens",
    )
    left = F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    at_most = F.col("total_docs") - F.col("docs_over")
    answers = placed.select("length", "n_docs", "docs_over", "tokens_over", left.alias("truncated_total"), F.try_divide(at_most, F.col("total_docs")).alias("quantile"))
    return answers if limits is None else answers.where(F.col("length").isin(*set(limits)))


def token_lengths(docs: DataFrame, path: str, text_col: str = "text", limits: Sequence[int] | None = None) -> DataFrame:
    return length_answers(written(length_histogram(docs, path, text_col), "lengths"), limits)
