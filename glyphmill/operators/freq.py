"""Frequencies of words, characters and n-grams, and cuts by coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.sources.folder import written


#: Groups up to which their first places go to all executors.
LISTED_GROUPS = 100_000


def counted(items: DataFrame, by: str = "term") -> DataFrame:
    """(by, freq) of a column with one item in each row; partial counts are made before the shuffle."""
    return items.groupBy(by).agg(F.count("*").alias("freq"))


def word_freq(rows: DataFrame, text: str = "text", dedup: bool = False) -> DataFrame:
    """(term, freq). dedup: equal texts count once. Null texts are absent."""
    texts = rows.select(text).where(F.col(text).isNotNull())
    texts = texts.distinct() if dedup else texts
    return counted(texts.select(F.explode(T.words(F.col(text))).alias("term")))


def char_freq(rows: DataFrame, text: str = "text") -> DataFrame:
    """(term, freq) of code points, with ▁ for each space between words.

    Characters are counted from distinct words; a row of n words has n - 1 spaces, so
    these are the words less the rows that have any.
    """
    words = written(word_freq(rows, text), "word-freqs")
    filled = rows.where(F.col(text).rlike(T.NO_WHITE)).agg(F.count("*").alias("n"))
    spaces = words.agg(F.sum("freq").alias("freq")).crossJoin(filled).select(F.lit(T.SPACE).alias("term"), (F.col("freq") - F.col("n")).alias("freq")).where("freq > 0")
    return merged(char_freq_of_words(words), spaces)


def char_freq_of_words(word_freqs: DataFrame, suffix: str = "") -> DataFrame:
    """(term, freq) of code points, from words counted first: far fewer rows to explode."""
    one = word_freqs.select(F.explode(T.chars(F.concat("term", F.lit(suffix)))).alias("c"), "freq")
    return one.groupBy(F.col("c").alias("term")).agg(F.sum("freq").alias("freq"))


def ngram_freq(rows: DataFrame, items: Column, n: int, sep: str = " ") -> DataFrame:
    """(gram, freq) of exactly n neighbours, joined by ``sep``."""
    grams = F.transform(T.ngrams(items, n), lambda g: F.array_join(g, sep))
    return counted(rows.select(F.explode(grams).alias("gram")), "gram")


def corpus_size(rows: DataFrame, text: str = "text") -> DataFrame:
    """(n_lines, n_tokens, n_types): lines are counted by themselves, not by a mark among the words."""
    n = rows.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_lines"))
    return n.crossJoin(word_freq(rows, text).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_types")))


def chunked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``chunk``: consecutive ranges of an order that no two rows are equal in, each of a task's size."""
    return written(rows.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "chunks")


def summed_before(chunks: DataFrame, value: Column, *order: Column | str) -> DataFrame:
    """(chunks' columns, before, total): the sum of all rows before each in the whole order, and of all rows.

    Chunks are summed first, a row for each; a row then adds what stands before it in its
    own chunk. So no task sorts or sums more than one chunk.
    """
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = chunks.groupBy("chunk").agg(F.sum(value).alias("mass"))
    sums = sums.select("chunk", F.coalesce(F.sum("mass").over(earlier), F.lit(0)).alias("earlier"), F.sum("mass").over(everything).alias("total"))
    within = Window.partitionBy("chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return chunks.join(sums, "chunk").withColumn("before", own + F.col("earlier")).drop("chunk", "earlier")


def numbered_within(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``at``: their places from 0 within their group, in an order without ties (null groups are one group).

    All rows are placed in the order of (group, order); a group's first place is taken
    off. So a hot group is spread over as many ranges as it needs.
    """
    placed = written(numbered(rows, F.asc_nulls_first(group), *order), "placed")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("at").alias("_first"))
    return placed.join(F.broadcast(first) if first.count() <= LISTED_GROUPS else first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("at", F.col("at") - F.col("_first")).drop("_group", "_first")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``at``: their places from 0 in an order without ties."""
    return summed_before(chunked(rows, *order), F.lit(1), *order).withColumnRenamed("before", "at").drop("total")


def covered(freqs: DataFrame, coverage: float) -> DataFrame:
    """``freqs`` with ``kept``: the most frequent terms up to the one that reaches the coverage (ties by term)."""
    order = F.desc("freq"), F.asc("term")
    placed = summed_before(chunked(freqs.select("term", "freq"), *order), F.col("freq"), *order)
    return placed.select("term", "freq", (F.col("before") / F.col("total") < coverage).alias("kept"))


def ranked(freqs: DataFrame, name: str = "term") -> DataFrame:
    """``freqs`` with ``rank`` from 1, most frequent first, ties by name."""
    return numbered(freqs, F.desc("freq"), F.asc(name)).withColumn("rank", F.col("at") + 1).drop("at")


def merged(*freqs: DataFrame) -> DataFrame:
    """Counts of several sources added up."""
    both = freqs[0]
    for f in freqs[1:]:
        both = both.unionByName(f)
    return both.groupBy("term").agg(F.sum("freq").alias("freq"))
