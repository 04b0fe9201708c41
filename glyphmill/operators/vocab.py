"""Vocabularies: a table (idx, name, level, freq, kids) learned from frequencies, cut, and shrunk to a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import freq as N
from glyphmill.sources.folder import written

SCHEMA = "idx int, name string, level int, freq bigint, kids array<int>"
#: The reserved types by index, and the levels.
RESERVED = ("<pad>", "<unk>", "<s>", "</s>", "<cls>", T.SPACE)
PAD, UNK, BOS, EOS, CLS, SPACE = range(6)
LEVELS = {"reserved": -1, "char": 0, "user": 0, "class": 0, "byte": 0, "subword": 1, "word": 2, "phrase": 3}
#: Defaults of learning.
MIN_CO_EVIDENCE, WORD_MIN_FREQ, CHAR_MIN_FREQ, CHAR_COVERAGE = 95, 1, 20, 0.9995
NO_KIDS = "array<int>"


def reserved(spark: SparkSession) -> DataFrame:
    """The reserved rows with frequency -1."""
    return spark.createDataFrame([(i, name, -1, -1, []) for i, name in enumerate(RESERVED)], SCHEMA)


def checked(vocab: DataFrame) -> DataFrame:
    """``vocab``, if its reserved rows are in their places and its names unique; else it raises."""
    wrong = reserved(vocab.sparkSession).select("idx", "name").exceptAll(vocab.where("level = -1").select("idx", "name"))
    if not wrong.isEmpty():
        raise ValueError("reserved types are missing or misplaced")
    if not vocab.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("names are not unique")
    return vocab


def init_vocab(freqs: DataFrame, n_lines: int, level: str, coverage: float = 0.0, min_freq: int = 1, size: int = 0) -> DataFrame:
    """A vocabulary of the most frequent terms: coverage first, then min_freq, then size (0: no limit).

    Reserved names leave the corpus counts but keep them: `<s>`, `</s>` and `<cls>` add
    the number of lines, `<unk>` the frequency of all terms that were cut; where nothing
    was counted -1 stays. Ties go by name.
    """
    if 0 < size < len(RESERVED):
        raise ValueError(f"a vocabulary has {len(RESERVED)} reserved types")
    spark = freqs.sparkSession
    freqs = written(freqs.select("term", "freq"), "freqs")
    own = freqs.where(F.col("term").isin(*RESERVED))
    free = freqs.where(~F.col("term").isin(*RESERVED))
    kept = N.covered(free, coverage) if coverage else free.withColumn("kept", F.lit(True))
    kept = kept.withColumn("kept", F.col("kept") & (F.col("freq") >= min_freq)) if min_freq > 1 else kept
    top = N.ranked(kept.where("kept").select("term", "freq"))
    top = top.where(F.col("rank") <= size - len(RESERVED)) if size else top
    top = written(top, "top")
    cut = free.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n")).first()["n"] - top.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n")).first()["n"]
    extra = {"<unk>": cut, "<s>": n_lines, "</s>": n_lines, "<cls>": n_lines}
    added = spark.createDataFrame([(n, extra.get(n, 0)) for n in RESERVED], "name string, added bigint")
    total = F.coalesce("o.freq", F.lit(0)) + F.col("a.added")
    head = reserved(spark).alias("r").join(added.alias("a"), "name").join(own.alias("o"), F.col("r.name") == F.col("o.term"), "left")
    head = head.select("r.idx", "r.name", "r.level", F.when(total > 0, total).otherwise(-1).alias("freq"), "r.kids")
    idx = (F.col("rank") + len(RESERVED) - 1).cast("int")
    body = top.select(idx.alias("idx"), F.col("term").alias("name"), F.lit(LEVELS[level]).alias("level"), "freq", F.array().cast(NO_KIDS).alias("kids"))
    return head.unionByName(body)


def line_count(rows: DataFrame, text: str = "text") -> int:
    return rows.where(F.col(text).isNotNull()).count()


def learn_words(rows: DataFrame, text: str = "text", size: int = 0, min_freq: int = WORD_MIN_FREQ, coverage: float = 0.0) -> DataFrame:
    return init_vocab(N.word_freq(rows, text), line_count(rows, text), "word", coverage, min_freq, size)


def learn_chars(rows: DataFrame, text: str = "text", size: int = 0, min_freq: int = CHAR_MIN_FREQ, coverage: float = CHAR_COVERAGE) -> DataFrame:
    return init_vocab(N.char_freq(rows, text), line_count(rows, text), "char", coverage, min_freq, size)


def learn_classes(rows: DataFrame, label: str) -> DataFrame:
    """All labels, stripped, in alphabetical order from index 0; no reserved types."""
    return class_vocab(N.counted(rows.where(F.col(label).isNotNull()).select(F.col(label).alias("term"))))


def class_vocab(freqs: DataFrame) -> DataFrame:
    """The classes of labels that were counted (term, freq)."""
    listed = N.numbered(freqs.groupBy(T.strip(F.col("term")).alias("name")).agg(F.sum("freq").alias("freq")), "name")
    return listed.select(F.col("at").cast("int").alias("idx"), "name", F.lit(LEVELS["class"]).alias("level"), "freq", F.array().cast(NO_KIDS).alias("kids"))


def byte_vocab(rows: DataFrame, text: str = "text") -> DataFrame:
    """The 256 bytes, then `<s>` and `</s>`; frequencies are those of the texts' bytes (0 if none)."""
    return byte_table(N.counted(rows.select(F.explode(T.byte_ids(F.col(text))).alias("term"))))


def byte_table(used: DataFrame) -> DataFrame:
    """The byte vocabulary from the bytes' counts (term, freq)."""
    spark = used.sparkSession
    fixed = spark.range(256).select(F.col("id").cast("int").alias("idx"), F.lower(F.hex("id")).alias("name"), F.lit(LEVELS["byte"]).alias("level"))
    table = fixed.join(used, F.col("idx") == F.col("term"), "left").select("idx", "name", "level", F.coalesce("freq", F.lit(0)).alias("freq"))
    ends = spark.createDataFrame([(256, "<s>", -1, -1), (257, "</s>", -1, -1)], "idx int, name string, level int, freq bigint")
    return table.union(ends).withColumn("kids", F.array().cast(NO_KIDS))


def level_histogram(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("level").agg(F.count("*").alias("n"))


def as_row() -> Column:
    """A type as one line of a vocabulary file."""
    return F.concat_ws("\t", F.col("idx").cast("string"), "name", F.col("level").cast("string"), F.col("freq").cast("string"), F.array_join("kids", " "))


def shrink(vocab: DataFrame, usage: DataFrame, min_freq: int) -> DataFrame:
    """(old_idx, idx, name, level, freq, kids): what a corpus uses often enough, re-numbered in order.

    usage: (idx, freq) counted over the encoded corpus. Reserved types stay, and so do
    the kids of what stays, down to the letters. Kids come before their type, so each
    round of self-joins goes one step down; the depth is that of the merges.
    """
    used = vocab.join(usage.withColumnRenamed("freq", "n"), "idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wanted = written(used.where((F.col("n") >= min_freq) | (F.col("level") == -1)).select("idx", "kids"), "wanted")
    new = wanted
    while True:
        below = new.select(F.explode("kids").alias("idx")).distinct().join(wanted, "idx", "left_anti").join(vocab.select("idx", "kids"), "idx")
        new = written(below.select("idx", "kids"), "wanted")
        if new.isEmpty():
            break
        wanted = written(wanted.unionByName(new), "wanted")
    kept = vocab.join(wanted.select("idx"), "idx", "left_semi")
    numbers = written(N.numbered(kept.select("idx"), "idx").select("idx", F.col("at").cast("int").alias("new")), "numbers")
    kid = kept.select("idx", F.posexplode("kids").alias("at", "kid")).join(numbers.select(F.col("idx").alias("kid"), F.col("new").alias("new_kid")), "kid")
    kids = kid.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new_kid"))), lambda x: x.new_kid).alias("new_kids"))
    out = kept.join(numbers, "idx").join(kids, "idx", "left")
    return out.select(F.col("idx").alias("old_idx"), F.col("new").alias("idx"), "name", "level", "freq", F.coalesce("new_kids", F.array().cast(NO_KIDS)).alias("kids"))
