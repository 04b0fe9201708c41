"""How well a codec fits a corpus, and how two corpora or outputs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.codec import names_of
from glyphmill.operators.freq import numbered
from glyphmill.sources.folder import written


def usage(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """(idx, freq) over an encoded corpus."""
    return encoded.select(F.explode(ids).alias("idx")).groupBy("idx").agg(F.count("*").alias("freq"))


def usage_of_words(word_freqs: DataFrame, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """(idx, freq) over the corpus that the words were counted in, as if it were encoded: no text is read again."""
    names = vocab.groupBy(F.col("name").alias("term")).agg(F.min("idx").alias("idx"))
    return word_freqs.join(names, "term", "left").groupBy(F.coalesce("idx", F.lit(unknown)).alias("idx")).agg(F.sum("freq").alias("freq"))


def histogram(vocab: DataFrame, used: DataFrame) -> DataFrame:
    """(idx, name, n) for every type, also unused ones."""
    return vocab.select("idx", "name").join(used, "idx", "left").select("idx", "name", F.coalesce("freq", F.lit(0)).alias("n"))


def codec_quality(vocab: DataFrame, used: DataFrame, n_rows: int, unknown: int = 1) -> DataFrame:
    """(n_types, n_tokens, mean_seq_len, unk_count, imbalance) in one row.

    used: (idx, freq) over the encoded corpus of ``n_rows`` texts. The imbalance is half
    the sum of |share - 1/k| over all k types. Unknown pieces are counted for
    themselves. An empty corpus gives null for the mean and the imbalance.
    """
    bins = histogram(vocab, used)
    sums = bins.agg(F.count("*").alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    both = bins.crossJoin(F.broadcast(sums))  # one row
    share = F.try_divide(F.col("n"), F.col("n_tokens"))
    return both.agg(
        F.max("n_types").alias("n_types"),
        F.max("n_tokens").alias("n_tokens"),
        F.max(F.try_divide("n_tokens", F.lit(n_rows))).alias("mean_seq_len"),
        F.sum(F.when(F.col("idx") == unknown, F.col("n")).otherwise(0)).alias("unk_count"),
        (0.5 * F.sum(F.abs(share - 1.0 / F.col("n_types")))).alias("imbalance"),
    )


def shares(freqs: DataFrame, key: str = "term") -> DataFrame:
    """(key, p)."""
    total = freqs.agg(F.sum("freq").alias("total"))
    return freqs.crossJoin(F.broadcast(total)).select(key, (F.col("freq") / F.col("total")).alias("p"))


def side_by_side(a: DataFrame, b: DataFrame, key: str = "term") -> DataFrame:
    """(key, p, q) of two distributions over the union of their keys."""
    both = shares(a, key).join(shares(b, key).withColumnRenamed("p", "q"), key, "full_outer")
    return both.select(key, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def divergences(pairs: DataFrame) -> DataFrame:
    """(kl, js, emd): KL(p, q) is null where q lacks some of p's keys; natural logarithms; emd moves mass at half cost."""
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    lacks = F.max(((p > 0) & (q == 0)).cast("int")) == 1
    kl = F.when(lacks, None).otherwise(F.sum(F.when(q > 0, part(p, q)).otherwise(0.0)))
    return pairs.agg(kl.alias("kl"), F.sum((part(p, m) + part(q, m)) / 2).alias("js"), (F.sum(F.abs(p - q)) * 0.5).alias("emd"))


def checked_distribution(pairs: DataFrame, column: str = "p") -> DataFrame:
    """(total, least, valid): a distribution sums to 1 within 1e-4 and has nothing below 0."""
    total, least = F.sum(column), F.min(column)
    return pairs.agg(total.alias("total"), least.alias("least"), ((F.abs(total - 1) <= 1e-4) & (least >= 0)).alias("valid"))


def oov_report(freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kind, types, tokens, token_pct) of terms inside and outside a vocabulary."""
    known = vocab.select(F.col("name").alias("term")).distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known"), "InVocab").otherwise("OOV")
    rows = freqs.join(known, "term", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("types"), F.sum("freq").alias("tokens"))
    total = freqs.agg(F.sum("freq").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("kind", "types", "tokens", F.round(100.0 * F.col("tokens") / F.col("total"), 2).alias("token_pct"))


def grams_of(rows: DataFrame, keys: list[str], items: Column, n: int) -> DataFrame:
    """(keys, gram, n) of each row."""
    grams = F.transform(T.ngrams(items, n), lambda g: F.array_join(g, " "))
    return rows.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def precision_recall(candidates: DataFrame, references: DataFrame, keys: list[str], n: int = 1, text: str = "text", universe: DataFrame | None = None) -> DataFrame:
    """(gram, ref_freq, cand_freq, recall, precision, f1) over pairs of rows with equal keys.

    A gram's recall is the mean of min(c, r) / r over the rows whose reference holds it,
    its precision that of min(c, r) / c over the rows whose candidate does; without such
    rows they are 0 and 1. Rows meet once by their keys, and each pair counts both its
    sides' grams inside the row; then grams are summed. universe: (gram) to keep, if given.
    """
    grams = lambda c: F.transform(T.ngrams(T.words(F.col(c)), n), lambda g: F.array_join(g, " "))
    # rows are numbered in written tables: after a shuffle a rerun task would number them otherwise
    c = written(candidates.select(*keys, grams(text).alias("c"), F.monotonically_increasing_id().alias("c_row")), "candidates")
    r = written(references.select(*keys, grams(text).alias("r"), F.monotonically_increasing_id().alias("r_row")), "references")
    one = lambda side, sign: F.transform(side, lambda g: F.struct(g.alias("gram"), F.lit(sign).alias("of_c")))
    each = c.join(r, keys).select("c_row", "r_row", F.explode(F.concat(one("c", 1), one("r", 0))).alias("x"))
    both = each.groupBy("c_row", "r_row", "x.gram").agg(F.sum("x.of_c").alias("c"), (F.count("*") - F.sum("x.of_c")).alias("r"))
    hit = F.least("c", "r")
    out = both.groupBy("gram").agg(
        F.sum("r").alias("ref_freq"),
        F.sum("c").alias("cand_freq"),
        F.coalesce(F.avg(F.when(F.col("r") > 0, hit / F.col("r"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(F.col("c") > 0, hit / F.col("c"))), F.lit(1.0)).alias("precision"),
    )
    out = out if universe is None else out.join(universe.select("gram").distinct(), "gram", "left_semi")
    p, r_ = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r_ == 0, 0.0).otherwise(2 * p * r_ / (p + r_)))


def gram_table(grams: DataFrame, measured: DataFrame, top: int = 0) -> DataFrame:
    """(rank, gram, name, rank_freq, ref_freq, cand_freq, recall, precision, f1) of listed n-grams, the most frequent first.

    grams: (ids, freq, names) as an n-gram file holds them; measured: what
    ``precision_recall`` found on ids. A listed gram that was measured nowhere has the
    frequencies -1, recall 0, precision 1 and f1 0. top: how many to list, all if 0.
    """
    listed = grams.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("gram"), F.array_join("names", " ").alias("name"), F.col("freq").alias("rank_freq"))
    placed = numbered(listed, F.desc("rank_freq"), "gram").withColumn("rank", F.col("at") + 1).drop("at")
    placed = placed.where(F.col("rank") <= top) if top else placed
    fill = {"ref_freq": -1, "cand_freq": -1, "recall": 0.0, "precision": 1.0, "f1": 0.0}
    both = placed.join(measured, "gram", "left")
    return both.select("rank", "gram", "name", "rank_freq", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def id_grams(encoded: DataFrame, n: int, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """(ids, freq, names) of the n-grams of an encoded corpus, as an n-gram file holds them; names come from the vocabulary, each looked up once for a distinct n-gram."""
    counted = written(encoded.select(F.explode(T.ngrams(F.col(ids), n)).alias("ids")).groupBy("ids").agg(F.count("*").alias("freq")), "grams")
    return names_of(counted, ["ids", "freq"], vocab).withColumnRenamed("pieces", "names")


def new_grams(candidates: DataFrame, references: DataFrame, keys: list[str], n: int = 1, text: str = "text") -> DataFrame:
    """(gram, freq): grams of candidates that no reference has."""
    c = grams_of(candidates, keys, T.words(F.col(text)), n)
    r = grams_of(references, keys, T.words(F.col(text)), n)
    return c.join(r.select("gram").distinct(), "gram", "left_anti").groupBy("gram").agg(F.sum("n").alias("freq"))
