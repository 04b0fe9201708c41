"""Operator 13: what five filters remove, in every order they can be applied in.

A text goes once through a table-driven transducer over its UTF-8 bytes. The class of a
byte is the state that the next byte meets, so all bytes of a batch are looked up at
once in the tables ``CLASS`` and ``EMITS``: what they emit counts code points, capitals
and symbols, and begins and ends words. The words' spans go into one hash table with
open addresses for the batch; a span counts as seen only if its bytes were compared with
those of the span that holds the place. So counts of distinct words are exact.

Copies are told by a digest of the whole text, and each document becomes the set of
filters it fails. From there on only counts of such sets are left, a few for each part,
and all orders are worked out from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship, written

FILTERS = "ABCDE"
#: The filters' limits.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"

SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, CONTINUED = range(6)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[0x80:0xC0], CLASS[0xC0:] = CONTINUED, LEAD
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE

#: What a byte emits, by the class of the byte before it and its own.
POINT, UPPER, SIGN, BEGIN, END = 1, 2, 4, 8, 16
EMITS = np.zeros((6, 6), np.uint8)
EMITS[:, :CONTINUED] |= POINT
EMITS[:, CAPITAL] |= UPPER
EMITS[:, SYMBOL] |= SIGN
EMITS[SPACE, CAPITAL:] |= BEGIN
EMITS[CAPITAL:, SPACE] |= END
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def distinct_spans(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the spans are the first of their bytes and owner in the hash table. data: the spans' bytes, one after the other."""
    n = len(lengths)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(data)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), FACTOR))  # wraps, as all products here
    hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], first)
    hashes = (hashes ^ (owner.astype(np.uint64) * SPREAD)) * SPREAD
    size = 1 << max(1, (2 * n).bit_length())
    slot = ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(size - 1)).astype(np.int64)
    table = np.full(size, -1)
    new = np.zeros(n, bool)
    pending = np.arange(n)
    while len(pending):
        free = pending[table[slot[pending]] < 0]
        table[slot[free]] = free
        held = table[slot[pending]]
        own = held == pending
        new[pending[own]] = True
        like = ~own & (hashes[held] == hashes[pending]) & (owner[held] == owner[pending]) & (lengths[held] == lengths[pending])
        a, b = pending[like], held[like]
        if len(a):
            many = lengths[a]
            begins = np.cumsum(many) - many
            step = np.arange(int(many.sum())) - np.repeat(begins, many)
            like[like] = np.logical_and.reduceat(data[np.repeat(first[a], many) + step] == data[np.repeat(first[b], many) + step], begins)
        pending = pending[~own & ~like]
        slot[pending] = (slot[pending] + 1) & (size - 1)
    return new


def transduced(texts: list[str | None]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text; null is empty."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    starts = np.cumsum(lengths) - lengths
    kinds = CLASS[data]
    before = np.concatenate([[np.uint8(SPACE)], kinds[:-1]])
    out = EMITS[before, kinds]
    count = lambda bit: np.add.reduceat(((out & bit) > 0).astype(np.int64), starts)
    begin = np.flatnonzero(out & BEGIN)
    words = count(BEGIN)
    distinct = np.zeros(len(raw), np.int64)
    if len(begin):
        owner = np.repeat(np.arange(len(raw)), words)
        new = distinct_spans(data[kinds != SPACE], np.flatnonzero(out & END) - begin, owner)
        distinct = np.bincount(owner[new], minlength=len(raw))
    return {"words": words, "distinct": distinct, "capitals": count(UPPER), "points": count(POINT) - 1, "symbols": count(SIGN)}


def text_counts(text: Column) -> Column:
    @F.pandas_udf("words bigint, distinct bigint, capitals bigint, points bigint, symbols bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.audit import transduced
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.DataFrame(transduced(list(texts)))
        settle()

    return run(text)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails) of each row: the letters of the filters that it fails, in alphabetical order.

    A null text is empty and a null part the empty string. E: some row with a lesser id
    has the same text; so a null id fails it never and lets no one fail, and repeated
    rows don't fail by each other.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text_counts(text).alias("c"), F.unhex(F.sha2(text, 256)).alias("digest"))
    c = lambda name: F.col(f"c.{name}")
    checks = {
        "A": c("words") < LEAST_WORDS,
        "B": c("distinct") * 100 < c("words") * LEAST_DISTINCT,
        "C": c("capitals") * 100 > c("points") * MOST_CAPITALS,
        "D": c("symbols") > 0,
    }
    rows = written(made.select("id", "part", "digest", F.concat(*[F.when(bad, letter).otherwise("") for letter, bad in checks.items()]).alias("fails")), "failures")
    copies = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "copies")
    later = F.when(F.col("id") > F.col("first"), "E").otherwise("")
    return rows.join(copies, "digest", "left").select("id", "part", F.concat("fails", later).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with counts of documents within the part.

    kept: left after this step. removed: by this step. redundant: failing this filter,
    but removed before. unique_fails: failing this filter only. good_lost and toxic_lost:
    removed here and labelled of quality 1, or toxic 1. shapley: what the filter removes,
    summed over all orders. Every row counts, repeated ones too; a document with several
    labels is good or toxic if one says so. Without documents there are no rows.
    """
    flag = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(c)
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(flag("quality"), flag("toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(known, "id", "left")
    sets = rows.groupBy("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("bad")).agg(F.count("*").alias("n"))
    sets = written(sets, "sets")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    here, gone = F.contains(F.col("fails"), letter), F.call_function("translate", F.col("fails"), before, F.lit("")) != F.col("fails")
    sum_of = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    counts = steps.withColumns({"letter": letter, "here": here, "gone": gone}).groupBy("part", "filter_order", "step", "letter").agg(
        sum_of(~F.col("here") & ~F.col("gone")).alias("kept"),
        sum_of(F.col("here") & ~F.col("gone")).alias("removed"),
        sum_of(F.col("here") & F.col("gone")).alias("redundant"),
        sum_of(F.col("fails") == F.col("letter")).alias("unique_fails"),
        sum_of(F.col("here") & ~F.col("gone") & F.col("good")).alias("good_lost"),
        sum_of(F.col("here") & ~F.col("gone") & F.col("bad")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def oracle() -> str:
    """DuckDB SQL for the rows of ``audit`` over documents and labels, on its own."""
    word = r"[^\x20\x09-\x0D]+"
    letters = f"(SELECT unnest(string_split('{FILTERS}', '')) AS l)"
    distinct = " AND ".join(f"{x}.l <> {y}.l" for i, x in enumerate("abcde") for y in "abcde"[:i])
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    f AS (
      SELECT doc_id, part, CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
    k AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
    s AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM f LEFT JOIN k USING (doc_id) GROUP BY ALL),
    o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e WHERE {distinct}),
    p AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS letter, CASE WHEN i = 1 THEN '' ELSE filter_order[1:i - 1] END AS before FROM o, range(1, 6) r(i)),
    x AS (SELECT part, filter_order, step, letter, n, good, bad, fails, contains(fails, letter) AS here, translate(fails, before, '') <> fails AS gone FROM s, p),
    y AS (
      SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
        coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND bad), 0) AS toxic_lost
      FROM x GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y"""
