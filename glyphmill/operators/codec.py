"""Encoding texts to ids and decoding them: words, characters, classes, bytes and subwords.

A vocabulary whose size was measured to be small goes to all executors, and a row's
pieces are looked up inside the row, in Arrow batches: no token is shuffled. A larger
one is joined on distinct pieces, so none has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.vocab import UNK
from glyphmill.sources.folder import written

#: The types, and the characters of their names, up to which a vocabulary is sent to all executors.
SENT_TYPES, SENT_CHARS = 500_000, 8_000_000


def small_table(vocab: DataFrame, key: str, value: str) -> dict | None:
    """The vocabulary as a dictionary if its measured size allows to send it; of equal keys the least value counts."""
    n, chars = vocab.agg(F.count("*"), F.coalesce(F.sum(F.char_length("name")), F.lit(0))).first()
    if n > SENT_TYPES or chars > SENT_CHARS:
        return None
    return {r[key]: r["v"] for r in vocab.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("v")).collect()}


def mapped(rows: DataFrame, items: Column, one: Callable[[dict, np.ndarray], list], table: dict, kind: str) -> Column:
    """A column made from each row's array of items and the table sent to all executors; null stays null."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for arrays in batches:
            yield pd.Series([None if a is None else one(known, a) for a in arrays], dtype=object)

    return run(items)


def with_row(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """(keys, row, columns): a number for each row, written so that it stays; rows with equal keys stay apart. Names from ``_`` on are free: keys may be called anything else."""
    return written(rows.select(*keys, F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in columns.items()]), "rows")


def encode_pieces(rows: DataFrame, keys: list[str], pieces: Column, vocab: DataFrame, unknown: int = UNK) -> DataFrame:
    """(keys, ids): each piece's index, ``unknown`` where there is none; a row without pieces has no ids.

    Every row gives one row, also where keys are equal. Of equal names in the vocabulary
    the least index counts.
    """
    if (table := small_table(vocab, "name", "idx")) is not None:

        def look_up(known: dict, names: np.ndarray) -> list:
            return [known.get(n, unknown) for n in names]

        ids = F.coalesce(mapped(rows, pieces, look_up, table, "array<int>"), F.array().cast("array<int>"))
        return rows.select(*keys, ids.alias("ids"))
    names = vocab.groupBy(F.col("name").alias("_name")).agg(F.min("idx").alias("_idx"))
    at = with_row(rows, keys, _items=pieces).select(*keys, "_row", F.posexplode_outer("_items").alias("_at", "_name"))
    found = at.join(names, "_name", "left")
    one = F.struct("_at", F.coalesce("_idx", F.lit(unknown)).alias("_idx"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), one))), lambda x: x["_idx"])
    return found.groupBy(*keys, "_row").agg(ids.alias("ids")).drop("_row")


def encode_words(rows: DataFrame, keys: list[str], vocab: DataFrame, text: str = "text") -> DataFrame:
    return encode_pieces(rows, keys, T.words(F.col(text)), vocab)


def encode_chars(rows: DataFrame, keys: list[str], vocab: DataFrame, text: str = "text") -> DataFrame:
    return encode_pieces(rows, keys, T.char_pieces(F.col(text)), vocab)


def encode_class(rows: DataFrame, keys: list[str], vocab: DataFrame, label: str) -> DataFrame:
    """The whole stripped label is one piece; -1 is unknown."""
    return encode_pieces(rows, keys, F.array(T.strip(F.col(label))), vocab, -1)


def encode_bytes(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return rows.select(*keys, T.byte_ids(F.col(text)).alias("ids"))


def names_of(rows: DataFrame, keys: list[str], vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """(keys, pieces): the name of each id, in order. An id outside the vocabulary raises. Every row gives one row."""
    if (table := small_table(vocab, "idx", "name")) is not None:

        def look_up(known: dict, numbers: np.ndarray) -> list:
            try:
                return [known[i] for i in numbers]
            except KeyError as e:
                raise ValueError("an id is not in the vocabulary") from e

        pieces = F.coalesce(mapped(rows, F.col(ids), look_up, table, "array<string>"), F.array().cast("array<string>"))
        return rows.select(*keys, pieces.alias("pieces"))
    names = vocab.select(F.col("idx").alias("_idx"), F.col("name").alias("_name"))
    at = with_row(rows, keys, _items=F.col(ids)).select(*keys, "_row", F.posexplode_outer("_items").alias("_at", "_idx")).join(names, "_idx", "left")
    bad = F.col("_idx").isNotNull() & F.col("_name").isNull()
    one = F.when(bad, F.raise_error(F.lit("an id is not in the vocabulary"))).otherwise(F.when(F.col("_at").isNotNull(), F.struct("_at", "_name")))
    return at.groupBy(*keys, "_row").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_name"]).alias("pieces")).drop("_row")


JOINERS = {"word": T.join_words, "char": T.join_chars, "subword": T.join_subwords, "class": lambda p: F.array_join(p, ",")}


def decode(rows: DataFrame, keys: list[str], vocab: DataFrame, kind: str, ids: str = "ids") -> DataFrame:
    """(keys, text)."""
    return names_of(rows, keys, vocab, ids).select(*keys, JOINERS[kind](F.col("pieces")).alias("text"))


def decode_bytes(rows: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(keys, text) of byte values; `<s>` (256) and `</s>` (257) stand as they are, what is no UTF-8 between them as U+FFFD."""
    piece = lambda b: F.when(b == 256, "<s>").when(b == 257, "</s>").otherwise(F.lpad(F.lower(F.hex(b.cast("long"))), 2, "0"))
    runs = F.regexp_extract_all(F.array_join(F.transform(ids, piece), ""), F.lit("</?s>|(?:[0-9a-f]{2})+"), F.lit(0))
    part = lambda r: F.when(r.startswith("<"), r).otherwise(F.make_valid_utf8(F.unhex(r).cast("string")))
    return rows.select(*keys, F.array_join(F.transform(runs, part), "").alias("text"))
