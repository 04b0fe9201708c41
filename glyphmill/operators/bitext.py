"""Parallel text: pairs by key or line number, filters, and encoded pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(src: DataFrame, tgt: DataFrame, key: str | list[str], src_text: str = "text", tgt_text: str = "text") -> DataFrame:
    """(id, x, y) of rows with equal keys, or (keys, x, y) for a list of them; pairs with a side that is null or empty are left out."""
    keys = [F.col(key).alias("id")] if isinstance(key, str) else [F.col(k) for k in key]
    a = src.select(*keys, F.col(src_text).alias("x")).where("x <> ''")
    b = tgt.select(*keys, F.col(tgt_text).alias("y")).where("y <> ''")
    return a.join(b, ["id"] if isinstance(key, str) else key)


def pieces(pairs: DataFrame, src: Callable[[Column], Column], tgt: Callable[[Column], Column]) -> DataFrame:
    """``pairs`` with x and y as arrays; pairs with an empty side are left out."""
    return pairs.withColumns({"x": src(F.col("x")), "y": tgt(F.col("y"))}).where((F.size("x") > 0) & (F.size("y") > 0))


def truncated(pairs: DataFrame, src_len: int, tgt_len: int) -> DataFrame:
    return pairs.withColumns({"x": F.slice("x", 1, src_len), "y": F.slice("y", 1, tgt_len)})


def without_long(pairs: DataFrame, src_len: int, tgt_len: int) -> DataFrame:
    """Both sides must be shorter than their limit; just as long is too long."""
    return pairs.where((F.size("x") < src_len) & (F.size("y") < tgt_len))


def without_short(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Pairs whose sides both have so many pieces; a null side has none."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return pairs.where(F.least(size("x"), size("y")) >= least)


def length_report(pairs: DataFrame, src_len: int, tgt_len: int, least: int = 1) -> DataFrame:
    """(n, too_short, too_long, kept) in one row: what ``without_short``, then ``without_long`` would leave out, counted in one pass."""
    x, y = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("x", "y"))
    short = F.least(x, y) < least
    long_ = ~short & ((x >= src_len) | (y >= tgt_len))
    return pairs.agg(F.count("*").alias("n"), F.count_if(short).alias("too_short"), F.count_if(long_).alias("too_long"), F.count_if(~short & ~long_).alias("kept"))


def misaligned(fields: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, field, n): where fields that belong together differ: each key that some field does not have exactly once, and how often each field has it that has it not once.

    Keys are counted in each field before the fields meet, so each meets them once; null
    keys count like others. Fields are aligned if there are no rows.
    """
    counts = None
    for name, rows in fields.items():
        own = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("field", F.lit(name))
        counts = own if counts is None else counts.unionByName(own)
    of = {name: F.coalesce(F.sum(F.when(F.col("field") == name, F.col("n"))), F.lit(0)) for name in fields}
    each = F.array(*[F.struct(F.lit(name).alias("field"), n.alias("n")) for name, n in of.items()])
    wrong = counts.groupBy(*keys).agg(F.filter(each, lambda x: x.n != 1).alias("wrong"))
    return wrong.select(*keys, F.explode("wrong").alias("x")).select(*keys, "x.field", "x.n")


def aligned(fields: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The fields (keys, value) side by side, a column for each; it raises if they don't have the same keys once each."""
    if not misaligned(fields, keys).isEmpty():
        raise ValueError("the fields don't have the same ids")
    out = None
    for name, rows in fields.items():
        own = rows.select(*keys, F.col("value").alias(name))
        out = own if out is None else out.join(own, keys)
    return out
