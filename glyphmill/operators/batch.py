"""Batches of encoded pairs within a budget of tokens, padded, with sequence ends and masks.

Packing goes on from row to row, so it is done in parts of bounded size, as a store's
parts are; only ids and lengths enter it, and sequences join by their batch afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.freq import numbered, numbered_within

PAD, UNK, BOS, EOS = 0, 1, 2, 3


def longest(x: str = "x", y: str = "y") -> Column:
    return F.greatest(F.size(x), F.size(y))


def packed(
    rows: DataFrame, max_toks: int, max_sents: int, part: str = "part", order: tuple[str, ...] = ("len", "id"), strict: bool = False, keys: tuple[str, ...] = ("id",), alone: bool = False, seed: int | None = None
) -> DataFrame:
    """(part, keys, batch): rows in order fill a batch until the next would not fit.

    rows: (part, keys, len). A batch of n rows of which the longest has m tokens fits if
    n * m <= max_toks. It also ends once it has more than max_sents rows, or as many if
    strict. A row longer than max_toks raises, or is a batch of its own if alone. Parts must be small enough for one task.
    order: columns of rows, or "draw", a random number of each row made from the seed and its
    keys: ("len", "draw") mixes rows of equal length, ("draw",) all of a part.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        batch, n, widest, out = 0, 0, 0, []
        for size in frame["len"].tolist():
            if size > max_toks and not alone:
                raise ValueError(f"a row has {size} tokens, a batch {max_toks}")
            full = (n + 1) * max(widest, size) > max_toks or (n >= max_sents if strict else n > max_sents)
            if n and full:
                batch, n, widest = batch + 1, 0, 0
            n, widest = n + 1, max(widest, size)
            out.append(batch)
        return frame[["part", *keys]].assign(batch=out)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pack(frame.sort_values(list(order), kind="stable"))

    slim = rows.select(F.col(part).cast("long").alias("part"), *[F.col(k).cast("long").alias(k) for k in keys], F.col("len").cast("long").alias("len"), *[c for c in order if c not in ("len", "draw", part, *keys)])
    slim = slim.withColumn("draw", F.xxhash64(F.lit(seed or 0), *keys)) if "draw" in order else slim
    return slim.groupBy("part").applyInPandas(run, ", ".join(f"{c} long" for c in ("part", *keys, "batch")))


def parts(rows: DataFrame, size: int = 5_000_000, id_col: str = "id") -> Column:
    """The part of each row by ranges of its id."""
    return F.floor(F.col(id_col) / size)


def ends(ids: Column, bos: bool = False, eos: bool = True, absent: bool = False) -> Column:
    """The sequence with BOS and EOS where they are missing. absent: they must be missing, else it raises."""
    has_bos = F.coalesce(F.get(ids, F.lit(0)) == BOS, F.lit(False))
    has_eos = F.coalesce(F.get(ids, F.size(ids) - 1) == EOS, F.lit(False))
    front = F.when(has_bos, F.raise_error(F.lit("it begins with BOS")) if absent else ids).otherwise(F.concat(F.array(F.lit(BOS)), ids))
    out = front if bos else ids
    back = F.when(has_eos, F.raise_error(F.lit("it ends with EOS")) if absent else out).otherwise(F.concat(out, F.array(F.lit(EOS))))
    return back if eos else out


def padded(ids: Column, width: Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids)))


def batches(
    rows: DataFrame, members: DataFrame, longest_first: bool = False, keys: tuple[str, ...] = ("id",), bos: bool = False, eos: bool = True, pad: int = PAD, batch_first: bool = True
) -> DataFrame:
    """(part, batch, ids, x_len, y_len, x_seqs, y_seqs, x_toks, y_toks, max_x_len, max_y_len), a row for each batch.

    rows: (part, keys, x, y), with an id among the keys. Sequences get BOS and EOS as told,
    then are padded to the batch's longest. Without batch_first a batch's sequences are
    turned, so that each row is a place in time.
    """
    first = (-F.size("x") if longest_first else F.lit(0)).alias("o")
    one = F.struct(first, "id", "x", "y")
    ended = rows.withColumns({s: ends(F.col(s), bos, eos) for s in "xy"})
    whole = members.join(ended, ["part", *keys]).groupBy("part", "batch").agg(F.array_sort(F.collect_list(one)).alias("r"))
    side = lambda s: lambda t: t[s]
    whole = whole.withColumns({f"{s}_len": F.transform(F.transform("r", side(s)), F.size) for s in "xy"})
    whole = whole.withColumns({f"max_{s}_len": F.array_max(f"{s}_len") for s in "xy"})
    fit = lambda s: lambda q: padded(q, F.col(f"max_{s}_len"), pad)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
    laid = (lambda c: c) if batch_first else transposed
    return whole.select(
        "part", "batch", F.transform("r", lambda t: t.id).alias("ids"), "x_len", "y_len",
        *[laid(F.transform(F.transform("r", side(s)), fit(s))).alias(f"{s}_seqs") for s in "xy"],
        *[total(f"{s}_len").alias(f"{s}_toks") for s in "xy"], "max_x_len", "max_y_len",
    )


def transposed(seqs: Column) -> Column:
    """Rows of equal length, as columns: for layouts with time first."""
    return F.transform(F.sequence(F.lit(0), F.size(seqs[0]) - 1), lambda j: F.transform(seqs, lambda r: F.get(r, j)))


def causal_mask(n: Column) -> Column:
    """n rows; row i sees 0 .. i."""
    at = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.transform(at, lambda i: F.transform(at, lambda j: j <= i))).otherwise(F.array())


def autoregressive_mask(ids: Column) -> Column:
    """The causal mask without columns of padding."""
    at = F.sequence(F.lit(0), F.size(ids) - 1)
    mask = F.transform(at, lambda i: F.transform(at, lambda j: (j <= i) & (F.get(ids, j) != PAD)))
    return F.when(F.size(ids) > 0, mask).otherwise(F.array())


def slices(rows: DataFrame, order: str, size: int, group: str | None = None) -> DataFrame:
    """``rows`` with ``slice``: consecutive chunks of ``size`` in the order of a key without ties, within each group."""
    placed = numbered(rows, order) if group is None else numbered_within(rows, group, order)
    return placed.withColumn("slice", F.floor(F.col("at") / size)).drop("at")


def neighbours(rows: DataFrame, group: str, order: str, value: str, default: object = None) -> DataFrame:
    """(group, k, first, second): tumbling pairs of neighbours in the order of a key without ties; an odd last one is paired with the default."""
    placed = numbered_within(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("v")), "g", "o")
    side = lambda r: F.max(F.when(F.col("at") % 2 == r, F.struct("v")))["v"]
    last = F.when(F.count("*") == 2, side(1)).otherwise(F.lit(default))
    return placed.groupBy(F.col("g").alias(group), F.floor(F.col("at") / 2).alias("k")).agg(side(0).alias("first"), last.alias("second"))
