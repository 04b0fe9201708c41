"""Batches read from a store, pass by pass: parts in drawn order, records and batches drawn within them.

The reader is a DataFrame over the store, not a source with its own file access: stores may
lie where only Spark's readers reach. A part is packed by one task, as the store bounds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.batch import batches, packed
from glyphmill.operators.freq import numbered
from glyphmill.sources.folder import written

#: The ways to sort.
IN_ORDER, EQUAL_LENGTH, RANDOM = None, "eq_len_rand_batch", "random"
#: Where no number of records is set.
NO_LIMIT = 1 << 62


def draw(seed: int, *columns: Column | str) -> Column:
    """A number of 60 bits from a seed and columns; it is the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *columns)), 1, 15), 16, 10).cast("long")


def with_part(store: DataFrame) -> DataFrame:
    """The store with ``part``: its own column of that name, or else the number of the file that a row comes from."""
    if "part" in store.columns:
        return store
    name = F.input_file_name()
    piece = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return store.withColumn("part", piece(r"part-(\d+)") * 100_000 + piece(r"-c(\d+)\."))


@dataclass(frozen=True)
class BatchReader:
    """Batches of the records (id, x, y) of a store.

    max_toks: a batch of n records whose longest side has m tokens has n * m at most.
    sort_by: IN_ORDER packs records by id, and parts in their order; EQUAL_LENGTH packs by
    length, equal ones drawn, and draws the order of batches within parts and of parts;
    RANDOM draws records within parts, and parts. Each pass (seed) draws anew, the same
    seed gives the same batches. Records with an empty side are left out. A record over
    the budget raises, or is a batch of its own if ``alone``.
    """

    store: DataFrame
    max_toks: int
    max_sents: int = NO_LIMIT
    sort_by: str | None = IN_ORDER
    longest_first: bool = False
    bos: bool = False
    eos: bool = True
    pad: int = 0
    batch_first: bool = True
    alone: bool = False
    keys: tuple[str, ...] = ("id",)

    def __post_init__(self) -> None:
        if self.sort_by not in (IN_ORDER, EQUAL_LENGTH, RANDOM):
            raise ValueError(f"sort_by: {EQUAL_LENGTH}, {RANDOM} or None")

    @property
    def num_items(self) -> int:
        return self.store.count()

    @property
    def num_batches(self) -> int:
        """The records over the budget, rounded up: a guess without packing. ``read(seed).count()`` is the number of batches."""
        return -(-self.num_items // self.max_toks)

    def read(self, seed: int = 0) -> DataFrame:
        """(place, part, batch, ...) as ``operators.batch.batches`` gives them; place counts from 0 in the order of this pass."""
        rows = with_part(self.store).where((F.size("x") > 0) & (F.size("y") > 0))
        rows = rows.withColumns({"len": F.greatest(F.size("x"), F.size("y")), "drawn": draw(seed, *self.keys)})
        order = {IN_ORDER: self.keys, EQUAL_LENGTH: ("len", "drawn", *self.keys), RANDOM: ("drawn", *self.keys)}[self.sort_by]
        members = packed(rows, self.max_toks, self.max_sents, order=order, strict=self.sort_by != EQUAL_LENGTH, keys=self.keys, alone=self.alone)
        found = batches(rows, written(members, "members"), self.longest_first, self.keys, self.bos, self.eos, self.pad, self.batch_first)
        first = [] if self.sort_by is IN_ORDER else [draw(seed, F.lit("part"), "part")]
        within = [draw(seed, F.lit("batch"), "part", "batch")] if self.sort_by == EQUAL_LENGTH else []
        named = found.withColumns({f"_{k}": c for k, c in enumerate([*first, F.col("part"), *within, F.col("batch")])})
        keys = [c for c in named.columns if c.startswith("_")]
        placed = numbered(named.select("part", "batch", *keys), *keys).select("part", "batch", F.col("at").alias("place"))
        return found.join(placed, ["part", "batch"]).select("place", *found.columns)
