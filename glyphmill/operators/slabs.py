"""What a task does with many sequences of symbols at once: a slab of them is one flat array, with a 0 after each.

A symbol (``merges.symbol``) is four bytes of UTF-8 and stands here as its place: its code
point less U+FFFF, so that places are in the order of the symbols and begin at 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of a slab, about.
SLAB = 1 << 20
#: Bits of a place, and what takes a pair's right place out of it.
BITS = 21
RIGHT = (1 << BITS) - 1

Step = Callable[["Slab"], Iterable[tuple[pa.Array, np.ndarray]]]


def bytes_of(places: np.ndarray) -> np.ndarray:
    """The UTF-8 of symbols, four bytes for each."""
    point = places.astype(np.uint32) + np.uint32(0xFFFF)
    out = (point >> 18 | 0xF0) << 24 | (point >> 12 & 0x3F | 0x80) << 16 | (point >> 6 & 0x3F | 0x80) << 8 | (point & 0x3F | 0x80)
    return out.astype(">u4").view(np.uint8)


def places_of(data: np.ndarray) -> np.ndarray:
    b = data.view(">u4").astype(np.uint32)
    return (((b >> 24 & 0x07) << 18 | (b >> 16 & 0x3F) << 12 | (b >> 8 & 0x3F) << 6 | (b & 0x3F)) - np.uint32(0xFFFF)).astype(np.int32)


def strings(places: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of so many symbols each, one after the other."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * 4, out=ends[1:])
    made = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bytes_of(places))))
    return made.cast(pa.string())


def places_of_types(idx: np.ndarray) -> np.ndarray:
    """Places of the symbols of types: two code points of each plane are no symbols."""
    return idx + 1 + 2 * (idx // 0xFFFE)


def spelled(words: pa.Array, table: dict[str, int], unknown: int) -> pa.Array:
    """Words as symbols of their characters, or as one symbol where the table knows the whole word."""
    listed = words.to_pylist()
    points = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
    chars = np.array(sorted(ord(c) for c in table if len(c) == 1), np.uint32)
    types = np.array([table[chr(c)] for c in chars.tolist()], np.int64)
    at = np.minimum(np.searchsorted(chars, points), max(len(chars) - 1, 0))
    idx = np.where(chars[at] == points, types[at], unknown) if len(chars) else np.full(len(points), unknown)
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    whole = [table.get(w) if len(w) > 1 else None for w in listed]
    if own := [k for k, i in enumerate(whole) if i is not None]:
        first = np.cumsum(lengths) - lengths
        stays = np.ones(len(idx), bool)
        for k in own:
            stays[first[k] + 1 : first[k] + lengths[k]] = False
            idx[first[k]], lengths[k] = whole[k], 1
        idx = idx[stays]
    return strings(places_of_types(idx), lengths)


def encoded(words: pa.ListArray, one: Callable[[str], list[int]], empty: int) -> tuple[np.ndarray, np.ndarray]:
    """(types, lengths) of rows of words, where ``one`` gives a word's types; each word that the rows hold is asked for once. A row without words is ``empty``."""
    coded = words.flatten().dictionary_encode()
    each = [one(w) for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    types = np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum()))
    word = coded.indices.to_numpy()
    size = sizes[word]
    ends = np.r_[0, np.cumsum(size)]
    idx = types[np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], size) + np.arange(ends[-1])]
    rows = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
    lengths = np.diff(rows)
    lone = np.flatnonzero(lengths == 0)
    lengths[lone] = 1
    return np.insert(idx, rows[lone], empty), lengths


def clipped(idx: np.ndarray, lengths: np.ndarray, drop: bool) -> pa.Array:
    """Rows of types as symbols. Where one stands three times or more in a row it is clipped to two, or the row becomes null."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    third = np.zeros(len(idx), bool)
    third[2:] = (idx[2:] == idx[1:-1]) & (idx[2:] == idx[:-2]) & (row[2:] == row[:-2])
    if drop:
        out = np.zeros(len(lengths), bool)
        out[row[third]] = True
        return pc.if_else(pa.array(out), pa.scalar(None, pa.string()), strings(places_of_types(idx), lengths))
    return strings(places_of_types(idx[~third]), lengths - np.bincount(row[third], minlength=len(lengths)))


def place(sym: str) -> int:
    return ord(sym) - 0xFFFF


def key(pair: str) -> int:
    return place(pair[0]) << BITS | place(pair[1])


def pair_of(number: int) -> str:
    return chr((number >> BITS) + 0xFFFF) + chr((number & RIGHT) + 0xFFFF)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its values; without those whose sum is 0."""
    if not len(keys):
        return keys, values
    most = int(max((keys >> BITS).max(), (keys & RIGHT).max())) + 1
    if most * most <= len(keys):  # few symbols: a table of all pairs
        sums = np.bincount((keys >> BITS) * most + (keys & RIGHT), values, most * most).astype(np.int64)
        some = np.flatnonzero(sums)
        return some // most << BITS | some % most, sums[some]
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.add.reduceat(values, first)
    return keys[first][sums != 0], sums[sums != 0]


class Slab:
    """Sequences of symbols with how often each counts."""

    def __init__(self, columns: list[pa.Array], counts: list[np.ndarray]):
        data, lengths = [], []
        for c in columns:
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            data.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
            lengths.append(np.diff(ends) // 4)
        size, n = np.concatenate(lengths), np.concatenate(counts)
        #: Places, with a 0 after each sequence, and how often each place counts.
        self.at = np.zeros(int(size.sum()) + len(size), np.int32)
        self.n = np.repeat(n, size + 1)
        self.at[np.arange(len(self.at) - len(size)) + np.repeat(np.arange(len(size)), size)] = places_of(np.concatenate(data))

    def copy(self) -> Slab:
        out = object.__new__(Slab)
        out.at, out.n = self.at.copy(), self.n.copy()
        return out

    def pairs(self, here: np.ndarray | slice, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that begin at these places, within sequences, and how often they count."""
        left, right, n = self.at[:-1][here], self.at[1:][here], self.n[:-1][here]
        inside = (left != 0) & (right != 0)
        return left[inside].astype(np.int64) << BITS | right[inside], n[inside] * sign

    @classmethod
    def of(cls, rows: pa.Table) -> Slab:
        """Of a collected table (s, n)."""
        s, n = rows["s"].cast(pa.string()), rows["n"].to_numpy().astype(np.int64)
        return cls(s.chunks or [pa.array([], pa.string())], [n])

    def merge(self, wave: list[str], told: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges that share no symbol, each a string of the pair and the new symbol. told: returns how often pairs went and came."""
        top = max(max(map(place, m)) for m in wave) + 1
        top = max(top, int(self.at.max(initial=0)) + 1)
        partner, new = np.full(top, -1, np.int32), np.zeros(top, np.int32)
        for left, right, made in wave:
            partner[place(left)], new[place(left)] = place(right), place(made)
        hits = np.flatnonzero(partner[self.at[:-1]] == self.at[1:])
        if not len(hits):
            return []
        # neighbouring hits are a run of one symbol, where every second is merged
        count = np.arange(len(hits))
        begins = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], count, 0))
        hits = hits[(count - begins) % 2 == 0]
        out = []
        if told:
            near = np.zeros(len(self.at), bool)
            near[hits] = near[np.maximum(hits - 1, 0)] = near[hits + 1] = True
            out.append(self.pairs(np.flatnonzero(near[:-1]), -1))
        self.at[hits] = new[self.at[hits]]
        stays = np.ones(len(self.at), bool)
        stays[hits + 1] = False
        self.at, self.n = self.at[stays], self.n[stays]
        if told:
            hits = hits - np.arange(len(hits))
            near = np.zeros(len(self.at), bool)
            near[hits] = near[np.maximum(hits - 1, 0)] = True
            out.append(self.pairs(np.flatnonzero(near[:-1])))
        return out

    def cut(self, live: np.ndarray) -> None:
        """Sequences end wherever no pair of ``live`` (sorted keys) stands; what is left alone goes."""
        most = int(self.at.max(initial=0)) + 1
        if most * most <= len(self.at):
            table = np.zeros(most * most, bool)
            known = live[((live >> BITS) < most) & ((live & RIGHT) < most)]
            table[(known >> BITS) * most + (known & RIGHT)] = True
            joined = table[self.at[:-1].astype(np.int64) * most + self.at[1:]]
        else:
            pairs = self.at[:-1].astype(np.int64) << BITS | self.at[1:]
            place = np.minimum(np.searchsorted(live, pairs), max(len(live) - 1, 0))
            joined = live[place] == pairs if len(live) else np.zeros(len(pairs), bool)
        before, after = np.r_[False, joined], np.r_[joined, False]
        # a piece is a run of joined places; its last one is not joined with what follows
        kept = before | after
        lasts = before & ~after
        size = kept + lasts.astype(np.int64)  # each last place is followed by a 0
        where = np.cumsum(size) - size
        at, n = np.zeros(int(size.sum()), np.int32), np.zeros(int(size.sum()), np.int64)
        at[where[kept]], n[where[kept]] = self.at[kept], self.n[kept]
        n[where[lasts] + 1] = self.n[lasts]
        self.at, self.n = at, n

    def rows(self) -> tuple[pa.Array, np.ndarray]:
        """The sequences as strings, and how often each counts."""
        ends = np.flatnonzero(self.at == 0)
        return strings(self.at[self.at != 0], np.diff(np.r_[-1, ends]) - 1), self.n[ends]


def changes_of(slab: Slab, wave: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): how a slab's counts of pairs change by a wave of merges, which are made in it."""
    return joined(slab.merge(wave, told=True))


def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def pair_rows(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Pairs as strings, each once, and their sums."""
    keys, sums = joined(found)
    both = np.stack([keys >> BITS, keys & RIGHT], axis=1).reshape(-1)
    return strings(both, np.full(len(keys), 2)), sums


def over_slabs(words: DataFrame, one: Step, schema: str) -> DataFrame:
    """What ``one`` yields of each slab of the words (s, n), as rows of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[pa.Array] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for first, second in one(Slab(columns, counts)) if columns else ():
                second = second if isinstance(second, pa.Array) else pa.array(second, pa.int64())
                yield pa.RecordBatch.from_arrays([first, second], names=names)

        for batch in batches:
            if batch.num_rows:
                columns.append(batch.column(0).cast(pa.string()))
                counts.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
                size += columns[-1].nbytes // 4
            if size >= SLAB:
                yield from flush()
                columns, counts, size = [], [], 0
        yield from flush()

    names = [part.split()[0] for part in schema.split(",")]
    return words.select("s", "n").mapInArrow(run, schema)


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, freq) of adjacent symbols; overlaps count."""

    def one(slab: Slab) -> Iterator[tuple[pa.Array, np.ndarray]]:
        yield pair_rows([slab.pairs(slice(None))])

    return over_slabs(words, one, "pair string, freq bigint").groupBy("pair").agg(F.sum("freq").alias("freq"))


def pair_changes(words: DataFrame, waves: list[list[str]]) -> DataFrame:
    """(pair, freq): how counts change when words undergo waves of merges."""

    def one(slab: Slab) -> Iterator[tuple[pa.Array, np.ndarray]]:
        yield pair_rows([found for wave in waves for found in slab.merge(wave, told=True)])

    return over_slabs(words, one, "pair string, freq bigint").groupBy("pair").agg(F.sum("freq").alias("freq")).where("freq <> 0")


def step_changes(words: DataFrame, before: list[list[str]], steps: list[str]) -> DataFrame:
    """(at, freq): how counts change when words, after the waves of merges ``before``, undergo steps one by one. at: the step's number, and the pair's key below it."""

    def one(slab: Slab) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for wave in before:
            slab.merge(wave)
        for k, step in enumerate(steps):
            keys, sums = changes_of(slab, [step])
            yield pa.array(keys + (k << 2 * BITS)), sums

    return over_slabs(words, one, "at bigint, freq bigint").groupBy("at").agg(F.sum("freq").alias("freq")).where("freq <> 0")


def after(words: DataFrame, waves: list[list[str]]) -> DataFrame:
    """(s, n) of words after waves of merges."""

    def one(slab: Slab) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for wave in waves:
            slab.merge(wave)
        yield slab.rows()

    return over_slabs(words, one, "s string, n bigint")


def pieces(words: DataFrame, waves: list[list[str]], live: list[str]) -> DataFrame:
    """(s, n) of what the words' pieces between places without a pair of ``live`` are after waves of merges, each once for a slab."""
    sent = np.array(sorted(map(key, live)), np.int64)

    def one(slab: Slab) -> Iterator[tuple[pa.Array, pa.Array]]:
        for wave in waves:
            slab.merge(wave)
        slab.cut(sent)
        s, n = slab.rows()
        both = pa.table({"s": s, "n": pa.array(n)}).group_by("s").aggregate([("n", "sum")]).combine_chunks()
        if both.num_rows:
            yield both["s"].chunk(0), both["n_sum"].chunk(0)

    return over_slabs(words, one, "s string, n bigint")


def made(words: DataFrame, merges: list[tuple[int, str]]) -> DataFrame:
    """(idx, n): how often each merge (idx, pair and new symbol) is made when they are done one by one."""

    def one(slab: Slab) -> Iterator[tuple[pa.Array, np.ndarray]]:
        n = []
        for _, step in merges:
            before = int(slab.n.sum())
            slab.merge([step])
            n.append(before - int(slab.n.sum()))
        yield pa.array([idx for idx, _ in merges], pa.int32()), np.array(n, np.int64)

    return over_slabs(words, one, "idx int, n bigint").groupBy("idx").agg(F.sum("n").alias("n"))
