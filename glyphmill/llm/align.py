"""Operator 12: what tokens of two tokenizers stand for the same bytes, and how usual each such link is.

A text with a space before it is cut where a space stands between two characters that are
no white space. No token of either tokenizer reaches over such a place, and tokens of
both end there; so a unit between two cuts is encoded and aligned once for a batch, and
kept. Inside a unit, the byte offsets where tokens of both end cut both into groups. Each
group ends with one token of each, which are linked; so there are as many links as groups.

Documents are numbered within chunks. For each pair of linked ids a chunk has an inverted
entry of compressed bitmaps over its documents, one for each binary digit of how often
the pair is linked in a document (the planes). OR-merged, the planes tell in which
documents the pair stands; popcounts of that give its document count, and popcounts of
the planes, weighed by their digits, its links. With counts of the whole corpus, the postings of
a chunk are read once more, and give each of its documents its scores. Only bitmaps are
shuffled, no occurrence.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship, written

#: Documents, and links, at which a chunk ends. An ordinal has 16 bits.
CHUNK_DOCS, CHUNK_LINKS = 1 << 16, 3_000_000
#: Units from which on a generation that a worker keeps is full, and the characters up to which it keeps one.
KEPT_UNITS, LONG_UNIT = 200_000, 100
#: A space between two characters that are no white space, for any version of Unicode.
EDGE = re.compile(r"(?<=[^\s\u180e\u200b])(?= [^\s\u180e\u200b])")
#: What tells that a text has other spaces than those.
ROUGH = re.compile(r" [\s\u180e\u200b]|[\s\u180e\u200b] ")
BASE = 1 << 20


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, their tokens' bytes, and the units aligned so far, in two generations: a full one becomes the old one, and what is used of the old one is young again.

    A unit is (tokens of A << 32 | tokens of B, its links as 64-bit codes, its groups as
    text), or None where the bytes differ.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_level()
        entries = self.a.get_vocab()
        self.bytes_a = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in entries.items()}
        coded = re.compile("<0x([0-9A-F]{2})>")
        piece = lambda p: bytes([int(m[1], 16)]) if (m := coded.fullmatch(p)) else p.replace("▁", " ").encode()
        self.bytes_b = [piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if not all(self.bytes_a.values()) or not all(self.bytes_b):
            raise ValueError("a token without bytes ends nowhere")
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def aligned(self, whole: bytes, a: list[int], b: list[int]) -> tuple | None:
        """One unit from its tokens: the side that is behind goes on until both end together."""
        of_a, of_b = [*map(self.bytes_a.__getitem__, a)], [*map(self.bytes_b.__getitem__, b)]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            return None
        codes, groups = [], []
        i = j = from_a = from_b = 0
        end_a, end_b = len(of_a[0]), len(of_b[0])
        while True:
            if end_a < end_b:
                i += 1
                end_a += len(of_a[i])
            elif end_b < end_a:
                j += 1
                end_b += len(of_b[j])
            else:
                codes.append(a[i] * BASE + b[j])
                one = from_a == i and from_b == j
                groups.append(f"{a[i]}|{b[j]}" if one else f"{','.join(map(str, a[from_a : i + 1]))}|{','.join(map(str, b[from_b : j + 1]))}")
                from_a, from_b = i, j = i + 1, j + 1
                if i == len(a):
                    return len(a) << 32 | len(b), array("q", codes).tobytes(), ";".join(groups)
                end_a += len(of_a[i])
                end_b += len(of_b[j])

    def learn(self, units: list[str]) -> None:
        """Align units that are not known yet. Each starts with a space, which the second tokenizer adds by itself."""
        for unit, a, b in zip(units, self.a.encode_batch_fast(units, add_special_tokens=False), self.b.encode([u[1:] for u in units], num_threads=1), strict=True):
            self.young[unit] = self.aligned(unit.encode(), a.ids, b)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, bytes, str]]:
        """(tokens of A, of B, links, groups) of each whole text; zeros and nothing where there are none."""
        cut = [[] if not t else EDGE.split(f" {t}") if " " in (t[0], t[-1]) or ROUGH.search(t) else [f" {w}" for w in t.split(" ")] for t in texts]
        every = set(chain.from_iterable(cut))
        if len(self.young) > KEPT_UNITS:
            self.old, self.young = self.young, {}
        again = (every & self.old.keys()) - self.young.keys()
        self.young.update((u, self.old[u]) for u in again)
        new = list(every - self.young.keys())
        self.learn(new)
        for units in cut:
            found = [*map(self.young.__getitem__, units)]
            if not found or None in found:
                yield 0, 0, b"", ""
            else:
                counts, codes, groups = zip(*found, strict=True)
                both = sum(counts)
                yield both >> 32, both & 0xFFFFFFFF, b"".join(codes), ";".join(groups)
        for u in new:
            if len(u) > LONG_UNIT:
                del self.young[u]


    def forget(self) -> None:
        """Drop the units, so that a worker that waits for other stages keeps the tokenizers only."""
        self.young, self.old = {}, {}


@lru_cache(maxsize=1)
def loaded(path_a: str, path_b: str) -> Pair:
    """The pair of a worker: to load it takes a CPU second, so tasks that follow one another share it."""
    return Pair(path_a, path_b)


def compressed(ordinals: np.ndarray) -> bytes:
    """Sorted ordinals as a bitmap: a list of 16-bit numbers (0 first) or a set of bits (1 first), whichever is shorter."""
    if len(ordinals) * 2 <= int(ordinals[-1]) // 8 + 1:
        return b"\0" + ordinals.astype("<u2").tobytes()
    bits = np.zeros(int(ordinals[-1]) + 1, np.uint8)
    bits[ordinals] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def members(bitmap: bytes) -> np.ndarray:
    if bitmap[0] == 0:
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))


def popcount(bitmap: bytes) -> int:
    return (len(bitmap) - 1) // 2 if bitmap[0] == 0 else int.from_bytes(bitmap[1:], "little").bit_count()


def merged(bitmaps: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    return bitmaps[0] if len(bitmaps) == 1 else compressed(np.unique(np.concatenate([members(b) for b in bitmaps])))


def planes(codes: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Each distinct code, and its bitmaps: plane k has the documents in whose count of the code digit k is set; an empty plane is empty bytes."""
    both, times = np.unique(codes << 16 | ordinals, return_counts=True)
    code, place = both >> 16, both & 0xFFFF
    own, starts = np.unique(code, return_index=True)
    many = np.diff(np.append(starts, len(code)))
    short = place.astype("<u2").tobytes()
    out: list[list[bytes]] = []
    most = np.maximum.reduceat(times, starts)
    for s, n, top in zip(starts.tolist(), many.tolist(), most.tolist(), strict=True):
        if top == 1 and n < 32:
            out.append([b"\0" + short[2 * s : 2 * (s + n)]])
            continue
        t, p = times[s : s + n], place[s : s + n]
        out.append([compressed(p[here]) if (here := t >> k & 1 == 1).any() else b"" for k in range(top.bit_length())])
    return own, out


ROW = pa.schema([("chunk", pa.int64()), ("ordinal", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("code", pa.int64()), ("planes", pa.list_(pa.binary()))])
MADE = "chunk long, ordinal int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, code long, planes array<binary>"


def inverted(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds, as MADE: a document (its place, counts and groups), and a linked pair (code) of a chunk with its planes.

    docs: (id, text). A task numbers its chunks by its partition, so what it writes fits
    together whichever attempt of it is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from glyphmill.llm.align import CHUNK_DOCS, CHUNK_LINKS, ROW, loaded, planes
        from glyphmill.llm.shared import settle

        pair, chunk = None, TaskContext.get().partitionId() << 32
        codes: list[np.ndarray] = []
        places: list[np.ndarray] = []
        ordinal = links = 0

        def entries() -> Iterator[pa.RecordBatch]:
            if links:
                own, bitmaps = planes(np.concatenate(codes), np.concatenate(places))
                for at in range(0, len(own), 20_000):
                    n = len(own[at : at + 20_000])
                    cells = {"chunk": pa.array(np.full(n, chunk)), "code": pa.array(own[at : at + n]), "planes": pa.array(bitmaps[at : at + n], pa.list_(pa.binary()))}
                    yield pa.RecordBatch.from_arrays([cells.get(f.name, pa.nulls(n, f.type)) for f in ROW], schema=ROW)

        for batch in batches:
            pair = pair or loaded(path_a, path_b)
            done: list[tuple] = []
            for i, (n_a, n_b, c, groups) in zip(batch.column(0).to_pylist(), pair.texts(batch.column(1).to_pylist()), strict=True):
                n_links = len(c) // 8
                if ordinal == CHUNK_DOCS or links and links + n_links > CHUNK_LINKS:
                    yield from entries()
                    chunk, ordinal, links = chunk + 1, 0, 0
                    codes.clear()
                    places.clear()
                done.append((chunk, ordinal, i, n_a, n_b, n_links, n_links, hashlib.sha256(groups.encode()).hexdigest() if groups else "", None, None))
                if c:
                    codes.append(np.frombuffer(c, np.int64))
                    places.append(np.full(n_links, ordinal, np.int64))
                ordinal, links = ordinal + 1, links + n_links
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), ROW, strict=True)], schema=ROW)
        yield from entries()
        codes.clear()
        places.clear()
        if pair:
            pair.forget()
        settle()

    return docs.select("id", F.col("text")).mapInArrow(run, MADE)


def counted(entries: DataFrame) -> DataFrame:
    """(code, n_docs, n_links) of pairs: popcounts of the merged planes, and of each plane by its digit."""

    @F.pandas_udf("n_docs bigint, n_links bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.align import merged, popcount

        for rows in batches:
            used = [[(k, p) for k, p in enumerate(ps) if p] for ps in rows]
            yield pd.DataFrame({"n_docs": [popcount(merged([p for _, p in ps])) for ps in used], "n_links": [sum(popcount(p) << k for k, p in ps) for ps in used]})

    both = entries.select("code", run(F.col("planes")).alias("c"))
    return both.groupBy("code").agg(F.sum("c.n_docs").alias("n_docs"), F.sum("c.n_links").alias("n_links"))


SCORED = "chunk long, ordinal int, n_best long, count_sum long"


def scored(entries: DataFrame) -> DataFrame:
    """SCORED from entries (chunk, planes, n_links, best): for each document of a chunk that has links, those of them that are best, and the sum of their counts. A chunk is of bounded size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from glyphmill.llm.align import CHUNK_DOCS, members

        best, total, seen = (np.zeros(CHUNK_DOCS, np.int64) for _ in range(3))
        for ps, n, top in zip(rows["planes"], rows["n_links"].tolist(), rows["best"].tolist(), strict=True):
            for k, p in enumerate(ps):
                if p:
                    at = members(p)
                    seen[at] = 1
                    total[at] += n << k
                    if top:
                        best[at] += 1 << k
        here = np.flatnonzero(seen)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "ordinal": here.astype(np.int32), "n_best": best[here], "count_sum": total[here]})

    return entries.groupBy("chunk").applyInPandas(run, SCORED)


def pair_counts(entries: DataFrame) -> DataFrame:
    """(code, n_docs, n_links, best): best is whether no other pair of its second id has more links."""
    pairs = written(counted(entries), "pair-counts").withColumn("b", F.col("code") % BASE)
    highest = pairs.groupBy("b").agg(F.max("n_links").alias("highest"))
    return pairs.join(highest, "b").select("code", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row of each document, the linked pairs of ids).

    Documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Every
    row counts and gives a row, repeated ones and those without an id too. A text that
    is null or empty, or that one of the tokenizers' tokens don't give back byte by
    byte, has no tokens: zeros, and no digest. Pairs: id_a, id_b, n_docs, n_links, best.
    An empty table gives no rows and no pairs.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = written(inverted(rows, path_a, path_b), "aligned")
    entries = made.where("code is not null").select("chunk", "code", "planes")
    pairs = written(pair_counts(entries), "pairs")
    scores = written(scored(entries.join(pairs.select("code", "n_links", "best"), "code").select("chunk", "planes", "n_links", "best")), "scores")
    counts = ("n_a", "n_b", "n_groups", "n_links")
    found = made.where("code is null").select("chunk", "ordinal", "id", *counts, "groups_sha256").join(scores, ["chunk", "ordinal"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = pairs.select(F.floor(F.col("code") / BASE).cast("int").alias("id_a"), (F.col("code") % BASE).cast("int").alias("id_b"), "n_docs", "n_links", "best")
    return found.select("id", *counts, zero("n_best"), zero("count_sum"), "groups_sha256"), known
