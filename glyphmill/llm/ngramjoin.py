"""Operator 11: documents whose sets of word n-grams are similar by Jaccard, joined by R-trees of count vectors.

A document's set is a point: its n-grams are hashed into ``DIMS`` groups, and the counts
of the groups are its coordinates. Two sets have at most the sum of the lesser
coordinates in common. So of two boxes of points no pair is similar whose sum of lesser
upper ends is too small, and pairs of points are bounded likewise before their sets are compared.

One tree over all points can't tell documents of one length apart: their coordinates
vary less than what may differ. So the first level of the index is exact in another way,
by pigeonholes. A set is hashed into more cells than two similar sets may differ in, so
some cell is the same in both. Cells with the same members are one region of the index;
a set is entered in as many regions as it may have differences, and one more. Below a
region, points are packed into pages in the order of their interleaved coordinates,
pages into pages, and a region's tree is joined with itself from the top down. A page is
one row with all its entries, so a join makes a row for two pages, not for two entries.

Equal sets are one point. Before the trees, each region's points are tried with one
point of it, drawn anew for each region: large groups of copies are linked by that, and
the trees skip pages that are linked already. What they return is exact: no link
between different classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.neardup import LISTED_NODES, components, joined, mix
from glyphmill.llm.shared import ship, written
from glyphmill.operators.freq import numbered

WIDTH = 3
#: The limit is SIMILAR / 100: sets are linked if 100 * intersection >= SIMILAR * union.
SIMILAR = 90
DIMS = 128
#: Entries of a page.
FAN = 32
#: Regions that an entry names: its first ones, from which pages see whether two entries meet in an earlier region.
NAMED = 16
#: Members from which a cell tells sets apart; cells with fewer are entered only where others don't suffice.
STRONG = 2
G1, G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct n-grams, sorted: A-Z in lower case, words between ASCII white space; fewer words than WIDTH are one n-gram."""
    words = text.encode().lower().split() if text else []  # of bytes, both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WIDTH, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        total = mix(total * G1 + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def differences(n: int) -> int:
    """The most members that a set of n and one that is similar to it don't share: with sizes n <= m and J the limit, (n + m) (1 - J) / (1 + J), m being n / J at most."""
    return (n + n * 100 // SIMILAR) * (100 - SIMILAR) // (100 + SIMILAR)


@cache
def levels(most: int) -> list[tuple[int, int]]:
    """(differences up to which a level serves, its cells), up to one that serves ``most``. Each has a quarter more cells than needed, so that cells with few members can be left out."""
    out = [(1, 3)]
    while out[-1][0] < most:
        d = max(out[-1][0] + 1, out[-1][0] * 7 // 5)
        out.append((d, -(-(d + 1) * 5 // 4)))
    return out


def regions(grams: np.ndarray) -> np.ndarray:
    """The regions that a set is entered in.

    Sets of sizes n <= m meet at the level of m, so a set enters the levels of all sizes
    up to that of its largest partner. At most ``differences`` cells are not the same in
    both; take the first cell with STRONG members that is the same. Before it each set has
    at most that many cells with STRONG members, so it is among the first of each set,
    one more than it may have differences. If there is none, both sets have at most so many
    such cells in all, and then both enter all their cells.
    """
    n = len(grams)
    enough = differences(n) + 1
    if enough == 1:
        return np.zeros(0, np.int64)  # only equal sets are similar
    steps = levels(1 << max(4, differences(n * 100 // SIMILAR).bit_length()))
    level = lambda size: next(k for k, (d, _) in enumerate(steps) if d >= differences(size))
    out = []
    for k in range(level(n), level(n * 100 // SIMILAR) + 1):
        cells = steps[k][1]
        cell = (mix(grams + np.full(1, k, np.uint64) * G2) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        there, starts = np.unique(cell[order], return_index=True)
        sums, many = np.zeros(cells, np.uint64), np.zeros(cells, np.int64)
        sums[there] = np.add.reduceat(mix(grams[order] * G1), starts)
        many[there] = np.diff(np.append(starts, n))
        strong = np.flatnonzero(many >= STRONG)
        chosen = strong[:enough] if len(strong) >= enough else np.arange(cells)
        names = (np.uint64(k) << np.uint64(32) | chosen.astype(np.uint64)) * G2
        out.append(mix(sums[chosen] * G1 + mix(names + many[chosen].astype(np.uint64))))
    return np.concatenate(out).view(np.int64)


def point(grams: np.ndarray) -> np.ndarray:
    """The counts of a set's members by group."""
    return np.bincount((mix(grams ^ G1) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)


def interleaved(counts: np.ndarray) -> int:
    """The place of a point in the order of pages: two binary digits of 32 sums of coordinates, by how each lies to the mean, all first digits first."""
    sums = counts.reshape(32, -1).sum(axis=1)
    mean = max(1.0, sums.mean())
    digits = np.clip((sums - mean) / np.sqrt(mean) + 2, 0, 3).astype(np.uint8)
    return int(np.packbits(np.concatenate([digits >> 1, digits & 1])).view(">i8")[0])


def packed(counts: np.ndarray) -> bytes:
    """Coordinates in as many bytes each as the greatest one needs: 1, 2 or 4."""
    return counts.astype(f"<u{1 if (top := counts.max(initial=0)) < 256 else 2 if top < 1 << 16 else 4}").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Coordinates of several points, a row each."""
    return np.stack([np.frombuffer(p, f"<u{len(p) // DIMS}").astype(np.uint32) for p in points])


def within_reach(highs: np.ndarray, other: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the sums of lesser upper ends let sets, whose sizes are ``least`` together at least, be similar."""
    return np.minimum(highs, other).sum(axis=-1, dtype=np.int64) * (100 + SIMILAR) >= least * SIMILAR


def described(text: str | None) -> tuple:
    """(size, two hashes of the whole set, coordinates, place, regions)."""
    grams = ngrams(text)
    counts = point(grams)
    data = grams.tobytes()
    digest = (x & (1 << 63) - 1 for x in (xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, 1)))
    return len(grams), *digest, packed(counts), interleaved(counts), regions(grams).tolist()


DESCRIBED = ["n", "high", "low", "c", "z", "regions"]


def descriptions(text: Column) -> Column:
    @F.pandas_udf("n bigint, high bigint, low bigint, c binary, z bigint, regions array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.ngramjoin import DESCRIBED, described
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.DataFrame([described(t) for t in texts], columns=DESCRIBED)
        settle()

    return run(text)


def sets(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.ngramjoin import ngrams
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.Series([ngrams(t).tobytes() for t in texts], dtype=object)
        settle()

    return run(text)


def alike(a: Column, b: Column) -> Column:
    """Whether two sets, as ``sets`` gives them, reach the limit."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both * (100 + SIMILAR) >= SIMILAR * (len(x) + len(y)))
            yield pd.Series(out, dtype=bool)

    return run(a, b)


def reaches(of_a: Column, of_b: Column) -> Column:
    """Whether two points (n, c) are within reach of one another."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        from glyphmill.llm.ngramjoin import unpacked, within_reach

        for a, b in batches:
            yield pd.Series(within_reach(unpacked(list(a["c"])), unpacked(list(b["c"])), (a["n"] + b["n"]).to_numpy()) if len(a) else [], dtype=bool)

    return run(of_a, of_b)


def met_before(region: int, lefts: list[np.ndarray], rights: list[np.ndarray]) -> np.ndarray:
    """Whether two entries name a common region that comes before this one, for all pairs of both sides.

    Entries name their first regions in order. If two have a common name, the least is
    the first region of all that they share: an earlier one would be among the first of both. So
    such a pair is left to one region; a pair without a common name is left to none.
    """
    both = [*lefts, *rights]
    names, at = np.unique(np.concatenate(both), return_inverse=True)
    has = np.zeros((len(both), len(names)), np.float32)
    has[np.repeat(np.arange(len(both)), [len(x) for x in both]), at] = 1
    has = has[:, names < region]
    return has[: len(lefts)] @ has[len(lefts) :].T > 0


def pages_of(entries: DataFrame) -> DataFrame:
    """(region, page, entries): FAN entries are one page, a bounded row.

    entries: (region, page, low, high, n, c, regions): an entry's number, the least and the greatest label
    below it, the size of its least set, the upper ends of its coordinates, and the regions it names.
    """
    one = F.struct("page", "low", "high", "n", "c", "regions")
    return written(entries.groupBy("region", F.floor(F.col("page") / FAN).alias("parent")).agg(F.collect_list(one).alias("entries")).withColumnRenamed("parent", "page"), "pages")


def boxes_of(pages: DataFrame) -> DataFrame:
    """The pages as entries of pages above them."""

    @F.pandas_udf("binary")
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.ngramjoin import packed, unpacked

        for rows in batches:
            yield pd.Series([packed(unpacked([e["c"] for e in row]).max(axis=0)) for row in rows], dtype=object)

    of = lambda f, name: f(F.transform("entries", lambda e: e[name]))
    return pages.select("region", "page", of(F.array_min, "low").alias("low"), of(F.array_max, "high").alias("high"), of(F.array_min, "n").alias("n"), ends(F.col("entries")).alias("c"), F.array().cast("array<bigint>").alias("regions"))


def opened(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(region, i, j), i <= j: the pairs of entries of two pages that may be similar, have not one label only and don't meet in an earlier region. pairs: (region, i, j), i <= j."""

    @F.pandas_udf("array<struct<i:bigint,j:bigint>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from glyphmill.llm.ngramjoin import met_before, unpacked, within_reach

        for regions, lefts, rights in batches:
            out = []
            for region, left, right in zip(regions.tolist(), lefts, rights, strict=True):
                of = lambda page, name: np.array([e[name] for e in page], np.int64)
                a, b = (unpacked([e["c"] for e in page]) for page in (left, right))
                hit = np.stack([within_reach(x, b, n + of(right, "n")) for x, n in zip(a, of(left, "n"), strict=True)])
                hit &= (of(left, "low")[:, None] != of(right, "high")) | (of(left, "high")[:, None] != of(right, "low"))
                i, j = of(left, "page"), of(right, "page")
                hit &= i[:, None] <= j
                hit &= ~met_before(region, *([np.asarray(e["regions"], np.int64) for e in page] for page in (left, right)))
                x, y = np.nonzero(hit)
                out.append([{"i": p, "j": q} for p, q in zip(i[x].tolist(), j[y].tolist(), strict=True)])
            yield pd.Series(out, dtype=object)

    of = lambda side: pages.select("region", F.col("page").alias(side), F.col("entries").alias(f"of_{side}"))
    alone = pairs.where("i = j").join(of("i"), ["region", "i"]).select("region", "of_i", F.col("of_i").alias("of_j"))
    both = pairs.where("i < j").join(of("i"), ["region", "i"]).join(of("j"), ["region", "j"]).select("region", "of_i", "of_j")
    return alone.unionByName(both).select("region", F.explode(run(F.col("region"), F.col("of_i"), F.col("of_j"))).alias("x")).select("region", "x.i", "x.j")


def tree_pairs(members: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b), a < b: the nodes of one region with different labels whose points may be similar. members: (region, label, node); points: (node, n, c, z), unique by node."""
    ordered = members.join(points.select("node", "z"), "node").select("region", "label", "z", "node")
    placed = written(numbered(ordered, "region", "label", "z", "node"), "placed")
    first = placed.groupBy("region").agg(F.min("at").alias("first"))
    places = written(placed.join(first, "region").select("region", "label", "node", (F.col("at") - F.col("first")).alias("page")), "places")
    named = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("region")), 1, NAMED).alias("regions"))
    entries = places.join(points.select("node", "n", "c"), "node").join(named, "node").select("region", "page", F.col("label").alias("low"), F.col("label").alias("high"), "n", "c", "regions")
    tops = places.groupBy("region").agg(F.max("page").alias("most"))
    steps = [pages_of(entries)]
    most = (tops.agg(F.max("most")).first()[0] or 0) // FAN
    while most:
        steps.append(pages_of(boxes_of(steps[-1])))
        most //= FAN
    tops, pairs, zero = written(tops, "tops"), None, F.lit(0).cast("long")
    for k in range(len(steps) - 1, -1, -1):
        # the regions whose whole tree is one page at this level
        here = tops.where((F.col("most") < FAN ** (k + 1)) & (F.col("most") >= (FAN**k if k else 0)))
        start = here.select("region", zero.alias("i"), zero.alias("j"))
        pairs = written(opened(start if pairs is None else pairs.unionByName(start), steps[k]), "page-pairs")
    of = lambda side, name: places.select("region", F.col("page").alias(side), F.col("node").alias(name))
    named = pairs.where("i < j").join(of("i", "x"), ["region", "i"]).join(of("j", "y"), ["region", "j"])
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def told_apart(members: DataFrame) -> DataFrame:
    """The members (region, node) of one region of all those with the same members: near copies share most of their regions."""
    one, two = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    named = members.groupBy("region").agg(F.count("*").alias("many"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    kept = named.groupBy("many", "x", "y").agg(F.min("region").alias("region")).select("region")
    return written(members.join(written(kept, "told-apart"), "region"), "members")


def linked(pairs: DataFrame, points: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar: bounded by their points first, then by their sets."""
    of = lambda side: points.select(F.col("node").alias(side), F.struct("n", "c").alias(f"of_{side}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(reaches(F.col("of_a"), F.col("of_b"))).select("a", "b")
    whole = lambda side, name: grams.select(F.col("node").alias(side), F.col("grams").alias(name))
    both = near.join(whole("a", "x"), "a").join(whole("b", "y"), "b")
    return written(both.where(alike(F.col("x"), F.col("y"))).select("a", "b"), "links")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) of each row: the size of its set, and the least id that links reach from it, itself included.

    Equal sets are linked, so repeated rows and texts that differ in white space or the
    case of A-Z only are too. Texts that are null, empty or without words have an empty set
    and are linked with nothing. Null ids name no component; one with no other id is null.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    made = written(base.select("id", "hash", descriptions(F.col("text")).alias("d")).select("id", "hash", "d.*"), "described")
    own = made.where("n > 0").groupBy("high", "low", "n").agg(F.min("id").alias("id"), F.min_by(F.struct("id", "hash"), F.struct(F.col("id").isNull(), "id", "hash")).alias("one"), F.first("c").alias("c"), F.first("z").alias("z"), F.first("regions").alias("regions"))
    nodes = written(own.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", F.explode("regions").alias("region"))
    shared = entries.groupBy("region").agg(F.count("*").alias("many"), F.min("node").alias("a"), F.max("node").alias("b")).where("many > 1")
    shared = written(shared, "regions")
    two = written(shared.where("many = 2").select("a", "b").distinct(), "two")
    members = told_apart(written(entries.join(shared.where("many > 2").select("region"), "region"), "members"))
    inside = members.select("node").union(two.select("a")).union(two.select("b")).distinct()
    points = written(nodes.join(inside, "node", "left_semi").drop("regions"), "points")
    needed = written(points.select("node", F.col("one.id").alias("id"), F.col("one.hash").alias("hash")), "needed")
    listed = F.broadcast(needed) if needed.count() <= LISTED_NODES else needed
    same = F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.hash") == F.col("p.hash"))
    texts = base.alias("t").join(listed.alias("p"), same).select("node", "text").dropDuplicates(["node"])
    grams = written(texts.select("node", sets(F.col("text")).alias("grams")), "sets")
    hubs = members.groupBy("region").agg(F.min_by("node", F.xxhash64("region", "node")).alias("hub"))
    tried = members.join(written(hubs, "hubs"), "region").where("node != hub")
    pairs = written(tried.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).union(two).distinct(), "pairs")
    labels = components(linked(pairs, points, grams))
    labelled = members.join(labels, "node", "left").select("region", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("region").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least < greatest").select("region")
    more = tree_pairs(labelled.join(written(mixed, "mixed"), "region"), points).join(pairs, ["a", "b"], "left_anti")
    labels = joined(labels, linked(more, points, grams))
    named = labels.join(nodes.select("node", "id"), "node")
    names = written(named.groupBy("label").agg(F.min("id").alias("component")), "names")
    of_node = labels.join(names, "label").select("node", "component")
    named = written(nodes.join(of_node, "node", "left").select("high", "low", "n", F.coalesce("component", "id").alias("component")), "of-node")
    return made.select("id", "high", "low", "n").join(named, ["high", "low", "n"], "left").select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))
