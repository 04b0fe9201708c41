"""Operator 1: near-duplicate detection by ProbMinHash, banding and verification.

A text is a multiset of shingles of five words, weighted by how often they occur.
ProbMinHash lets each shingle's arrivals be a Poisson process whose rate is its
weight; a register keeps its earliest arrival, and a shingle stops once its next
arrival is later than all registers' (early termination). Two registers agree with
the probability Jaccard similarity of the texts.

Bands of registers meet in buckets. Each bucket's members are compared with one member
of it, drawn anew for each bucket, which takes as many pairs as it has members. Linked
texts form classes. What is left is exact: of members of one bucket that are in
different classes, each pair is compared in full whose similarity can reach the limit at
all: bitmaps of shingles bound it from above, inside the join. So no link between
candidates is lost, and few pairs beyond the links leave the join. Equal texts are one
node from the start.

Nodes are 64-bit hashes of whole texts. A second hash tells whether two texts have one
node; the texts of such a node get nodes from both hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship, written

SHINGLE = 5
SIMILAR = 0.8
#: Registers are BANDS * ROWS; at similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** 8) ** 32 = 0.997.
BANDS, ROWS = 32, 8
REGISTERS = BANDS * ROWS
EMPTY = np.inf
#: 64-bit words of the bitmap that bounds similarities.
WORDS = 16
G1, G2, G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * G2
    x = (x ^ (x >> np.uint64(27))) * G3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles (lower case, split at white space) and their counts; fewer words than five are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * G1 + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(total, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The element that arrives first at each register.

    The arrivals of an element depend on nothing but its hash and weight. They come in
    rounds: some arrivals of each element that is still in time, the more the fewer
    such elements there are.
    """
    first = np.full(REGISTERS, EMPTY)
    owner = np.zeros(REGISTERS, np.uint64)
    live, time, rate = elements, np.zeros(len(elements)), weights.astype(float)
    done = 0
    while len(live):
        number = np.arange(done + 1, done + 1 + max(1, 2 * REGISTERS // len(live))).astype(np.uint64)
        done += len(number)
        draw = mix(live[:, None] + number * G1)
        gaps = np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / -rate[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        at, when = (mix(draw ^ G3) & np.uint64(REGISTERS - 1)).astype(np.int64).ravel(), times.ravel()
        soon = np.flatnonzero(when < first[at])
        soon = soon[np.argsort(when[soon])[::-1]]  # the earliest is written last
        first[at[soon]] = when[soon]
        owner[at[soon]] = live[soon // len(number)]
        keep = times[:, -1] < first.max()
        live, time, rate = live[keep], times[keep, -1], rate[keep]
    return owner


def bands(text: str | None) -> list[int] | None:
    """A hash of each band with its number; None for a text without words."""
    elements, weights = shingles(text)
    if not len(elements):
        return None
    rows = signature(elements, weights).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1).astype(np.uint64) * G2  # wraps, as all products here
    for k in range(ROWS):
        out = mix(out * G1 + rows[:, k])
    return out.view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity: the sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i).

    Elements with equal weights on both sides are taken together.
    """
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])], y[np.searchsorted(both, b[0])] = a[1], b[1]
    kinds, many = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    u, v = kinds
    common = np.flatnonzero((u > 0) & (v > 0))
    return float(sum(many[i] / (many * np.maximum(u / u[i], v / v[i])).sum() for i in common))


def band_hashes(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.neardup import bands
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.Series([bands(t) for t in texts], dtype=object)
        settle()

    return run(text)


def sketch(text: str | None) -> tuple[int, int, list[int]]:
    """The weight of a text's shingles, how many distinct ones there are, and a bitmap in which each sets one bit."""
    elements, weights = shingles(text)
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(mix(elements) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return int(weights.sum()), len(elements), np.packbits(bits).view(np.int64).tolist()


def sketches(text: Column) -> Column:
    @F.pandas_udf("total bigint, kinds bigint, bits array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.neardup import sketch
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.DataFrame([sketch(t) for t in texts], columns=["total", "kinds", "bits"])
        settle()

    return run(text)


def can_be_similar(a: str, b: str) -> Column:
    """Whether an upper bound lets rows with ``s`` from ``sketches``, aliased a and b, be similar.

    A shingle whose bit the other bitmap lacks is not in the other text, so at most k of
    a text's distinct shingles are common, the lesser k of the two. They weigh at most k
    more than what the text's weight exceeds its distinct shingles by. As
    1 / (x / c + y / d - 1) bounds the similarity of texts of weights x and y whose common
    shingles weigh c and d, it is SIMILAR only if x / (u + k) + y / (v + k) <= 1 + 1 / SIMILAR,
    u and v being what the weights exceed the distinct shingles by. That holds from the
    greater root of a quadratic in k on.
    """
    x, y, m, n = F.col(f"{a}.s.total"), F.col(f"{b}.s.total"), F.col(f"{a}.s.kinds"), F.col(f"{b}.s.kinds")
    u, v, most = x - m, y - n, 1 + 1 / SIMILAR
    p, q = most * (u + v) - x - y, most * u * v - x * v - y * u
    least = (F.sqrt(p * p - 4 * most * q) - p) / (2 * most) - 1e-6
    bits = lambda s, t: F.zip_with(f"{s}.s.bits", f"{t}.s.bits", lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j))))
    lacking = lambda s, t: F.aggregate(bits(s, t), F.lit(0), lambda total, i: total + i)
    return (F.least(m, n) >= least) & (lacking(a, b) <= m - least) & (lacking(b, a) <= n - least)


def verified(a: Column, b: Column) -> Column:
    """Whether two whole texts are similar enough."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from glyphmill.llm.neardup import SIMILAR, shingles, similarity
        from glyphmill.llm.shared import settle

        for left, right in batches:
            last, known = None, None
            out = []
            for x, y in zip(left, right, strict=True):
                if y != last:  # pairs with one text come together
                    last, known = y, shingles(y)
                out.append(similarity(shingles(x), known) >= SIMILAR - 1e-9)
            yield pd.Series(out, dtype=bool)
        settle()

    return run(a, b)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar. texts: (node, text), unique by node."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.where(verified(F.col("x"), F.col("y"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (a, b): the least node that it is connected with.

    Each round takes the least label of a node's neighbours, then the label's own label,
    until nothing changes; the number of rounds grows with the logarithm of the paths.
    """
    both = written(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(lower.join(up, "label").select("node", F.col("next").alias("label"), "before"), "labels")
        if new.where("label != before").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after further edges: these become edges between labels, of which few are left."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    own = [F.coalesce(f"{side}_label", side).alias(side) for side in "ab"]
    between = written(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*own).where("a != b").distinct(), "between")
    if between.isEmpty():
        return labels
    top = components(between)
    lifted = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    new = top.join(labels.select("node"), "node", "left_anti")
    return written(lifted.select("node", F.coalesce("top", "label").alias("label")).unionByName(new.select("node", "label")), "labels")


#: Nodes up to which their list (16 bytes each) goes to all executors, so that texts that nobody resembles aren't shuffled; beyond it texts are.
LISTED_NODES = 1_000_000


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), one row for each of the nodes (node, id). The id is null where only rows without one hold the text."""
    nodes = written(nodes, "needed")
    few = nodes.count() <= LISTED_NODES
    one = (F.col("r.node") == F.col("n.node")) & F.col("r.id").eqNullSafe(F.col("n.id"))
    found = rows.alias("r").join((F.broadcast(nodes) if few else nodes).alias("n"), one, "left_semi").select("node", "text")
    return written(found.dropDuplicates(["node"]), "texts")


def first_hash(text: Column) -> Column:
    """The node of a text, unless another text has it too."""
    return F.xxhash64(text)


def grouped(hashed: DataFrame) -> DataFrame:
    """(node, id, bands, low, high), one row for each node; low and high are the least and the greatest second hash of its texts."""
    both = [F.min("second").alias("low"), F.max("second").alias("high")]
    return written(hashed.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), *both), "nodes")


def parted(rows: DataFrame, shared: DataFrame, few: bool) -> DataFrame:
    """The rows, with nodes from both hashes for those whose node is among ``shared``."""
    marks = shared.select("node", F.lit(True).alias("shared"))
    marked = rows.join(F.broadcast(marks) if few else marks, "node", "left")
    node = F.when(F.col("shared"), F.xxhash64("node", "second")).otherwise(F.col("node"))
    return marked.select(node.alias("node"), *[c for c in rows.columns if c != "node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class) of each row of ``docs``; the class is the least id of its near-duplicates, itself included.

    Texts that are null, empty or without words are no one's duplicates: each is a class
    of its own. Equal texts are in one class, so repeated rows are too. Null ids take no
    part in naming a class; a class with no other id is null.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    has_words = F.col("text").rlike(r"(?U)\S")
    rows = base.withColumns({"node": F.when(has_words, first_hash(F.col("text"))), "second": F.when(has_words, F.xxhash64(F.lit(1), "text"))})
    hashed = written(rows.select("id", "node", "second", band_hashes(F.when(F.col("node").isNotNull(), F.col("text"))).alias("bands")), "bands")
    hashed = hashed.withColumn("node", F.when(F.col("bands").isNotNull(), F.col("node")))
    nodes = grouped(hashed)
    shared = written(nodes.where("low != high").select("node"), "shared-nodes")
    if n_shared := shared.count():  # some hundred among 10^11 texts
        rows, hashed = (parted(x, shared, n_shared <= LISTED_NODES) for x in (rows, hashed))
        nodes = grouped(hashed)
    members = nodes.select("node", "id", F.explode("bands").alias("key"))
    hub = F.min_by("node", F.xxhash64("key", "node"))
    buckets = written(members.groupBy("key").agg(F.count("*").alias("n"), hub.alias("hub")).where("n > 1").select("key", "hub"), "buckets")
    members = written(members.join(buckets, "key"), "members")
    pairs = written(members.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    texts = texts_of(rows, members.select("node", "id").distinct())
    found = written(links(pairs, texts), "links")
    labels = components(found)
    # members of one bucket in different classes: all those outside its largest class, against all others
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = written(sizes.groupBy("key").agg(F.count("*").alias("classes"), F.max_by("label", F.struct("n", "label")).alias("main")).where("classes > 1").select("key", "main"), "main")
    mixed = written(labelled.join(main, "key"), "mixed")
    drawn = texts.join(mixed.select("node").distinct(), "node", "left_semi").join(nodes.select("node", "bands"), "node")
    mixed = written(mixed.join(written(drawn.select("node", "bands", sketches(F.col("text")).alias("s")), "sketches"), "node"), "mixed")
    apart = (F.col("p.key") == F.col("q.key")) & (F.col("p.label") != F.col("q.label"))
    once = (F.col("q.label") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))
    first = F.array_min(F.array_intersect("p.bands", "q.bands")) == F.col("p.key")  # a pair leaves one of its buckets only
    few = mixed.where("label != main").alias("p").join(mixed.alias("q"), apart & once & can_be_similar("p", "q") & first)
    across = few.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    more = written(links(across.join(pairs, ["a", "b"], "left_anti"), texts), "links")
    labels = joined(labels, more)
    # a class is named by its least id
    named = labels.join(nodes.select("node", "id"), "node")
    names = written(named.groupBy("label").agg(F.min("id").alias("class")), "names")
    classes = labels.join(names, "label").select("node", "class")
    of_node = written(nodes.select("node", "id").join(classes, "node", "left").select("node", F.coalesce("class", "id").alias("class")), "of-node")
    return hashed.select("id", "node").join(of_node, "node", "left").select("id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class")).alias("class"))
