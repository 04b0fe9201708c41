"""Operator 7: benchmark decontamination by BM25 with block-max pruning.

The test items are indexed: postings of BM25 impacts, cut into blocks of items, and
for each term the largest impact in each block. Every passage of every training text
is a query. The sum of its terms' block maxima bounds what an item of the block can
score; blocks under the threshold are skipped whole, as block-max WAND does, and the
others' postings are scored exactly. What is retrieved is verified by the overlap of
the item's question and of its answer.

The index is cut into shards of bounded size. One shard alive at a time: its index is
broadcast, the texts are searched, what is found is written, and the broadcast is
removed before the next shard is read. So a larger benchmark takes more passes over the
texts, not more memory. Texts are not shuffled where one shard is enough; else what was
found joins the texts by their hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship, written

WORD = re.compile(r"\w+")
#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 64, 32
K1, B = 1.2, 0.75
#: The share that a passage must reach of what the item itself would score (of the part of the item that a passage can hold).
RETRIEVE = 0.6
#: Words of the sequences that must overlap, and the share of the question's and of the answer's that must be there.
NGRAM, QUESTION_SHARE, ANSWER_SHARE = 5, 0.6, 0.6
#: Items of a block; characters of test items in one broadcast.
BLOCK_ITEMS, SHARD_CHARS = 4, 250_000
#: Cells of the array of running sums; longer texts are taken in stretches that overlap by a passage.
CELLS = 4_000_000
FOUND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,start:int>>"


def terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; both are the whole if there is one sentence."""
    parts = [w for s in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := terms(s))]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (terms(text), terms(text))


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], region: list[str], n: int = NGRAM) -> float:
    """The share of the part's word sequences that stand in the region too; 1 for an empty part."""
    n = min(n, len(part))
    if not n:
        return 1.0
    own = grams(part, n)
    return len(own & grams(region, n)) / len(own)


class Index:
    """One shard of the test items. items: (item_id, text); df: the items of the whole benchmark that hold a term."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(x) for _, x in items]
        words = [terms(x) for _, x in items]
        self.sizes = [len(w) for w in words]
        number: dict[str, int] = {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, w in enumerate(words):
            tf = Counter(w)
            own = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean_length)) for t, c in tf.items()}
            least = RETRIEVE * sum(own.values()) * min(1.0, PASSAGE / max(1, len(w)))
            for t, impact in own.items():  # in units of the item's threshold
                postings[number.setdefault(t, len(number) + 1)].append((k, impact / least))
        self.number = number
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.maxima = np.zeros((len(number) + 1, self.blocks), np.float32)
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for t, rows in postings.items():
            for k, impact in rows:
                at = t, k // BLOCK_ITEMS
                self.maxima[at] = max(self.maxima[at], impact)
                self.postings[at].append((k, impact))

    def search(self, words: list[str]) -> dict[int, list[tuple[float, int]]]:
        """By item, the passages that retrieve it: (score, where the passage starts)."""
        step = max(1, CELLS // self.blocks // STRIDE) * STRIDE
        found: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for begin in range(0, max(1, len(words)), step):
            for k, score, start in self.stretch(words[begin : begin + step + PASSAGE - STRIDE]):
                found[k].append((score, begin + start))
        return found

    def stretch(self, words: list[str]) -> list[tuple[int, float, int]]:
        """The same within some passages, for all of them at once: (item, score, start)."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        at = np.flatnonzero(ids)
        if not len(at):
            return []
        # a passage is two strides; a term counts once in each, which bounds what it adds from above
        n = len(self.number) + 1
        terms_of = np.unique(at // STRIDE * n + ids[at])
        stride, term = terms_of // n, terms_of % n
        cuts = np.searchsorted(stride, np.arange(-(-len(words) // STRIDE) + 1))
        running = np.zeros((len(term) + 1, self.blocks))
        np.cumsum(self.maxima[term], axis=0, out=running[1:])
        first = np.arange(max(1, len(cuts) - 2))
        lo, hi = cuts[first], cuts[np.minimum(first + PASSAGE // STRIDE, len(cuts) - 1)]
        found: list[tuple[int, float, int]] = []
        passages, blocks = np.nonzero(running[hi] - running[lo] >= 1 - 1e-4)
        for p, block in zip(passages.tolist(), blocks.tolist(), strict=True):
            scores: dict[int, float] = defaultdict(float)
            for t in set(term[lo[p] : hi[p]].tolist()):
                for k, impact in self.postings.get((t, block), ()):
                    scores[k] += impact
            found += [(k, score, p * STRIDE) for k, score in scores.items() if score >= 1]
        return found

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, word where the passage starts) of the verified items.

        Of an item's passages the best one that is verified counts.
        """
        words = terms(text)
        out = []
        for k, passages in self.search(words).items():
            for score, start in sorted(passages, key=lambda x: (-x[0], x[1])):
                region = words[max(0, start - self.sizes[k]) : start + PASSAGE + self.sizes[k]]
                q, a = (overlap(part, region) for part in self.parts[k])
                if q >= QUESTION_SHARE and a >= ANSWER_SHARE:
                    out.append((self.ids[k], score, q, a, start))
                    break
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[4]))


def shard_count(benchmark: DataFrame, text_col: str = "text", shard_chars: int = SHARD_CHARS) -> int:
    return -(-(benchmark.agg(F.sum(F.char_length(F.col(f"`{text_col}`")))).first()[0] or 0) // shard_chars)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> Iterator[Index]:
    """The shards of the index, one after the other: a shard is built when it is asked for.

    Texts that are null or have no word can't leak and are left out. An item without an
    id is searched for like others, and leaks as the null item.
    """
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    shards = shard_count(benchmark, text_col, shard_chars)
    size = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    n_items, mean = items.agg(F.count("*"), F.avg(size)).first()
    words = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(max(1, shards))).alias("shard"), "item", "text")
    for shard in range(shards):
        own = [(r["item"], r["text"]) for r in words.where(F.col("shard") == shard).collect()]
        own = sorted((x for x in own if terms(x[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        mine = {t for _, x in own for t in terms(x)}
        if shards == 1:
            df = Counter(t for _, x in own for t in set(terms(x)))
        else:
            known = benchmark.sparkSession.createDataFrame([(t,) for t in sorted(mine)], "term string")
            split = items.select("item", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("term"))
            df = defaultdict(lambda: 1, {r["term"]: r["n"] for r in split.join(known, "term").groupBy("term").agg(F.count("*").alias("n")).collect()})
        if own:
            yield Index(own, df, n_items, mean or 1.0)


def searched(text: Column, index: Broadcast) -> Column:
    """The verified items of one shard in each text."""
    names = ("item_id", "score", "question_overlap", "answer_overlap", "start")

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in index.value.leaks(t)] for t in texts], dtype=object)
        settle()

    return search(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: the test items that each whole text holds; a column of this name is replaced.

    Texts that are null or empty hold none. Each row is searched by itself: repeated
    rows give repeated results. An empty benchmark gives empty lists.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(f"`{text_col}`")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "leaks"]
    if shard_count(benchmark, shard_chars=shard_chars) <= 1:
        found = [searched(text, spark.sparkContext.broadcast(index)) for index in indexes(benchmark, shard_chars=shard_chars)]
        return docs.select(*keep, F.concat(F.array().cast(FOUND), *found).alias("leaks"))
    parts = []
    for index in indexes(benchmark, shard_chars=shard_chars):
        shared = spark.sparkContext.broadcast(index)
        hits = docs.select(text.alias("text"), searched(text, shared).alias("leaks")).where(F.size("leaks") > 0)
        parts.append(written(hits.select(*named_by(F.col("text")), "leaks"), "leaks").dropDuplicates(["h1", "h2"]))
        shared.destroy()
        del index, shared, hits
    every = reduce(DataFrame.unionByName, parts) if parts else docs.select(*named_by(text), F.array().cast(FOUND).alias("leaks")).limit(0)
    every = written(every.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks")), "leaks")
    own = docs.select(F.struct(*keep).alias("row"), *named_by(text))
    leaks = F.coalesce("leaks", F.array().cast(FOUND))
    return own.join(every, ["h1", "h2"], "left").select("row.*", leaks.alias("leaks"))


def named_by(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
