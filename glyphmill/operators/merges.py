"""Learning merges of neighbouring symbols over distinct sequences, and doing them again.

A sequence is a string in which each symbol is one code point beyond U+FFFF, in the
order of the vocabulary; so a merge is ``replace()``, and ties between pairs go by plain
string order.

Learning goes by epochs. An epoch begins with exact counts of all pairs. The driver lists the
pairs that rank first. No pair outside the list can come before the least one on it, since
counts of old pairs never rise; nor can any pair that a merge makes across a place where such a
pair stands, as it is no more frequent. So sequences are cut there, and equal pieces are brought
together: the epoch's index, which is far smaller than the sequences. A round makes the merges
that are certain to come next, and guesses what follows them by the most frequent pieces; it sends
back how each merge changes the counts in all pieces. Guesses are kept as far as these counts
confirm them, so they cost or save rounds, and never change a result. When the list is used up, or enough merges wait, the epoch ends: words are
rewritten, and the differences of those that changed are added to the counts. What tasks do
with many sequences at once is in ``slabs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.slabs import BITS, Slab, after, changes_of, key, made, pair_changes, pair_counts, pair_of, pieces, step_changes
from glyphmill.sources.folder import forget, written

#: Code points from U+10000 on, without the last two of each plane.
FIRST, PLANE = 0x10000, 0xFFFE
#: The last index that a code point is left for: 16 planes.
MOST_SYMBOLS = 16 * PLANE - 1
#: Pairs on the driver's list at the start of an epoch at most, and those that end one.
LISTED, MOST_KNOWN = 2048, 50_000
#: Merges that wait in an epoch at most.
PENDING = 512
#: Waves of merges that wait in an epoch's index at most, before it is written anew with them done.
WAVES = 32
#: Most frequent pieces that guesses go by, and merges of a round, certain and guessed ones.
GUIDES, GUESSED = 20_000, 64
#: Symbols of a piece up to which equal pieces of all tasks are brought together; longer ones are hardly ever equal.
INDEXED = 24
#: Merges still to make from which on an index is worth while.
WORTH = 3


def symbol(idx: int) -> str:
    return chr(FIRST + idx + 2 * (idx // PLANE))


def symbol_of(idx: Column) -> Column:
    point = F.lit(FIRST) + idx + 2 * F.floor(idx / PLANE)
    utf32 = F.lpad(F.hex(point.cast("long")), 8, "0")
    return F.decode(F.unhex(utf32), "UTF-32")


def index_of(sym: Column) -> Column:
    place = F.conv(F.hex(F.encode(sym, "UTF-32")), 16, 10).cast("int") - FIRST
    return (place - 2 * F.floor(place / (PLANE + 2))).cast("int")


def number(sym: str) -> int:
    place = ord(sym) - FIRST
    return place - 2 * (place // (PLANE + 2))


def pairs_of(s: Column) -> Column:
    """The adjacent symbols of a word, also where they overlap."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.char_length(s) > 1, pairs).otherwise(F.array().cast("array<string>"))


def pair_freqs(words: DataFrame) -> DataFrame:
    """(pair, freq) of adjacent symbols; overlaps count."""
    return words.select(F.explode(pairs_of(F.col("s"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("freq"))


def indexed(words: DataFrame, waves: list[list[str]], live: list[str]) -> DataFrame:
    """(s, n): the pieces of words between places where none of the pairs stands, after waves of merges."""
    each = written(pieces(words, waves, live), "pieces")
    long = F.char_length("s") > INDEXED
    out = written(each.where(~long).groupBy("s").agg(F.sum("n").alias("n")).unionByName(each.where(long)), "index")
    forget(each)
    return out


def independent(top: list[tuple[str, int]], room: int, least: int) -> list[tuple[str, int]]:
    """The first pairs of the ranking, up to one that shares a symbol with those before it.

    These are the next merges exactly. None changes another's frequency. A pair that a
    merge of (a, b) makes, with a symbol x, is at most as frequent as (b, x) or (x, a) was;
    that pair shares a symbol, so it ranks below all of these, and so does the new one,
    whose new symbol is the greatest.
    """
    out: list[tuple[str, int]] = []
    seen: set[str] = set()
    for pair, freq in top[:room]:
        if freq < least or seen & set(pair):
            break
        seen |= set(pair)
        out.append((pair, freq))
    return out


@dataclass
class Learned:
    """Merges (idx, left, right, freq) in order; the words (s, n) after them; the counts of pairs (pair, freq) carried along; how many rounds and epochs it took."""

    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    words: DataFrame | None = None
    counts: DataFrame | None = None
    rounds: int = 0
    epochs: int = 0

    def add(self, chosen: list[tuple[str, int]], idx: int) -> list[str]:
        """Merges from index ``idx`` on, and their steps: strings of the pair and the new symbol."""
        if idx + len(chosen) - 1 > MOST_SYMBOLS:
            raise ValueError(f"a learned vocabulary has at most {MOST_SYMBOLS + 1} types")
        self.merges += [(idx + k, number(pair[0]), number(pair[1]), freq) for k, (pair, freq) in enumerate(chosen)]
        return [pair + symbol(idx + k) for k, (pair, _) in enumerate(chosen)]


class Epoch:
    """The driver's part of one epoch: the list of pairs with their exact counts, and the merges that wait, by waves that share no symbol."""

    def __init__(self, counts: DataFrame, most: int, least: int):
        size = min(LISTED, 4 * most + 64)
        top = [(r["pair"], r["freq"]) for r in counts.orderBy(F.desc("freq"), "pair").limit(size + 1).collect()]
        self.known = dict(top[:size])
        self.least = least
        #: The place in the ranking from which on pairs may be missing.
        self.end = (-top[size][1], top[size][0]) if len(top) > size else (0, "")
        self.waves: list[list[str]] = []

    def live(self) -> list[str]:
        """The pairs that may still be merged in this epoch."""
        return [pair for pair, freq in self.known.items() if (-freq, pair) < self.end and freq >= self.least]

    def next(self, room: int) -> list[tuple[str, int]]:
        waiting = sum(map(len, self.waves))
        if waiting >= PENDING or len(self.known) > MOST_KNOWN:
            return []
        ranking = sorted((-self.known[pair], pair) for pair in self.live())
        return independent([(pair, -freq) for freq, pair in ranking], min(room, PENDING - waiting), self.least)

    def guessed(self, chosen: list[tuple[str, int]], idx: int, room: int, guides: Slab) -> list[str]:
        """The steps of the chosen merges, with indices from ``idx`` on, and then of those that seem to follow: what a merge does to the guides, it seems to do to all in the same proportion."""
        now, slab = {key(pair): float(freq) for pair, freq in self.known.items()}, guides.copy()
        least = max(self.least, -self.end[0])
        steps: list[str] = []
        while len(steps) < room:
            best = key(chosen[len(steps)][0]) if len(steps) < len(chosen) else min(now, key=lambda k: (-now[k], k), default=None)
            if best is None or now[best] < least:
                break
            steps.append(pair_of(best) + symbol(idx + len(steps)))
            keys, sums = changes_of(slab, steps[-1:])
            whole, seen = now.pop(best), -int(sums[keys == best].sum())
            for k, n in zip(keys.tolist(), (sums * (whole / seen)).tolist(), strict=True) if seen > 0 else ():
                if k in now or n >= least and k != best:
                    now[k] = now.get(k, 0.0) + n
        return steps

    def apply(self, changed: dict[str, int], now: list[str]) -> None:
        """What a wave of merges has changed: new pairs count where they reach the list's end."""
        new = {step[2] for step in now}
        for pair, freq in changed.items():
            if pair in self.known:
                self.known[pair] += freq
                if self.known[pair] <= 0:
                    del self.known[pair]
            elif new & set(pair) and freq >= max(1, -self.end[0]):
                self.known[pair] = freq
        for step in now:
            self.known.pop(step[:2], None)
        self.waves.append(now)


class Round:
    """The changes that a round has found, step by step. Steps of one wave may turn out to come in another order, and then their new symbols change places."""

    def __init__(self, steps: list[str], found: pa.Table):
        at, freq = found["at"].to_numpy(), found["freq"].to_numpy()
        order = np.argsort(at, kind="stable")
        self.steps, self.done, self.real = steps, 0, {}
        self.keys, self.freqs = at[order] & (1 << 2 * BITS) - 1, freq[order]
        self.begins = np.searchsorted(at[order] >> 2 * BITS, np.arange(len(steps) + 1)).tolist()

    def named(self, some: str) -> str:
        return "".join(self.real.get(c, c) for c in some)

    def take(self, chosen: list[tuple[str, int]]) -> tuple[list[str], dict[str, int]]:
        """(steps, changes) of as many of the chosen merges as the next steps are, in whatever order; none if they are others."""
        pairs, own = [pair for pair, _ in chosen], [self.named(step[:2]) for step in self.steps[self.done : self.done + len(chosen)]]
        n = next((n for n in range(len(own), 0, -1) if set(pairs[:n]) == set(own[:n])), 0)
        steps = self.steps[self.done : self.done + n]
        symbols = sorted(step[2] for step in steps)
        self.real |= {step[2]: symbols[pairs.index(pair)] for step, pair in zip(steps, own, strict=False)}
        here = slice(self.begins[self.done], self.begins[self.done + n])
        changed: dict[str, int] = {}
        for k, freq in zip(self.keys[here].tolist(), self.freqs[here].tolist(), strict=True):
            pair = self.named(pair_of(k))
            changed[pair] = changed.get(pair, 0) + freq
        self.done += n
        return [pair + sym for pair, sym in zip(pairs[:n], symbols, strict=True)], changed


def learn(words: DataFrame, n_types: int, most: int, least: int = 2, at_once: int = 64, carry: bool = True) -> Learned:
    """Up to ``most`` merges of words (s, n), with indices from ``n_types`` on; fewer if no pair is frequent enough, or none is left.

    The result is that of one merge at a time: most frequent pair first, ties by the pair.
    carry: whether the counts are carried beyond the last merge.
    """
    out = Learned(words=words, counts=written(pair_counts(words), "pairs"))
    own: list[DataFrame] = []
    while len(out.merges) < most:
        epoch = Epoch(out.counts, most - len(out.merges), least)
        index, guides, done = None, None, 0
        while chosen := epoch.next(min(most - len(out.merges), at_once)):
            idx = n_types + len(out.merges)
            out.rounds += 1
            if len(out.merges) + len(chosen) == most:
                epoch.waves.append(out.add(chosen, idx))
                break
            if index is None and most - len(out.merges) >= WORTH or len(epoch.waves) - done >= WAVES:
                old, index = index, indexed(out.words if index is None else index, epoch.waves[done:], epoch.live())
                forget(*([old] if old is not None else []))
                done = len(epoch.waves)
                guides = Slab.of(index.orderBy(F.desc("n"), "s").limit(GUIDES).toArrow())
            if guides is not None:
                steps = epoch.guessed(chosen, idx, min(most - len(out.merges) - 1, max(GUESSED, len(chosen))), guides)
            else:
                steps = [pair + symbol(idx + k) for k, (pair, _) in enumerate(chosen)]
            found = Round(steps, step_changes(out.words if index is None else index, epoch.waves[done:], steps).toArrow())
            while chosen and (taken := found.take(chosen))[0]:
                wave, changed = taken
                out.add(chosen[: len(wave)], n_types + len(out.merges))
                epoch.apply(changed, wave)
                if guides is not None:
                    guides.merge(wave)
                chosen = epoch.next(min(most - len(out.merges), at_once)) if found.done < len(steps) else []
        forget(*([index] if index is not None else []))
        if not epoch.waves:
            break
        out.epochs += 1
        last = len(out.merges) >= most
        if carry or not last:
            moved = pair_changes(out.words, epoch.waves)
            counts = written(out.counts.unionByName(moved).groupBy("pair").agg(F.sum("freq").alias("freq")).where("freq > 0"), "pairs")
            forget(out.counts)
            out.counts = counts
        words = after(out.words, epoch.waves)
        if last:
            out.words = words
        else:
            words = written(words, "words")
            forget(*own)
            out.words, own = words, [words]
    return out


def merges(words: DataFrame, n_types: int, most: int, least: int = 2, at_once: int = 64) -> tuple[list[tuple[int, int, int, int]], DataFrame]:
    """((idx, left, right, freq) of up to ``most`` merges in order, the words after them)."""
    found = learn(words, n_types, most, least, at_once, carry=False)
    forget(found.counts)
    return found.merges, found.words


def audit(words: DataFrame, counts: DataFrame, n_types: int) -> DataFrame:
    """(check, checked, violations) of carried counts (pair, freq) against words (s, n), recounted.

    ``pair count``: a pair's carried count is what its words hold, over the pairs of either
    side. ``within symbols``: no pair is more frequent than either of its symbols.
    ``positive``: no carried count is below 1. ``known symbols``: each symbol of the words is
    a type below ``n_types``.
    """
    uni = words.select(F.explode(F.split("s", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("uses"))
    uni = written(uni, "symbols")
    recount = pair_freqs(words).withColumnRenamed("freq", "found")
    both = written(counts.join(recount, "pair", "full"), "recount")
    checked = lambda rows, name, bad: rows.agg(F.lit(name).alias("check"), F.count("*").alias("checked"), F.count_if(bad).alias("violations"))
    of = lambda side: uni.select(F.col("c").alias(side), F.col("uses").alias(f"{side}_uses"))
    ends = both.where("freq is not null").select("freq", F.substring("pair", 1, 1).alias("l"), F.substring("pair", 2, 1).alias("r")).join(of("l"), "l", "left").join(of("r"), "r", "left")
    none = F.lit(0)
    within = F.col("freq") > F.least(F.coalesce("l_uses", none), F.coalesce("r_uses", none))
    out = checked(both, "pair count", ~F.col("freq").eqNullSafe(F.col("found")))
    out = out.unionByName(checked(ends, "within symbols", within))
    out = out.unionByName(checked(both.where("freq is not null"), "positive", F.col("freq") < 1))
    return out.unionByName(checked(uni, "known symbols", index_of(F.col("c")) >= n_types))


@dataclass
class Replay:
    """Stored merges, done again one by one or many at once: a vocabulary's types with kids, in order of their indices.

    ``done`` of them count as made. Words are encoded in merge order, which differs from
    the longest match where an earlier merge takes a symbol that a longer name needs.
    """

    types: list[tuple[int, int, int]]
    done: int = 0

    @classmethod
    def of(cls, vocab: DataFrame) -> Replay:
        """All merges of a vocabulary (at most MOST_SYMBOLS of three numbers), none made yet."""
        kids = vocab.where(F.size("kids") == 2).select("idx", F.get("kids", F.lit(0)).alias("l"), F.get("kids", F.lit(1)).alias("r"))
        return cls(sorted((r["idx"], r["l"], r["r"]) for r in kids.collect()))

    def remaining(self) -> int:
        return len(self.types) - self.done

    def peek(self) -> tuple[int, int, int]:
        """The next merge (idx, left, right); without one it raises."""
        return self.types[self.done]

    def step(self, n: int = 1) -> Replay:
        """The state after n more merges; beyond the last it raises."""
        if n > self.remaining():
            raise ValueError(f"{self.remaining()} merges remain")
        return Replay(self.types, self.done + n)

    def reach(self) -> list[str]:
        """The pairs of unmerged symbols that the merges made may join: a merge joins its left kid's last symbol and its right kid's first."""
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        out = set()
        for idx, a, b in self.types[: self.done]:
            out.add(symbol(last.get(a, a)) + symbol(first.get(b, b)))
            first[idx], last[idx] = first.get(a, a), last.get(b, b)
        return sorted(out)

    def words(self, start: DataFrame, keep: str | None = None) -> DataFrame:
        """(s, n, times) of words (s, n) of unmerged symbols: s after the merges made, and how often each of them was made in the word, as (idx, n). keep: a column to return as ``kept``."""
        table = {symbol(a) + symbol(b): (k, idx, symbol(idx)) for k, (idx, a, b) in enumerate(self.types[: self.done])}
        sides = {idx: symbol(a) + symbol(b) for idx, a, b in self.types[: self.done]}
        sent = start.sparkSession.sparkContext.broadcast((table, sides))

        @F.pandas_udf("s string, times array<struct<idx:int,n:int>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known, pair_of = sent.value
            for words in batches:
                out = []
                for s in words:
                    times = []
                    while best := min((known[p] for p in {s[i : i + 2] for i in range(len(s) - 1)} if p in known), default=None):
                        _, idx, new = best
                        before, s = len(s), s.replace(pair_of[idx], new)
                        times.append({"idx": idx, "n": before - len(s)})
                    out.append((s, times))
                yield pd.DataFrame(out, columns=["s", "times"])

        kept = [F.col(keep).alias("kept")] if keep else []
        return start.select(run(F.col("s")).alias("x"), "n", *kept).select("x.s", "n", "x.times", *(["kept"] if keep else []))


def track(words: DataFrame, n_types: int, replay: Replay) -> list[tuple[int, float, float]]:
    """(k, emd, mean_len) after k = 0 .. all merges of ``replay``: imbalance of the types, and mean symbols of a word.

    The histogram of symbols and the total are taken once, and how often each merge is
    made once, over the pieces that merges can reach; from merge to merge they change by differences.
    """
    whole = replay.step(replay.remaining())
    uses = {number(r["c"]): r["n"] for r in words.select(F.explode(F.split("s", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    n_words = words.agg(F.sum("n").alias("n")).first()["n"]
    if not uses:
        return []
    each = made(indexed(words, [], whole.reach()), [(idx, symbol(a) + symbol(b) + symbol(idx)) for idx, a, b in whole.types])
    times = {r["idx"]: r["n"] for r in each.collect()} if whole.types else {}
    total = sum(uses.values())
    out = []
    for k in range(len(whole.types) + 1):
        if k:
            idx, a, b = whole.types[k - 1]
            n = times.get(idx, 0)
            uses[a] -= n
            uses[b] -= n
            uses[idx] = uses.get(idx, 0) + n
            total -= n
        size = n_types + k
        used = [n for n in uses.values() if n]
        gap = sum(abs(n / total - 1.0 / size) for n in used) + (size - len(used)) / size
        out.append((k, 0.5 * gap, total / n_words))
    return out
