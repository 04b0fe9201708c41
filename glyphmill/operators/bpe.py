"""Byte-pair vocabularies: merges learned over distinct words and over lines, encoding by greedy longest match or in merge order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import freq as N
from glyphmill.operators.codec import SENT_TYPES, encode_pieces, mapped, small_table, with_row
from glyphmill.operators.merges import FIRST, MOST_SYMBOLS, PLANE, Replay, index_of, merges, pair_freqs, pairs_of, symbol, symbol_of, track
from glyphmill.operators.slabs import clipped, encoded, spelled
from glyphmill.operators.vocab import LEVELS, NO_KIDS, SPACE, UNK, init_vocab
from glyphmill.sources.folder import written

__all__ = ["FIRST", "MOST_SYMBOLS", "PLANE", "index_of", "merges", "pair_freqs", "pairs_of", "symbol", "symbol_of"]

def start_words(word_freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(s, n): the distinct words, each with ▁ at its end, as strings of symbols.

    A word that the vocabulary has as a whole is one symbol, so no merge takes it apart;
    characters outside the vocabulary are `<unk>`.
    """
    rows = word_freqs.select(F.concat("term", F.lit(T.SPACE)).alias("w"), F.col("freq").alias("n"))
    if (table := small_table(vocab, "name", "idx")) is not None:
        sent = rows.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("string")
        def symbols(words: pa.Array) -> pa.Array:
            return spelled(words, sent.value, UNK)

        return rows.select(symbols("w").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    whole = vocab.groupBy(F.col("name").alias("w")).agg(F.min("idx").alias("own")).where(F.char_length("w") > 1)
    known = rows.join(whole, "w", "left")
    pieces = F.when(F.col("own").isNotNull(), F.array("w")).otherwise(T.chars(F.col("w")))
    ids = encode_pieces(known, ["w", "n"], pieces, vocab)
    return ids.select(F.array_join(F.transform("ids", symbol_of), "").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))


def with_pieces(base: DataFrame, pieces: list[str]) -> DataFrame:
    """``base`` and the user's pieces after it: level 0, frequency 0, each with ▁ at its end, in the given order."""
    names = [p + T.SPACE for p in pieces]
    if any(" " in p for p in pieces):
        raise ValueError("a piece has no spaces")
    if len(set(names)) < len(names) or not base.where(F.col("name").isin(names)).isEmpty():
        raise ValueError("pieces are not unique")
    n = base.count()
    return base.unionByName(base.sparkSession.createDataFrame([(n + k, name, LEVELS["user"], 0, []) for k, name in enumerate(names)], base.schema)) if names else base


def learn_bpe(rows: DataFrame | None, text: str = "text", size: int = 8000, coverage: float = 0.9995, min_co_evidence: int = 95, word_freqs: DataFrame | None = None, more: int | None = None, pieces: list[str] | None = None, char_min_freq: int = 0, word_min_freq: int = 1, n_lines: int | None = None) -> DataFrame:
    """A vocabulary of characters, the user's pieces and merged subwords, of at most ``size`` types, or of at most ``more`` merges beyond these.

    A merge's frequency is its pair's. Merges may hold `<unk>`. char_min_freq: characters
    below it are `<unk>`, and coverage does not count then. word_min_freq: words below it are not learned from.
    With word_freqs and n_lines given, no text is read, and rows may be None.
    """
    freqs = N.word_freq(rows, text) if word_freqs is None else word_freqs
    freqs = written(freqs.where(F.col("freq") >= word_min_freq) if word_min_freq > 1 else freqs, "word-freqs")
    chars = N.char_freq_of_words(freqs, T.SPACE)
    n_lines = rows.where(F.col(text).isNotNull()).count() if n_lines is None else n_lines
    cut = {"min_freq": char_min_freq} if char_min_freq else {"coverage": coverage}
    base = written(with_pieces(init_vocab(chars, n_lines, "char", **cut), pieces or []), "base")
    n = base.count()
    most = size - n if more is None else more
    if most <= 0:
        return base
    found, _ = merges(written(start_words(freqs, base), "words"), n, most, min_co_evidence)
    return with_merges(base, found)


def with_merges(base: DataFrame, found: list[tuple[int, int, int, int]], level: str = "subword") -> DataFrame:
    """``base`` and the merged types, whose names are their kids' names put together."""
    names = {r["idx"]: r["name"] for r in base.select("idx", "name").collect()}  # at most MOST_SYMBOLS
    rows = []
    for idx, a, b, freq in found:
        names[idx] = names[a] + names[b]
        rows.append((idx, names[idx], LEVELS[level], freq, [a, b]))
    return base.unionByName(base.sparkSession.createDataFrame(rows, base.schema)) if rows else base


def line_symbols(rows: DataFrame, vocab: DataFrame, text: str = "text", runs: str = "clip") -> DataFrame:
    """(s, n): the distinct lines of the texts, encoded by longest match, as strings of symbols.

    Overlapping pairs of one symbol can't all merge. Where a symbol stands three times or
    more in a row it is clipped to two (``clip``), or the line is left out (``drop``).
    """
    lines = N.counted(rows.where(F.col(text).isNotNull()).select(F.explode(T.lines(F.col(text))).alias("line")), "line")
    return symbols_of_lines(lines, vocab, runs).groupBy("s").agg(F.sum("n").alias("n"))


def symbols_of_lines(lines: DataFrame, vocab: DataFrame, runs: str) -> DataFrame:
    """(s, n) of each of the lines (line, freq)."""
    if runs not in ("clip", "drop"):
        raise ValueError("runs: clip or drop")
    drop = runs == "drop"
    if (table := small_table(vocab, "name", "idx")) is not None:
        sent, walk = lines.sparkSession.sparkContext.broadcast(table), longest_matches(table)

        @F.arrow_udf("string")
        def symbols(words: pa.Array) -> pa.Array:
            known = sent.value
            return clipped(*encoded(words, lambda w: walk(known, [w + T.SPACE]), SPACE), drop)

        made = lines.select(symbols(T.words(F.col("line"))).alias("s"), F.col("freq").alias("n"))
    else:

        @F.arrow_udf("string")
        def symbols(ids: pa.Array) -> pa.Array:
            return clipped(ids.flatten().to_numpy().astype(int), np.diff(ids.offsets.to_numpy()).astype(int), drop)

        made = encode_bpe(lines, ["line", "freq"], vocab, "line").select(symbols("ids").alias("s"), F.col("freq").alias("n"))
    return made.where("s is not null") if drop else made


def learn_phrases(rows: DataFrame, vocab: DataFrame, most: int, text: str = "text", least: int = 95, runs: str = "clip") -> DataFrame:
    """``vocab`` and up to ``most`` phrases: merges over whole lines of its own types, across the ends of words. A phrase's kids are types or phrases."""
    vocab = written(vocab, "level-1")
    lines = rows.where(F.col(text).isNotNull()).select(F.explode(T.lines(F.col(text))).alias("line"), F.lit(1).cast("long").alias("freq"))
    found, _ = merges(written(symbols_of_lines(lines, vocab, runs), "lines"), vocab.count(), most, least)
    return with_merges(vocab, found, "phrase")


def encode_merges(rows: DataFrame, keys: list[str], vocab: DataFrame, replay: Replay, text: str = "text") -> DataFrame:
    """(keys, ids) in merge order, with the merges that ``replay`` has made. Distinct words are encoded once; a row without words is a lone ▁.

    vocab: what the merges began with; types with kids in it are left alone.
    """
    at = with_row(rows, keys, words=T.words(F.coalesce(F.col(text), F.lit("")))).select(*keys, "_row", F.posexplode_outer("words").alias("at", "term"))
    base = written(vocab.where(F.size("kids") == 0), "base")
    distinct = written(at.where("term is not null").select("term").distinct(), "terms")
    pieces = T.chars(F.concat("term", F.lit(T.SPACE)))
    whole = base.select(F.col("name").alias("w"), F.col("idx").alias("own")).where(F.char_length("w") > 1)
    known = distinct.withColumn("w", F.concat("term", F.lit(T.SPACE))).join(whole, "w", "left")
    ids = encode_pieces(known, ["term"], F.when(F.col("own").isNotNull(), F.array("w")).otherwise(pieces), base)
    start = written(ids.select("term", F.array_join(F.transform("ids", symbol_of), "").alias("s"), F.lit(1).alias("n")), "start")
    done = replay.words(start.select("s", "n").distinct(), keep="s").select(F.col("kept").alias("s"), F.transform(F.filter(F.split("s", ""), lambda c: c != ""), index_of).alias("ids"))
    words = start.join(done, "s").select("term", "ids")
    one = F.when(F.col("at").isNotNull(), F.struct("at", "ids"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.ids))
    made = at.join(words, "term", "left").groupBy(*keys, "_row").agg(flat.alias("ids"))
    return made.select(*keys, F.when(F.size("ids") == 0, F.array(F.lit(SPACE))).otherwise(F.col("ids")).alias("ids"))


#: Words whose matches a task remembers.
REMEMBERED = 100_000


def longest_matches(table: dict) -> Callable[[dict, list], list]:
    """What takes the names that a vocabulary knows, and words, to the ids of the words' longest matches one after the other.

    At each place only the lengths are tried that some name with the same two first
    characters has. A word is walked once, as long as a task remembers it.
    """
    lengths: dict[str, set[int]] = {}
    for name in table:
        if len(name) > 1:
            lengths.setdefault(name[:2], set()).add(len(name))
    tried = {start: sorted(some, reverse=True) for start, some in lengths.items()}
    done: dict[str, list[int]] = {}

    def one(known: dict, word: str) -> list[int]:
        ids, here = [], 0
        while here < len(word):
            for n in tried.get(word[here : here + 2], ()):
                if (idx := known.get(word[here : here + n])) is not None and here + n <= len(word):
                    break
            else:
                n, idx = 1, known.get(word[here], UNK)
            ids.append(idx)
            here += n
        return ids

    def walk(known: dict, words: list) -> list:
        if len(done) > REMEMBERED:
            done.clear()
        ids = []
        for word in words:
            if (own := done.get(word)) is None:
                own = done[word] = one(known, word)
            ids += own
        return ids

    return walk


def segmented(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(w, ids): greedy longest match from left to right over all types; a character that none begins with is one `<unk>`.

    words: distinct, ``w``. A vocabulary of a measured size goes to all executors, which
    walk over each word. Beyond it, all substrings as long as some name are looked up by
    a join; the longest at each place is kept, and a fold walks from match to match.
    """
    if (table := small_table(vocab, "name", "idx")) is not None:
        return words.select("w", mapped(words, F.array("w"), longest_matches(table), table, "array<int>").alias("ids"))
    names = vocab.groupBy("name").agg(F.min("idx").alias("idx"))
    sizes = [r[0] for r in vocab.select(F.char_length("name")).distinct().orderBy(F.char_length("name")).collect() if r[0]]
    at = words.select("w", F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("at"))
    lengths = F.array(*map(F.lit, sizes))
    fits = F.filter(lengths, lambda n: F.col("at") + n - 1 <= F.char_length("w"))
    parts = at.select("w", "at", F.explode(fits).alias("n")).withColumn("name", F.substring(F.col("w"), F.col("at"), F.col("n")))
    best = parts.join(names, "name").groupBy("w", "at").agg(F.max(F.struct("n", "idx")).alias("m"))
    steps = best.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("steps"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast(NO_KIDS).alias("ids"))

    def step(acc: Column, i: Column) -> Column:
        m = F.try_element_at("steps", i)
        taken = F.struct((i + F.coalesce(m.n, F.lit(1))).alias("next"), F.concat(acc.ids, F.array(F.coalesce(m.idx, F.lit(UNK)))).alias("ids"))
        return F.when(i == acc.next, taken).otherwise(acc)

    both = words.join(steps, "w", "left").withColumn("steps", F.coalesce("steps", F.create_map().cast("map<int,struct<n:int,idx:int>>")))
    return both.select("w", F.aggregate(F.sequence(F.lit(1), F.char_length("w")), start, step, lambda acc: acc.ids).alias("ids"))


def encode_bpe(rows: DataFrame, keys: list[str], vocab: DataFrame, text: str = "text") -> DataFrame:
    """(keys, ids) by greedy longest match; a row without words is a lone ▁.

    No name may hold ▁ but at its end (learned ones don't), so words are segmented one
    by one: inside the row where the vocabulary can be sent, else the distinct ones once
    each. Every row gives one row, also where keys are equal.
    """
    if (table := small_table(vocab, "name", "idx")) is not None:
        ended = F.transform(T.words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.concat(w, F.lit(T.SPACE)))
        ids = mapped(rows, ended, longest_matches(table), table, "array<int>")
        made = rows.select(*keys, ids.alias("ids"))
        return made.select(*keys, F.when(F.size("ids") == 0, F.array(F.lit(SPACE))).otherwise(F.col("ids")).alias("ids"))
    whole = with_row(rows, keys, words=T.words(F.col(text)))
    at = whole.select(*keys, "_row", F.posexplode_outer("words").alias("at", "word")).withColumn("w", F.concat("word", F.lit(T.SPACE)))
    done = segmented(at.where("w is not null").select("w").distinct(), vocab)
    one = F.when(F.col("at").isNotNull(), F.struct("at", "ids"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.ids))
    whole = at.join(done, "w", "left").groupBy(*keys, "_row").agg(flat.alias("ids"))
    return whole.select(*keys, F.when(F.size("ids") == 0, F.array(F.lit(SPACE))).otherwise(F.col("ids")).alias("ids"))


#: The draws of a split go up to this.
DRAWS = 1 << 30


def splits(kids: dict, ratio: float) -> Callable[[list, int], list]:
    """What splits a row's types, given the hash of its seed and keys: a type at a place is replaced if the hash of the place, begun with the row's, is drawn."""
    import xxhash

    def split(ids: list, start: int) -> list:
        out = []
        for at, whole in enumerate(ids):
            left = [(f"{at:010d}", whole)]
            while left:
                place, idx = left.pop()
                pair = kids.get(idx)
                if pair and xxhash.xxh64_intdigest(place, start) % DRAWS < ratio * DRAWS:
                    left += [(place + "b", pair[1]), (place + "a", pair[0])]
                else:
                    out.append(idx)
        return out

    return split


def split_down(rows: DataFrame, keys: list[str], vocab: DataFrame, ratio: float, seed: int = 0, ids: str = "ids") -> DataFrame:
    """(keys, ids): each type, and each of its parts in turn, is replaced by its two kids with the given probability.

    The draw is a hash of the seed, the keys and the place in the tree, so repeats agree. A
    vocabulary of a measured size goes to all executors and a row is split inside
    itself. Beyond it, all of a round's types are looked up by one join; a round goes one
    step down the merges. Both ways draw the same.
    """
    kids = vocab.where(F.size("kids") == 2).select("idx", F.get("kids", F.lit(0)).alias("l"), F.get("kids", F.lit(1)).alias("r"))
    if kids.count() <= SENT_TYPES:
        sent = rows.sparkSession.sparkContext.broadcast({r["idx"]: (r["l"], r["r"]) for r in kids.collect()})

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            split = splits(sent.value, ratio)
            for whole, starts in batches:
                yield pd.Series([split([] if a is None else a, s % (1 << 64)) for a, s in zip(whole, starts.tolist(), strict=True)], dtype=object)

        return rows.select(*keys, run(F.col(ids), F.xxhash64(F.lit(seed), *keys)).alias("ids"))
    out = keys
    keys = [*keys, "_row"]
    rows = with_row(rows, out, ids=F.col(ids))
    now = rows.select(*keys, F.posexplode_outer("ids").alias("at", "idx")).select(*keys, F.format_string("%010d", "at").alias("place"), "idx", F.lit(True).alias("open"))
    done = None
    while True:
        draw = F.pmod(F.xxhash64(F.lit(seed), *out, "place"), F.lit(DRAWS)) < ratio * DRAWS
        seen = written(now.join(kids, "idx", "left").withColumn("open", draw & F.col("l").isNotNull()), "split")
        closed = seen.where("not open").select(*keys, "place", "idx")
        done = closed if done is None else done.unionByName(closed)
        if seen.where("open").isEmpty():
            break
        part = F.explode(F.array(F.struct(F.concat("place", F.lit("a")).alias("place"), F.col("l").alias("idx")), F.struct(F.concat("place", F.lit("b")).alias("place"), F.col("r").alias("idx"))))
        now = seen.where("open").select(*keys, part.alias("x")).select(*keys, "x.place", "x.idx")
    placed = F.filter(F.array_sort(F.collect_list(F.struct("place", "idx"))), lambda x: x.idx.isNotNull())
    return done.groupBy(*keys).agg(F.transform(placed, lambda x: x.idx).alias("ids")).drop("_row")


def permutations(vocab: DataFrame, top: DataFrame) -> DataFrame:
    """(idx, cut): all ways to cut each type of ``top`` (idx) along the tree of its merges, as names joined by spaces.

    The ways of a type are itself and each way of its left kid with each of its right.
    They are built from the letters up; a round joins what both kids already have.
    """
    need = written(top.select("idx"), "need")
    every = need
    while True:
        below = every.join(vocab.select("idx", "kids"), "idx").select(F.explode("kids").alias("idx")).distinct().join(need, "idx", "left_anti")
        every = written(below, "need")
        if every.isEmpty():
            break
        need = written(need.union(every), "need")
    types = vocab.join(need, "idx", "left_semi")
    ways = written(types.select("idx", F.array("name").alias("cuts"), (F.size("kids") == 0).alias("full")), "ways")
    while not ways.where("not full").isEmpty():
        full = ways.where("full")
        ready = types.where(F.size("kids") == 2).join(ways.where("not full").select("idx"), "idx", "left_semi")
        left = ready.join(full.select(F.col("idx").alias("lk"), F.col("cuts").alias("lc")), F.col("kids")[0] == F.col("lk"))
        both = left.join(full.select(F.col("idx").alias("rk"), F.col("cuts").alias("rc")), F.col("kids")[1] == F.col("rk"))
        product = F.flatten(F.transform("lc", lambda a: F.transform("rc", lambda b: F.concat_ws(" ", a, b))))
        new = both.select("idx", F.concat(F.array("name"), product).alias("cuts"), F.lit(True).alias("full"))
        new = written(new, "ways")
        ways = written(ways.join(new, "idx", "left_anti").unionByName(new), "ways")
    return ways.join(top.select("idx"), "idx", "left_semi").select("idx", F.explode(F.array_distinct("cuts")).alias("cut"))


def track_merges(words: DataFrame, n_types: int, most: int, least: int = 2) -> DataFrame:
    """(k, emd, mean_len) after k = 0 .. most merges learned from words (s, n): imbalance of the types, and mean symbols of a word."""
    found, _ = merges(words, n_types, most, least)
    return words.sparkSession.createDataFrame(track(words, n_types, Replay([m[:3] for m in found])), "k int, emd double, mean_len double")
