"""Operator 2: byte-pair encoding and decoding by speculation and verification.

Greedy longest-match proposes tokens for every word. A proposal is the byte-pair
encoding exactly when each of its tokens is what merging its own letters gives, and
each adjacent pair of tokens is compatible: no merge across their border comes
earlier than the merges that build the two. Both tests run on arrays, for all words
of a batch at once; the words that fail are merged exactly, one by one.

Words never cross white space, so each worker keeps a bounded table of the encodings
of the chunks it has seen. No rows are shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship

#: The bound of a worker's table of chunks; it is emptied when full.
CACHE_CHUNKS = 200_000
#: Chunks up to this many characters are kept in the table.
CACHE_CHARS = 64
OUTPUT = "ids binary, n_tokens long, decoded string"
#: Separators that str.split() knows and the tokenizer's \s does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(other)) for b in range(256)]


class WordBpe:
    """The vocabulary of a tokenizers file with word ends (`</w>`), lower-casing and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = [""] * (max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for name, i in self.vocab.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_re = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.byte_ids = [self.vocab[c] for c in letters]
        self.last_ids = [self.vocab[c + self.end] for c in letters]
        # A word's key is its bytes, one character each, and a final U+0100 for the word's end.
        self.as_byte = as_byte = {c: chr(b) for b, c in enumerate(letters)}
        self.path, self.splitter = path, None
        self.by_key: dict[str, int] = {}
        for name, i in self.vocab.items():
            body, last = (name[: -len(self.end)], "Ā") if name.endswith(self.end) else (name, "")
            self.by_key["".join(as_byte[c] for c in body) + last] = i
        self.lengths = np.zeros(len(self.names), np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, i in self.by_key.items():
            self.lengths[i] = len(key)
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self._merge_arrays(model["merges"])
        self.cache: dict[str, tuple[bytes, int]] = {}

    def _merge_arrays(self, merges: list) -> None:
        n = len(self.names)
        self.made_at = np.full(n, -1, np.int64)  # the rank of the merge that makes a token; -1: a letter
        self.left, self.right = np.arange(n), np.arange(n)
        self.ranks: dict[int, tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ia, ib = self.vocab[a], self.vocab[b]
            made = self.vocab[a + b]
            self.ranks.setdefault(ia << 20 | ib, (rank, made))
            keys.append(ia << 20 | ib)
            ranks.append(rank)
            if self.made_at[made] < 0:
                self.made_at[made], self.left[made], self.right[made] = rank, ia, ib
        self.made_by_rank = np.array([self.vocab["".join(p.split(" ") if isinstance(p, str) else p)] for p in merges])
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys)[order], np.array(ranks)[order]
        made = np.flatnonzero(self.made_at >= 0)
        self.sound = self.made_at < 0  # tokens that merging their own letters gives
        whole = self.compatible(self.left[made], self.right[made], self.made_at[made])
        for t, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: self.made_at[x[0]]):
            self.sound[t] = ok and self.sound[self.left[t]] and self.sound[self.right[t]]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging keeps the border between each a and b (up to the merge ranked ``before``).

        The last merges of the two sides are undone from the latest on. A merge across
        the border that comes earlier than the one just undone would have taken its
        place. Times are 2 * rank, plus 1 for merges right of the border, as equal
        merges go from left to right.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 2 * NEVER) if before is None else 2 * before.astype(np.int64)
        while len(live):
            bad = 2 * self.rank_of(a, b) < limit
            ok[live[bad]] = False
            ta, tb = self.made_at[a], self.made_at[b]
            go = ~bad & ((ta >= 0) | (tb >= 0))
            live, a, b, ta, tb = live[go], a[go], b[go], ta[go], tb[go]
            first = ta > tb
            limit = np.where(first, 2 * ta, 2 * tb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def greedy(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches from left to right in all words: the tokens, the word of each, and which words they don't spell.

        A word isn't spelt where the longest match leaves the word's end alone.
        """
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        found = np.array(list(self.automaton.iter_long("ā".join(keys))), np.int64).reshape(-1, 2)
        ends, flat = found[:, 0] + 1, found[:, 1]
        word = np.searchsorted(starts, found[:, 0], side="right") - 1
        begins = ends - self.lengths[flat]
        first = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
        expected = np.where(first, starts[word], np.concatenate([[0], ends[:-1]])[: len(word)])
        spelt = np.zeros(len(keys), bool)
        spelt[word[ends == starts[word] + sizes[word]]] = True
        spelt[word[begins != expected]] = False
        return flat, word, ~spelt

    def letters(self, key: str) -> list[int]:
        data = key[:-1].encode("latin-1")
        return [*(self.byte_ids[b] for b in data[:-1]), self.last_ids[data[-1]]]

    def merged(self, keys: list[str]) -> list[list[int]]:
        """Exact merging: in each word the earliest merge first, equal ones from left to right."""
        out: list[list[int]] = [[]] * len(keys)
        by_width: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            by_width.setdefault((len(key) + 6) // 8 * 8, []).append(i)
        for width, rows in by_width.items():
            if width > 64:
                for i in rows:
                    out[i] = self.merged_long(self.letters(keys[i]))
            else:
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    for i, ids in zip(part, self.merged_rows([self.letters(keys[i]) for i in part], width), strict=True):
                        out[i] = ids
        return out

    def merged_rows(self, words: list[list[int]], width: int) -> list[list[int]]:
        """One merge in every word at a time, on a matrix with a word in each row and links between neighbours."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < size[:, None]] = np.fromiter((t for w in words for t in w), np.int64, int(size.sum()))
        rank = np.full((len(words), width + 1), NEVER)
        pairs = ids[:, 1:] >= 0
        rank[:, :-1][pairs] = self.rank_of(ids[:, :-1][pairs], ids[:, 1:][pairs])
        after = np.tile(np.minimum(np.arange(width + 1) + 1, width), (len(words), 1))
        before = np.tile(np.arange(width + 1) - 1, (len(words), 1))
        here = np.arange(len(words))
        while len(here):
            j = rank[here].argmin(1)
            best = rank[here, j]
            go = best != NEVER
            here, j, best = here[go], j[go], best[go]
            gone = after[here, j]
            k = after[here, gone]
            made = self.made_by_rank[best]
            ids[here, j], ids[here, gone], rank[here, gone] = made, -1, NEVER
            after[here, j], before[here, k] = k, j
            nxt = ids[here, k]
            rank[here, j] = np.where(nxt >= 0, self.rank_of(made, np.maximum(nxt, 0)), NEVER)
            b = j > 0
            h, p = here[b], before[here[b], j[b]]
            rank[h, p] = self.rank_of(ids[h, p], made[b])
        keep = ids >= 0
        cuts = np.cumsum(keep.sum(1))[:-1]
        return [x.tolist() for x in np.split(ids[keep], cuts)]

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a heap and links between neighbours."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := ranks.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = made, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := ranks.get(made << 20 | ids[k]):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := ranks.get(ids[h] << 20 | made)):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [t for t in ids if t >= 0]

    def newer_words(self, part: str) -> list[str]:
        """The keys of the words of a text with code points that this Python's tables don't know.

        What is a letter, and its lower case, depends on the version of Unicode, so the
        file's own normaliser and splitter, run by the library, tell.
        """
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path)
        pieces = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(part))
        return ["".join(map(self.as_byte.__getitem__, piece)) + "Ā" for piece, _ in pieces]

    def words(self, chunk: str) -> list[str | int]:
        """A chunk's words as keys; its special tokens as ids."""
        parts = self.special_re.split(chunk) if self.special_re and "<" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    out += [part.lower() + "Ā"] if part.isalpha() else [w + "Ā" for w in self.word_re.findall(part.lower())]
                elif not part.isprintable() and any(unicodedata.category(c) == "Cn" for c in part):
                    out += self.newer_words(part)
                else:  # letters are lowered one by one, so that a final sigma is no other letter
                    low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    out += [w.encode("utf-8").decode("latin-1") + "Ā" for w in self.word_re.findall(low)]
        return out

    def encode_words(self, keys: list[str]) -> dict[str, list[int]]:
        """Speculate, verify all adjacent pairs at once, merge the words that fail."""
        if not keys:
            return {}
        flat, word, fails = self.greedy(keys)
        fails[word[~self.sound[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & 0xFFFFF)
        fails[word[inner[~good[back]]]] = True
        cuts = np.searchsorted(word, np.arange(len(keys) + 1)).tolist()
        flat = flat.tolist()
        out = {k: flat[cuts[i] : cuts[i + 1]] for i, k in enumerate(keys)}
        failing = [keys[i] for i in np.flatnonzero(fails).tolist()]
        return out | dict(zip(failing, self.merged(failing), strict=True))

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        cache = self.cache
        split = [[] if not x else CHUNK.findall(x) if ODD_SPACE.search(x) else x.split() for x in texts]
        new = list(dict.fromkeys(c for chunks in split for c in chunks if c not in cache))
        for at in range(0, len(new), 16_000):
            words = [self.words(c) for c in new[at : at + 16_000]]
            found = self.encode_words(list(dict.fromkeys(w for x in words for w in x if isinstance(w, str))))
            for c, x in zip(new[at : at + 16_000], words, strict=True):
                ids = [t for w in x for t in (found[w] if isinstance(w, str) else (w,))]
                cache[c] = np.array(ids, "<u4").tobytes()
        for chunks in split:
            yield b"".join(map(cache.__getitem__, chunks))
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        else:
            for c in new:
                if len(c) > CACHE_CHARS:
                    del cache[c]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between each two: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def blocks(texts: pd.Series, chars: int = 1_500_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters, which bounds the memory of a batch."""
    run: list[str | None] = []
    size = 0
    for x in texts:
        x = x if isinstance(x, str) else None
        run.append(x)
        size += len(x or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def bpe(text: Column, path: str) -> Column:
    """A struct of ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (made from the ids) of each text.

    Null and empty texts have no tokens and decode to the empty string. The strings of
    special tokens are these tokens, as in the library.
    """

    @F.pandas_udf(OUTPUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.bpe import blocks, tokenizer
        from glyphmill.llm.shared import settle

        model = tokenizer(path)
        for texts in batches:
            out = [(ids, len(ids) // 4, model.decode(ids)) for run in blocks(texts) for ids in model.encode_batch(run)]
            yield pd.DataFrame(out, columns=["ids", "n_tokens", "decoded"])
        model.cache.clear()
        settle()

    return run(text)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text, without building ids for the JVM."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.bpe import blocks, tokenizer
        from glyphmill.llm.shared import settle

        model = tokenizer(path)
        for texts in batches:
            yield pd.Series([len(ids) // 4 for run in blocks(texts) for ids in model.encode_batch(run)], dtype="int64")
        model.cache.clear()
        settle()

    return run(text)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    place = F.sequence(F.lit(1), F.length(ids), F.lit(4))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i + k, F.lit(1))), 16, 10).cast("int")
    full = F.transform(place, lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536)
    return F.when(F.length(ids) >= 4, full).otherwise(F.array().cast("array<int>"))


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``; columns of these names are replaced.

    Rows are neither dropped nor merged: repeated rows give repeated results, an empty
    table an empty one.
    """
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decoded")]
    made = docs.select(F.struct(*keep).alias("row"), bpe(text, path).alias("made")) if keep else docs.select(bpe(text, path).alias("made"))
    return made.select(*(["row.*"] if keep else []), "made.ids", "made.n_tokens", "made.decoded")
