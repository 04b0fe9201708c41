"""One way in for all kinds of codecs: learn a vocabulary by its scheme, encode and decode with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import bpe as M
from glyphmill.operators import codec as C
from glyphmill.operators import vocab as V

#: The names of schemes, and other names that users know them by.
SCHEMES = ("char", "subword", "word", "class", "byte")
ALIASES = {"bpe": "subword"}


def scheme_named(name: str) -> str:
    found = ALIASES.get(name, name)
    if found not in SCHEMES:
        raise ValueError(f"{name} is none of {', '.join(SCHEMES)}")
    return found


def learn_vocab(rows: DataFrame, scheme: str, text: str = "text", **settings: object) -> DataFrame:
    """The vocabulary that the scheme learns from a column; settings are those of its learner."""
    learners = {"char": V.learn_chars, "subword": M.learn_bpe, "word": V.learn_words, "class": V.learn_classes, "byte": V.byte_vocab}
    return learners[scheme_named(scheme)](rows, text, **settings)


def learn_from_counts(freqs: DataFrame, scheme: str, n_lines: int = 0, **settings: object) -> DataFrame:
    """The vocabulary that ``learn_vocab`` gives, from counts (term, freq) in place of texts.

    Terms are words for the schemes word and subword, characters for char, labels for
    class, and texts or words for byte, whose bytes count as often as they do. Equal terms
    add up, null ones are left out. n_lines: the lines they were counted in, 0 or less if not known.
    """
    kind, lines = scheme_named(scheme), max(n_lines, 0)
    freqs = freqs.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("freq").alias("freq"))
    if kind == "subword":
        return M.learn_bpe(None, word_freqs=freqs, n_lines=lines, **settings)
    if kind == "class":
        return V.class_vocab(freqs)
    if kind == "byte":
        each = freqs.select(F.explode(T.byte_ids(F.col("term"))).alias("term"), "freq")
        return V.byte_table(each.groupBy("term").agg(F.sum("freq").alias("freq")))
    cut = {"coverage": V.CHAR_COVERAGE, "min_freq": V.CHAR_MIN_FREQ} if kind == "char" else {"min_freq": V.WORD_MIN_FREQ}
    return V.init_vocab(freqs, lines, kind, **{**cut, **settings})


def encode(rows: DataFrame, keys: list[str], vocab: DataFrame, scheme: str, text: str = "text") -> DataFrame:
    """(keys, ids)."""
    kind = scheme_named(scheme)
    if kind == "byte":
        return C.encode_bytes(rows, keys, text)
    encoders = {"char": C.encode_chars, "subword": M.encode_bpe, "word": C.encode_words, "class": C.encode_class}
    return encoders[kind](rows, keys, vocab, text)


def decode(rows: DataFrame, keys: list[str], vocab: DataFrame, scheme: str, ids: str = "ids") -> DataFrame:
    """(keys, text)."""
    kind = scheme_named(scheme)
    return C.decode_bytes(rows, keys, ids) if kind == "byte" else C.decode(rows, keys, vocab, kind, ids)


def to_lines(rows: DataFrame, keys: list[str], vocab: DataFrame, scheme: str, text: str = "text", indices: bool = False) -> DataFrame:
    """(keys, line): a text's pieces with a space between; their ids with ``indices``, else their names.

    Names are the text's own words, characters, bytes or label, known or not; of subwords
    those in the vocabulary, with `<unk>`. A null text is an empty one.
    """
    kind = scheme_named(scheme)
    whole = rows.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if indices:
        return encode(whole, keys, vocab, kind, text).select(*keys, F.array_join("ids", " ").alias("line"))
    if kind == "subword":
        return C.names_of(M.encode_bpe(whole, keys, vocab, text), keys, vocab).select(*keys, F.array_join("pieces", " ").alias("line"))
    pieces = {"char": T.char_pieces, "word": T.words, "class": lambda x: F.array(T.strip(x)), "byte": T.byte_pieces}
    return whole.select(*keys, F.array_join(pieces[kind](F.col(text)), " ").alias("line"))


def from_lines(rows: DataFrame, keys: list[str], vocab: DataFrame, scheme: str, line: str = "line", indices: bool = False) -> DataFrame:
    """(keys, text) of lines of ids or of names, between which any white space stands.

    What is no number raises, and so does an id outside the vocabulary. Names need not be
    known, but those of bytes are hexadecimal. A null line is an empty one.
    """
    kind = scheme_named(scheme)
    parts = T.words(F.coalesce(F.col(line), F.lit("")))
    if indices:
        return decode(rows.select(*keys, F.transform(parts, lambda x: x.cast("int")).alias("ids")), keys, vocab, kind)
    if kind == "byte":
        number = lambda x: F.when(x == "<s>", 256).when(x == "</s>", 257).otherwise(F.conv(x, 16, 10).cast("int"))
        return C.decode_bytes(rows.select(*keys, F.transform(parts, number).alias("ids")), keys)
    return rows.select(*keys, C.JOINERS[kind](parts).alias("text"))
