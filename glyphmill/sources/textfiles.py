"""Learning, encoding, decoding and estimating on text files: what is read, the model and what is written are all files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators import quality as Q
from glyphmill.operators import schemes
from glyphmill.sources import files
from glyphmill.sources.folder import written


def learn_file(spark: SparkSession, inp: str, model: str, scheme: str, counted: bool = False, **settings: object) -> None:
    """A vocabulary file learned from text, a line a text; with ``counted`` from a file of counts as ``files.write_freqs`` makes it."""
    if counted:
        freqs, n_lines = files.read_freqs(spark, inp)
        vocab = schemes.learn_from_counts(freqs, scheme, n_lines, **settings)
    else:
        vocab = schemes.learn_vocab(files.read_lines(spark, inp), scheme, **settings)
    files.write_vocab(written(vocab, "vocab"), model, scheme=schemes.scheme_named(scheme))


def encode_file(spark: SparkSession, inp: str, out: str, model: str, indices: bool = False) -> None:
    """A line of ids, or of names, for each line of text, in the same order. An empty file gives a folder without lines."""
    vocab, scheme = files.load(spark, model)
    lines = schemes.to_lines(files.numbered_lines(spark, inp), ["id"], written(vocab, "vocab"), scheme, indices=indices)
    files.write_lines(lines, out, ["id"])


def decode_file(spark: SparkSession, inp: str, out: str, model: str, indices: bool = False) -> None:
    """A line of text for each line of ids or of names, in the same order."""
    vocab, scheme = files.load(spark, model)
    texts = schemes.from_lines(files.numbered_lines(spark, inp), ["id"], written(vocab, "vocab"), scheme, line="text", indices=indices)
    files.write_lines(texts, out, ["id"], "text")


def estimate_file(spark: SparkSession, inp: str, model: str) -> DataFrame:
    """``quality.codec_quality`` of a model over a file of text."""
    vocab, scheme = files.load(spark, model)
    vocab, rows = written(vocab, "vocab"), files.read_lines(spark, inp)
    unknown = {"class": -1, "byte": -1}.get(scheme, 1)
    return Q.codec_quality(vocab, Q.usage(schemes.encode(rows, [], vocab, scheme)), rows.count(), unknown)
