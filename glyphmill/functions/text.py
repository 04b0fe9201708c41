"""Text to pieces and back, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points that separate words (Unicode white space with the four information separators). Java's and RE2's regular expressions both take this spelling.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NO_WHITE = WHITE.replace("[", "[^", 1).removesuffix("+")
#: What stands for a space inside pieces.
SPACE = "▁"
#: Fixed value: Devanagari consonants.
CONSONANT = r"[\x{0915}-\x{0939}\x{0958}-\x{095F}]"


def words(text: Column) -> Column:
    """The words of a text, without empty ones."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def lines(text: Column) -> Column:
    """Only a line feed ends a line."""
    return F.split(text, "\n")


def chars(text: Column) -> Column:
    """The code points of a text; none for the empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def join_words(pieces: Column) -> Column:
    return F.array_join(pieces, " ")


def char_pieces(text: Column) -> Column:
    """Code points of the words, with ▁ between words."""
    return chars(F.array_join(words(text), SPACE))


def join_chars(pieces: Column) -> Column:
    return F.replace(F.array_join(pieces, ""), F.lit(SPACE), F.lit(" "))


def bpe_line(text: Column) -> Column:
    """The words, each with ▁ at its end; the empty line is a lone ▁."""
    return F.concat(F.array_join(words(text), SPACE), F.lit(SPACE))


def join_subwords(pieces: Column) -> Column:
    return strip(join_chars(pieces))


def byte_ids(text: Column) -> Column:
    """The values of a text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def byte_pieces(text: Column) -> Column:
    """Bytes in lower-case hexadecimal without a leading zero."""
    return F.transform(byte_ids(text), lambda b: F.lower(F.hex(b.cast("long"))))


def join_bytes(pieces: Column) -> Column:
    """The text of bytes in hexadecimal, one or two digits each; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, lambda p: F.lpad(p, 2, "0")), "")).cast("string"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def ngrams(items: Column, n: int) -> Column:
    """All runs of n neighbours; none if there are fewer items."""
    if n == 1:
        return F.transform(items, lambda x: F.array(x))
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - n + 1), lambda i: F.slice(v, i, n))
    return let(items, lambda v: F.when(F.size(v) >= n, runs(v)).otherwise(F.array()))


def clamp_runs(text: Column) -> Column:
    """Runs of three or more equal characters become two."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1")


def expand_consonants(text: Column) -> Column:
    """A ⋮ between neighbouring Devanagari consonants."""
    return F.regexp_replace(text, f"({CONSONANT})(?={CONSONANT})", "$1⋮")


def contract_consonants(text: Column) -> Column:
    return F.replace(text, F.lit("⋮"), F.lit(""))


def best_dtype(low: Column, high: Column) -> Column:
    """The narrowest integer type, unsigned first, that holds both ends."""
    out = F.lit("int64")
    for bits in (64, 32, 16, 8):
        out = F.when((low >= -(2 ** (bits - 1))) & (high <= 2 ** (bits - 1) - 1), F.lit(f"int{bits}")).otherwise(out)
        if bits < 64:
            out = F.when((low >= 0) & (high <= 2**bits - 1), F.lit(f"uint{bits}")).otherwise(out)
        else:
            out = F.when(low >= 0, F.lit("uint64")).otherwise(out)
    return out


def part_digits(parts: Column) -> Column:
    """Digits that number so many parts."""
    return F.ceil(F.log10(parts)).cast("int")
