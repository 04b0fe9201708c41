"""Operator 10: secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Further spans come from candidate strings
whose Shannon entropy in a sliding window is high for their class of characters. The
window's entropy is kept by incremental counts: a step forward changes the sum of
c * log2(c) only by the character that leaves and the one that enters. Placeholders,
paths and identifiers on an allow-list are let be. No rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ASSIGN_MAY = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,})"""
VALUE_CHARS = 6
#: Greedy runs with a least length are the greedy runs that are long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of 20 or more characters that hold a digit or letters of both cases, tried where a run begins only.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})"
    r"(?=[A-Za-z+/_=-]*+[0-9]|[A-Z+/_=-]*+[a-z][a-z+/_=-]*+[A-Z]|[+/_=-]*+[A-Z][A-Z+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}"
)
WINDOW = 20
#: Matches of one fold.
FOLD = 256
#: The characters of candidates, in the order of their counts in the fold's state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a candidate that one fold takes at most; the next starts WINDOW - 1 before its end.
SLICE = 256
#: For each class of characters the least entropy, in bits, of a window that tells a secret. Strings are of the first class that holds all of their characters.
CLASSES = (
    (r"^[0-9+/_=-]+$", 99.0),
    (r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    (r"^[0-9a-z]+$|^[0-9A-Z]+$", 3.5),
    (r"^[0-9A-Za-z]+$", 3.5),
    (r"^[0-9a-z+/_=-]+$|^[0-9A-Z+/_=-]+$", 3.7),
    (r"", 3.5),
)
#: A word in one case or with a capital, a name of up to five such words, with or without a number; or a number.
WORD = r"(?:(?:[A-Z]?[a-z]{1,16}|[A-Z]{1,16}|[A-Z]?[a-z]{2,12}(?:[A-Z][a-z]{2,12}){1,4})[0-9]{0,4}|[0-9]{1,16})"
#: Words with separators between them only.
WORDS = rf"^[+/_=-]*+(?:{WORD}(?:[+/_=-]++|$))*+$"
#: Letters, all of them in words, and a short number after a word or V where a part ends, or as a part after a word: parts of names in mixed case, short ones of them, or capitals up to a separator.
NAME = (
    r"^[+/_=-]*+(?:(?:[A-Z]{0,5}[a-z]{2,20}|As|At|By|Do|Go|Id|If|In|Is|It|My|No|Of|On|Or|To|Up|[A-Z]{1,16}(?=[+/_=-]|$)|"
    r"(?:(?<=[a-z])|(?<=[a-z][/_-])|V)[0-9]{1,4}(?=[+/_=-]|$))[+/_=-]*+)*+$"
)
#: A word that tells the name of a version, a build or a platform, all of whose parts are numbers or words with a number after them.
VERSION = (
    r"^(?=(?:.*[+_-])?(?:rc|alpha|beta|build|release|snapshot|dev|nightly|linux|windows|win|darwin|macos|x86|amd64|x64|arm64|aarch64)[0-9]{0,8}(?:[+_-]|$))"
    r"(?:(?:[a-z]{1,12}[0-9]{0,8}|[0-9]{1,8})(?:[+_-]++|$))++$"
)
#: What is no secret, however it looks.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx|0123456789|1234567890|abcdefgh",
    r"^(?:https?|www)[:/]",
    rf"^(?=/?[^/]++/[^/]++/)[/_-]*+(?:{WORD}(?:[/_-]++|$))*+$",
    NAME,
    VERSION,
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _parts(items: Column) -> Column:
    """An array in parts of at most FOLD elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(FOLD)), lambda i: F.slice(items, i + 1, FOLD))


def _found(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """The spans of a pattern's matches, from left to right. value: a group with too few characters drops its match.

    Each match is taken together with what stands before it, so that the lengths of
    both give its place; \\G keeps the search from trying the text's end again and again.
    """
    whole = rf"(?s)\G(.*?)({pattern})"
    before, match = (F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2))
    steps = F.zip_with(before, match, lambda a, b: F.struct(F.char_length(a).alias("a"), F.char_length(b).alias("b")))
    if value:
        values = F.regexp_extract_all(text, F.lit(whole), F.lit(value))
        steps = F.zip_with(steps, values, lambda s, v: F.struct(s.a.alias("a"), s.b.alias("b"), (F.char_length(v) >= VALUE_CHARS).alias("ok")))
    number = KINDS.index(kind)
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x.a + x.b)

    def step(acc: Column, x: Column) -> Column:
        start, stop = acc.at + x.a, acc.at + x.a + x.b
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop")))
        spans = F.concat(acc.spans, span)
        return F.struct(stop.alias("at"), (F.when(x.ok, spans).otherwise(acc.spans) if value else spans).alias("spans"))

    # a fold copies what it has found so far, so it goes over parts of bounded length: first their ends, then the spans of each
    def spans_of(steps: Column) -> Column:
        ends = F.aggregate(F.transform(_parts(steps), total), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        starts = F.slice(ends, 1, F.size(ends) - 1)
        return F.flatten(F.zip_with(_parts(steps), starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), _none().alias("spans")), step, lambda acc: acc.spans)))

    return _let(steps, spans_of)


def base_spans(text: Column) -> Column:
    """The spans of the three patterns by start, then kind; code points, end exclusive."""
    assign = F.when(text.rlike(ASSIGN_MAY), _found(text, ASSIGN, "assign", 4)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _found(text, ACCESS, "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _found(text, HEX, "hex")).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def window_entropy(s: Column) -> Column:
    """The largest Shannon entropy of a window of WINDOW characters in a short string of ALPHABET.

    The state holds the count of each character in the window and the sum of
    c * log2(c); a step changes the two counts of the characters that enter and leave.
    """
    logs = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)])
    places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    term = lambda k: F.get(logs, k)
    count = lambda counts, c: F.get(counts, c - 1)
    moved = lambda counts, c, by: F.transform(counts, lambda n, i: F.when(i == c - 1, n + by).otherwise(n))

    def step(acc: Column, i: Column) -> Column:
        new = F.get(acc.places, i)
        old = F.get(acc.places, i - WINDOW)
        lost = F.when(i >= WINDOW, moved(acc.counts, old, -1)).otherwise(acc.counts)
        gone = F.when(i >= WINDOW, term(count(acc.counts, old) - 1) - term(count(acc.counts, old))).otherwise(0.0)
        k = F.when((i >= WINDOW) & (new == old), count(acc.counts, new) - 1).otherwise(count(acc.counts, new))
        total = acc.total + gone + term(k + 1) - term(k)
        best = F.when(i >= WINDOW - 1, F.greatest(acc.best, math.log2(WINDOW) - total / WINDOW)).otherwise(acc.best)
        return F.struct(acc.places.alias("places"), moved(lost, new, 1).alias("counts"), total.alias("total"), best.alias("best"))

    counts = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(places.alias("places"), counts.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), start, step, lambda acc: acc.best)


def high_entropy(s: Column) -> Column:
    """Whether a candidate reaches its class's entropy in some window and is on no allow-list."""
    need = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(s.rlike(pattern), bits).otherwise(need)
    stride = SLICE - WINDOW + 1
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - WINDOW, F.lit(0)), F.lit(stride)), lambda i: F.substring(s, i + 1, F.lit(SLICE)))
    tops = F.array_max(F.transform(slices, window_entropy))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    return ~allowed & F.when(need > math.log2(WINDOW), False).otherwise(tops >= need)


def _outside(text: Column, base: Column, x: Column) -> Column:
    """The parts of a candidate that no base span covers; all of it if none touches it.

    A part made of words only, such as a path before a hash or a key's name, is let be,
    unless a hex or access span goes on in it without a separator.
    """
    touching = F.filter(base, lambda b: (b.start < x.stop) & (x.start < b.stop))
    inside = lambda k: k.isin(KINDS.index("access"), KINDS.index("hex"))
    none = F.array().cast("array<struct<start:int,stop:int,left:boolean,right:boolean>>")

    def part(acc: Column, stop: Column, right: Column) -> Column:
        one = F.array(F.struct(acc.at.alias("start"), stop.alias("stop"), acc.left.alias("left"), right.alias("right")))
        return F.when(stop > acc.at, F.concat(acc.parts, one)).otherwise(acc.parts)

    def step(acc: Column, b: Column) -> Column:
        left = F.when(b.stop > acc.at, inside(b.kind)).otherwise(acc.left)
        return F.struct(F.greatest(acc.at, b.stop).alias("at"), left.alias("left"), part(acc, b.start, inside(b.kind)).alias("parts"))

    def kept(p: Column) -> Column:
        s = F.substring(text, p.start + 1, p.stop - p.start)
        return ~s.rlike(WORDS) | (p.left & s.rlike("^[A-Za-z0-9]")) | (p.right & s.rlike("[A-Za-z0-9]$"))

    start = F.struct(x.start.alias("at"), F.lit(False).alias("left"), none.alias("parts"))
    parts = F.aggregate(touching, start, step, lambda acc: part(acc, x.stop, F.lit(False)))
    span = lambda p: F.struct(p.start.alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), p.stop.alias("stop"))
    return F.when(F.size(touching) == 0, F.array(x)).otherwise(F.transform(F.filter(parts, kept), span))


def entropy_spans(text: Column, base: Column) -> Column:
    """The spans of candidates with high entropy, without what base spans cover."""
    found = F.when(text.rlike(CANDIDATE), _found(text, CANDIDATE, "entropy")).otherwise(_none())
    covered = lambda x: F.exists(base, lambda b: (b.start <= x.start) & (x.stop <= b.stop))
    secret = F.filter(found, lambda x: ~covered(x) & high_entropy(F.substring(text, x.start + 1, x.stop - x.start)))
    return F.flatten(F.transform(secret, lambda x: _outside(text, base, x)))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``; columns of these names are replaced.

    Null and empty texts have no spans. Every row of the input is one row of the output,
    repeated rows give repeated results, an empty table an empty one; texts are read whole.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    scanned = docs.withColumn("base_spans", base_spans(text))
    return scanned.withColumn("all_spans", F.array_sort(F.concat("base_spans", entropy_spans(text, F.col("base_spans")))))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or run of spans that overlap, replaced by the mark. Nulls stay.

    What stands between spans is cut out of blocks of the text and joined once, so no
    piece is copied again and again.
    """
    gap_of = "struct<start:int,stop:int>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc.at.alias("start"), s.start.alias("stop")))
        return F.struct(F.greatest(acc.at, s.stop).alias("at"), F.when(s.start >= acc.at, F.concat(acc.gaps, gap)).otherwise(acc.gaps).alias("gaps"))

    furthest = lambda parts: F.transform(parts, lambda p: F.array_max(F.transform(p, lambda x: x.stop)))
    ends = F.aggregate(furthest(_parts(spans)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))
    none = F.array().cast(f"array<{gap_of}>")
    rest = F.array(F.array(F.struct(F.array_max(F.transform(spans, lambda x: x.stop)).alias("start"), F.char_length(text).alias("stop"))))
    gaps = F.zip_with(_parts(spans), F.slice(ends, 1, F.size(ends) - 1), lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("gaps")), step, lambda acc: acc.gaps))
    first, last = (lambda p: F.get(p, 0).start), (lambda p: F.element_at(p, -1).stop)
    block = lambda p: F.struct(p.alias("p"), first(p).alias("at"), F.substring(text, first(p) + 1, last(p) - first(p)).alias("block"))
    blocks = F.transform(F.filter(F.concat(gaps, rest), lambda p: F.size(p) > 0), block)
    pieces = F.transform(blocks, lambda x: F.transform(x.p, lambda g: F.substring(x.block, g.start - x.at + 1, g.stop - g.start)))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.flatten(pieces), mark))
