"""Operator 9: quality rules with DataFrame functions only.

A document's own counts, and a hash and a size of each of its lines, come from one pass
over its text. The method's verdict comes from other documents: normalised lines are
hashed, the distinct documents that hold each are counted per host, lines above the
limit, which grows with the host, are taken out, and documents left with too few of their words are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line is boilerplate where more distinct documents of its host hold it than this number and than one in SHARE of them: ten texts of a small host that share a line by chance are rare, and so is a thousandth of a large host's.
MOST_DOCUMENTS, SHARE = 10, 1000
#: The share of its words that a document must keep.
LEAST_KEPT = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))


def neighbours_hashed(hashes: Column, apart: int) -> Column:
    """A hash of each two elements that stand so far apart."""
    n = F.size(hashes) - apart
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + apart, n), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the columns of BASE (long).

    A word counts as repeated if it stands in a window of 8 words that the text holds
    twice or more. Windows are compared by a 64-bit hash, built from those of 2 and of 4
    words; equal ones are neighbours once sorted, so the work is n log n for any text.
    """
    out = docs.withColumn("_words", words(text)).withColumn("_lines", lines(text))
    out = out.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_words").cast("long"))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_windows", F.when(F.col("n_words") > WINDOW, F.col("_words")).otherwise(none))
    for apart in (1, 2, 4):
        out = out.withColumn("_windows", F.when(F.size("_windows") > 0, neighbours_hashed(F.col("_windows"), apart)).otherwise(none))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    equal = lambda s, k: F.coalesce(F.get("_sorted", k).h == s.h, F.lit(False))
    twice = F.filter("_sorted", lambda s, k: equal(s, k - 1) | equal(s, k + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda s: s.i)))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    return (
        out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
        .drop("_words", "_lines", "_windows", "_sorted", "_at")
    )


def hashed_lines(text: Column) -> Column:
    """(line, n) of each line that holds a word: a hash of the line, in lower case with digits as 0 and one space between words, and its words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    trimmed = F.filter(F.transform(F.split(plain, "\n"), F.trim), lambda x: x != "")
    n = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("line"), n(x).alias("n")))


def boilerplate_words(rows: DataFrame) -> DataFrame:
    """(host, copy, boilerplate): the words of each distinct text of a host that stand in lines above the limit; texts without such lines are absent.

    rows: (host, copy, lines), copy being a hash of the text. Equal texts of a host count
    as one, so copies alone make no line boilerplate.
    """
    texts = written(rows.groupBy("host", "copy").agg(F.first("lines").alias("lines")), "texts")
    held = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.line))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > MOST_DOCUMENTS).alias("o")
    sizes = texts.groupBy("host").agg(F.count("*").alias("size")).alias("h")
    above = often.join(sizes, F.col("o.host").eqNullSafe(F.col("h.host"))).where(SHARE * F.col("docs") > F.col("size"))
    common = written(above.select("o.host", "line"), "common-lines")
    one = texts.select("copy", "host", F.explode("lines").alias("x")).select("copy", "host", "x.line", "x.n").alias("a")
    on = F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line"))
    return one.join(common.alias("b"), on, "left_semi").groupBy("host", "copy").agg(F.sum("n").alias("boilerplate"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, BASE, base_failed, kept, n_boilerplate_words) of each document.

    Null texts have no words, and so fail. Repeated rows, and rows that share an id,
    are judged each by its own text. A null host is a host of its own. An empty table
    gives no rows; a text of any length is read whole.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counted = base_counts(rows, F.col("text")).withColumn("copy", F.xxhash64("text")).withColumn("lines", hashed_lines(F.col("text"))).drop("text")
    counted = written(counted, "counted")
    on = F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.copy") == F.col("b.copy"))
    both = counted.drop("lines").alias("a").join(boilerplate_words(counted.select("host", "copy", "lines")).alias("b"), on, "left")
    gone = F.coalesce("b.boilerplate", F.lit(0))
    failed = (F.col("a.n_words") < LEAST_WORDS) | (100 * F.col("a.n_repeat_words") > MOST_REPEATED * F.col("a.n_words"))
    kept = ~failed & (F.col("a.n_words") - gone >= LEAST_KEPT * F.col("a.n_words"))
    return both.select(F.col("a.id").alias(id_col), *[F.col(f"a.{c}") for c in BASE], failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_boilerplate_words"))


def oracle() -> str:
    """The query's rows in DuckDB SQL, from texts where this compares hashes."""
    space, gap = r"[\x20\x09-\x0D]+", r"[\x20\x09\x0B-\x0D]+"
    plain = f"regexp_replace(regexp_replace(lower(text), '{gap}', ' ', 'g'), '[0-9]', '0', 'g')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '{space}'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
      list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS plain FROM d),
    place AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
    win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM place),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY rid),
    texts AS (SELECT source, text, any_value(plain) AS plain FROM w GROUP BY source, text),
    l AS (SELECT source, text, unnest(plain) AS line FROM texts),
    sizes AS (SELECT source, count(*) AS size FROM texts GROUP BY source),
    often AS (SELECT source, line, count(*) AS docs FROM (SELECT DISTINCT source, text, line FROM l) GROUP BY source, line HAVING count(*) > {MOST_DOCUMENTS}),
    common AS (SELECT o.source, line FROM often o JOIN sizes h ON h.source IS NOT DISTINCT FROM o.source WHERE {SHARE} * docs > size),
    gone AS (SELECT l.source, l.text, CAST(sum(len(string_split(l.line, ' '))) AS BIGINT) AS n FROM l JOIN common c ON c.line = l.line AND c.source IS NOT DISTINCT FROM l.source GROUP BY l.source, l.text),
    base AS (SELECT w.rid, w.doc_id, w.source, w.text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
    judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(gone.n, 0) >= {LEAST_KEPT} * n_words AS kept,
      coalesce(gone.n, 0) AS n_boilerplate_words FROM judged j LEFT JOIN gone ON gone.text = j.text AND gone.source IS NOT DISTINCT FROM j.source
    """
