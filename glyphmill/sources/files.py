"""Text, vocabulary, frequency and n-gram files, and the store of encoded pairs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators.vocab import SCHEMA, as_row
from glyphmill.sources.folder import written


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(text): all files' lines; only a line feed ends one, `.gz` is unpacked."""
    return spark.read.text(list(paths), lineSep="\n").withColumnRenamed("value", "text")


#: Pieces of files up to which their first line numbers go to all executors.
LISTED_PIECES = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) with line numbers from 0, over a file or the files of a folder in the order of their names.

    Files carry no key. A scan hands out pieces of files in any order, so lines are
    counted for each piece (a file and where in it the piece begins), and a line adds what
    stands before its piece to its place there, which the JVM's own numbering gives; the
    plan is read twice with the same pieces.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")]
    rows = spark.read.text(path, lineSep="\n").select(*at, F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    sizes = written(rows.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("place").alias("first")), "pieces")
    before = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "begin", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if sizes.count() <= LISTED_PIECES else starts
    return rows.join(starts, ["file", "begin"]).select((F.col("start") + F.col("place") - F.col("first")).alias("id"), "text")


def write_lines(rows: DataFrame, path: str, order: list, line: str = "line") -> None:
    """A folder of text files that hold a column's lines in an order; sorted by ranges, so no task holds all of them. The rows are written once, as the sort reads them twice."""
    written(rows.select(*order, line), "lines").orderBy(*order).select(line).write.text(path, lineSep="\n")


def read_bitext(spark: SparkSession, src: str, tgt: str) -> DataFrame:
    """(id, x, y) of two files line by line; it raises if one has more lines."""
    a, b = numbered_lines(spark, src), numbered_lines(spark, tgt)
    if a.count() != b.count():
        raise ValueError("the files have different numbers of lines")
    return a.withColumnRenamed("text", "x").join(b.withColumnRenamed("text", "y"), "id")


#: Fixed value: what this version writes into the header of a vocabulary file.
VERSION = "1"


def with_header(rows: DataFrame, line: str, order: list, header: dict) -> DataFrame:
    """(value): the header as JSON after a `#`, then the lines in order; sorted by ranges, so no task holds all of them."""
    head = rows.sparkSession.createDataFrame([(0, "#" + json.dumps(header, ensure_ascii=False))], "after int, value string")
    both = rows.withColumns({"after": F.lit(1), "value": F.expr(line)}).unionByName(head, allowMissingColumns=True)
    return both.orderBy("after", *order).select("value")


def write_vocab(vocab: DataFrame, path: str, **meta: object) -> None:
    """A folder of text files, by index: a JSON header, then a type in each line. The header always names the scheme and the version."""
    levels = {str(r["level"]): r["n"] for r in vocab.groupBy("level").agg(F.count("*").alias("n")).collect()}
    header = {"total": sum(levels.values()), "version": VERSION, "levels": levels, "max_level": max(map(int, levels), default=-1), "created": str(datetime.now()), **meta}
    header["scheme"] = scheme_of(header)
    rows = vocab.select("idx", as_row().alias("row"))
    with_header(rows, "row", ["idx"], header).write.text(path, lineSep="\n")


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vocabulary, header). A fifth column may be missing; a kid that does not come before its type raises."""
    raw = spark.read.text(path, lineSep="\n")
    head = raw.where(F.col("value").startswith("#{")).limit(1).collect()
    parts = raw.where(~F.col("value").startswith("#{") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    kids = F.transform(F.filter(F.split(F.coalesce(F.get("p", F.lit(4)), F.lit("")), " "), lambda k: k != ""), lambda k: k.cast("int"))
    rows = parts.select(F.col("p")[0].cast("int").alias("idx"), F.col("p")[1].alias("name"), F.col("p")[2].cast("int").alias("level"), F.col("p")[3].cast("long").alias("freq"), kids.alias("kids"))
    late = F.exists("kids", lambda k: k >= F.col("idx"))
    rows = rows.withColumn("kids", F.when(late, F.raise_error(F.lit("a kid must come before its type"))).otherwise(F.col("kids")))
    return rows.select(*[f.split()[0] for f in SCHEMA.split(", ")]), json.loads(head[0]["value"][1:]) if head else {}


def scheme_of(header: dict) -> str:
    """The kind of codec a vocabulary file is for; by its highest level where it does not say."""
    return header.get("scheme") or {0: "char", 1: "subword", 2: "word"}.get(header.get("max_level"), "class")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(vocabulary, scheme) of a vocabulary file; what the scheme names encodes and decodes with it (``operators.schemes``)."""
    vocab, header = read_vocab(spark, path)
    if not header.get("scheme"):
        header["max_level"] = header.get("max_level", vocab.agg(F.max("level")).first()[0])
    return vocab, scheme_of(header)


def write_oov(report: DataFrame, path: str) -> None:
    """The three lines of an OOV report (kind, types, tokens, token_pct): types, tokens and their share, inside and outside the vocabulary."""
    found = {r["kind"]: r for r in report.collect()}  # two rows
    cells = lambda c: [str(found[k][c]) if k in found else "0" for k in ("InVocab", "OOV")]
    lines = [["", "InVocab", "OOV"], ["Types", *cells("types")], ["Token Count", *cells("tokens")], ["Token %", *cells("token_pct")]]
    rows = [("\t".join(x),) for x in lines]
    report.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.text(path)  # four lines


def write_freqs(freqs: DataFrame, path: str, n_lines: int = -1) -> None:
    types, tokens = freqs.agg(F.count("*"), F.coalesce(F.sum("freq"), F.lit(0))).first()
    header = {"types": types, "tokens": tokens, "line_count": n_lines}
    with_header(freqs, "concat_ws('\t', term, cast(freq as string))", [F.desc("freq"), "term"], header).write.text(path, lineSep="\n")


def read_freqs(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((term, freq), line count; -1 if the file does not say). Terms may hold anything but a tab; white space around them goes, and of equal ones the last counts."""
    raw = spark.read.text(path, lineSep="\n")
    parts = F.split("value", "\t")
    is_head = F.col("value").startswith("#") & (F.size(parts) != 2)
    head = raw.where(is_head).limit(1).collect()
    term = F.regexp_replace(parts[0], r"(?U)^\s+|\s+$", "")
    rows = raw.where(~is_head & (F.size(parts) == 2)).select(term.alias("term"), parts[1].cast("long").alias("freq"), F.monotonically_increasing_id().alias("place"))
    rows = rows.groupBy("term").agg(F.max_by("freq", "place").alias("freq"))
    return rows, json.loads(head[0]["value"][1:]).get("line_count", -1) if head else -1


def write_ngrams(grams: DataFrame, path: str) -> None:
    """JSON lines [ids, freq, names], most frequent first."""
    row = F.concat(F.lit("["), F.to_json("ids"), F.lit(","), F.col("freq").cast("string"), F.lit(","), F.to_json("names"), F.lit("]"))
    grams.orderBy(F.desc("freq"), "ids").select(row.alias("value")).write.text(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    parsed = F.from_json("value", "array<string>")
    raw = spark.read.text(path).select(parsed.alias("v"))
    return raw.select(F.from_json(F.col("v")[0], "array<int>").alias("ids"), F.col("v")[1].cast("long").alias("freq"), F.from_json(F.col("v")[2], "array<string>").alias("names"))


def general(x: Column) -> Column:
    """A number from 0 to 1 with six digits that count, without zeros at its end; below 0.0001 as a power of ten."""
    out = F.format_string("%.5e", x)
    for digits, least in ((9, 9.999995e-5), (8, 1e-3), (7, 1e-2), (6, 1e-1), (5, 1.0)):
        out = F.when(x >= least, F.format_string(f"%.{digits}f", x)).otherwise(out)
    return F.when(x == 0, "0").otherwise(F.regexp_replace(out, r"\.?0+(?=e|$)", ""))


#: The columns of a table of listed n-grams.
GRAM_COLUMNS = ("Rank", "Gram", "Name", "RankF", "RefF", "CandF", "Recall", "Precision", "F1")


def gram_lines(table: DataFrame) -> DataFrame:
    """(rank, line) of a table of listed n-grams (``quality.gram_table``): nine columns between tabs, ids and names with commas between."""
    commas = lambda c: F.replace(c, F.lit(" "), F.lit(","))
    cells = [F.col("rank").cast("string"), commas("gram"), commas("name"), *[F.col(c).cast("string") for c in ("rank_freq", "ref_freq", "cand_freq")], *[general(F.col(c)) for c in ("recall", "precision", "f1")]]
    return table.select("rank", F.concat_ws("\t", *cells).alias("line"))


def write_gram_table(table: DataFrame, path: str) -> None:
    head = table.sparkSession.createDataFrame([(0, "\t".join(GRAM_COLUMNS))], "rank bigint, line string")
    write_lines(gram_lines(table).unionByName(head), path, ["rank"])


def write_store(pairs: DataFrame, path: str, parts: int | None = None, part_size: int = 5_000_000, overwrite: bool = False, by: str | None = None) -> None:
    """Parquet parts of at most so many rows; the committer's _SUCCESS tells that all are there. by: a column whose values are the parts."""
    rows = pairs.repartition(by) if by else pairs.repartition(parts) if parts else pairs
    writer = rows.write.option("maxRecordsPerFile", part_size).mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_store(spark: SparkSession, path: str, shuffle_seed: int | None = None, keep: bool = False) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise ValueError("the store has no _SUCCESS: it was not written to its end")
    rows = spark.read.parquet(path)
    rows = rows.orderBy(F.rand(shuffle_seed)) if shuffle_seed is not None else rows
    return rows.cache() if keep else rows


def manifest(store: DataFrame) -> DataFrame:
    """(part, n) of a store that was read."""
    return store.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part")).agg(F.count("*").alias("n"))
