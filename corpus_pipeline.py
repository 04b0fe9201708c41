"""From raw documents to token ids: each stage works on all that the one before it has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.bpe import bpe_encode
from glyphmill.llm.decontaminate import contaminated
from glyphmill.llm.langid import UNKNOWN, fit, language
from glyphmill.llm.neardup import near_duplicates
from glyphmill.llm.queries import vocabulary
from glyphmill.llm.secrets import redacted, secret_scan
from glyphmill.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, empty, or without a letter) go; a language that is missing is filled in.

    Where no language could be learned (no labelled documents), none is filled in, and
    documents with a letter stay.
    """
    model = fit(docs)
    told = language(docs, model)
    known = F.col("lang_pred") != UNKNOWN if model.members else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return told.where(known).withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(UNKNOWN)))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least id stays, and one row of repeated rows."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows, id_col="_row")
    ids = rows.select(F.col("_row").alias("id"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("id").alias("id")))
    chosen = classes.join(ids, "id").groupBy("class").agg(first.alias("first")).select(F.col("first.id").alias("_row"))
    return rows.join(chosen, "_row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go."""
    return contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced, and n_chars follows."""
    clean = secret_scan(docs).withColumn("_text", redacted(F.col("text"), F.col("all_spans")))
    changed = F.size("all_spans") > 0
    return clean.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(changed, F.char_length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and what they decode to."""
    return bpe_encode(docs, vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language ID", keep_known_languages),
    ("near-duplicates", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode),
]
#: SQL can express neither the trained language model nor the signatures; tests/llm holds the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
