"""Streams of texts: the same plans as for tables, without state or with running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T


def texts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def byte_encoded(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with ``ids``: no state, so any number of rows may be in flight."""
    return stream.withColumn("ids", T.byte_ids(F.col(text)))


def running_word_freq(stream: DataFrame, text: str = "text") -> DataFrame:
    """(term, freq) so far, for complete or update mode."""
    return stream.select(F.explode(T.words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, key, n) per tumbling window; rows later than the watermark are left out."""
    kept = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key)
    return kept.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
