"""What the operators of this subpackage share: inputs, tables in the shared folder, and shipping this package to executors."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.folder import forget, shared_folder, written

__all__ = ["forget", "settle", "shared_folder", "ship", "table", "written"]

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker gets at once. Spark's default of 10,000 whole documents takes hundreds of MB, and as much again for what is made of them; documents differ a thousandfold in length, so bytes are bounded too.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 1 << 20
#: Spark's settings of these, and what they are unless set.
BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", ROWS_AT_ONCE), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BYTES_AT_ONCE)}


def settle() -> None:
    """Give freed memory of this Python worker back to the system: workers live on, and other stages need it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, whatever their working folder is, and bound what a worker holds.

    The package is sent once for each context; a bound that was set by hand stays.
    """
    for key, (unset, most) in BOUNDS.items():
        if spark.conf.get(key) == unset:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if getattr(context, "_glyphmill_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "glyphmill.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    context._glyphmill_shipped = True
