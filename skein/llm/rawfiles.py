"""Files of raw bytes in the shared store, through Spark's own readers and writers.

Spark's text writer puts out a string column byte for byte and ends each row with
a separator. Rows that end in a zero byte are therefore written without it, with
the zero byte as separator; a row that doesn't is followed by one, so a format
must bear a zero byte after any of its units. ``binaryFile`` reads such files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(units: DataFrame, column: str, path: str, rows_per_file: int = 0) -> None:
    """The units of each partition, in its order, as one file (or more, of ``rows_per_file`` units)."""
    unit = F.col(column)
    ends = F.substring(unit, F.length(unit), F.lit(1)) == F.lit(b"\x00")
    body = F.when(ends, F.substring(unit, F.lit(1), F.length(unit) - 1)).otherwise(unit)
    units.select(body.cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", rows_per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
