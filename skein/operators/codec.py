"""Number sequences as differences and back, and as Parquet stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import unzigzag, zigzag

def deltas(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``delta``: each value's zig-zag difference to the one before (the first to 0)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("delta", zigzag(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))


def restored(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with the values that ``delta`` stands for, as ``name``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(unzigzag(F.col("delta"))).over(w))


#: How Parquet is asked to write numbers: differences in as many bits as they need, or numbers of a
#: dictionary in as many bits as it needs.
ENCODINGS = {
    "varint": {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"},
    "bit_planes": {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true"},
}


def stored(rows: DataFrame, key: str, order: str, value: str, encoding: str, path: str) -> DataFrame:
    """(key, position, value): each key's numbers, written in order in this encoding and read back.
    Sorted numbers lie next to each other, so differences are small."""
    numbers = rows.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("position"), F.col(value).cast("long").alias("value"))
    numbers.repartitionByRange("key", "position").sortWithinPartitions("key", "position").write.options(**ENCODINGS[encoding]).parquet(path)
    return rows.sparkSession.read.schema(numbers.schema).parquet(path)
