"""What the operators share: tables, intermediate tables in the shared folder, and memoised word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans.scratch import forget, fresh_path, shared_dir, written

__all__ = ["Memo", "forget", "fresh_path", "shared_dir", "table", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """word -> bytes, filled on demand by ``make`` and emptied at ``limit`` entries.

    ``b"".join(map(memo.__getitem__, words))`` turns a whole text into fixed-width
    values without a Python-level loop. Emptying bounds a worker's memory and
    changes no result.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value
