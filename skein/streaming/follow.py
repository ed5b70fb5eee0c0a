"""A followed search: its newest page and its histogram, kept up to date batch by batch.

A batch is read once, while it is at hand; stored lines are never read again. The page is the best
rows of the page before and of the batch. The histogram's bins are powers of two wide (see
``histogram.aligned``): a batch is counted at the width that the range now needs, bins before it
merge in pairs, and counts add up. Both are bounded, by ``limit`` rows and by ``bins`` times the
levels. They are written for each batch under its number, and a batch that is repeated begins again from
the state before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.levels import DEFAULT_LEVELS
from skein.operators import histogram, search
from skein.plans.scratch import forget


class Followed:
    """The search for ``query``; its state lies below ``folder``, one for each followed search.

    ``take`` is what ``start``, ``start_raw`` and ``start_records`` call as ``then``.
    """

    def __init__(self, spark: SparkSession, folder: str, query: str = "", levels: Sequence[str] | None = DEFAULT_LEVELS, limit: int = search.PAGE, bins: int = 100):
        self._spark, self._folder = spark, folder
        self.query, self.levels, self.limit, self._bins = query, None if levels is None else tuple(levels), limit, bins

    def _numbers(self) -> list[int]:
        """The batches whose state is complete."""
        where = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder)
        store = where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
        done = store.exists
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[5:]) for n in names if n.startswith("bins-") and done(path(f"{self._folder}/{n}/_SUCCESS")))

    def take(self, rows: DataFrame, number: int) -> None:
        """Add a batch's stored lines."""
        before = max((n for n in self._numbers() if n < number), default=None)
        found = search.matches(rows, self.query, self.levels)
        page = found if before is None else found.unionByName(self._page(before), allowMissingColumns=True)
        page.orderBy(*search.newest_first()).limit(self.limit).coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/page-{number}")
        held = [] if before is None else self._held(before).collect()  # a row a bin and level
        times = found.agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b")).first()
        low = [x for x in (times.a, *(r.time_ms for r in held)) if x is not None]
        high = [x for x in (times.b, *(r.time_ms + r.width_ms - 1 for r in held)) if x is not None]
        wide = max([r.width_ms for r in held], default=1)
        width = max(wide, histogram.width_for(min(low), max(high), self._bins)) if low else 1
        new = histogram.binned(found.where("timestamp_ms is not null"), width)
        if held:
            old = self._held(before)
            begin = F.col("time_ms") - F.pmod("time_ms", F.lit(width).cast("long"))
            new = new.unionByName(old.select(begin.alias("time_ms"), F.lit(width).cast("long").alias("width_ms"), "level", "n"))
        total = new.groupBy("time_ms", "width_ms", "level").agg(F.sum("n").alias("n"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/bins-{number}")
        for old_number in (n for n in self._numbers() if n < number - 1):
            forget(self._spark, f"{self._folder}/bins-{old_number}")
            forget(self._spark, f"{self._folder}/page-{old_number}")

    def _page(self, number: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/page-{number}")

    def _held(self, number: int) -> DataFrame:
        return self._spark.read.schema("time_ms long, width_ms long, level string, n long").parquet(f"{self._folder}/bins-{number}")

    def started(self) -> bool:
        return bool(self._numbers())

    def page(self) -> DataFrame:
        """The newest ``limit`` lines, newest first."""
        return self._page(self._numbers()[-1]).orderBy(*search.newest_first())

    def bins(self) -> DataFrame:
        """(time_ms, width_ms, level, n), as ``histogram.aligned`` of all matches."""
        return self._held(self._numbers()[-1])
