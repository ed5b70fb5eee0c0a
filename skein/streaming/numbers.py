"""One number for each line that comes into a store, whatever stream brings it.

Each batch of a stream claims a range of numbers in the store's ledger; a batch that is repeated
gets the range it had. Within the range a line's number comes from its place in the source, so it
doesn't depend on how the batch was cut into tasks. Streams of one driver share a ledger; its
newest readable state holds.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()


class Ledger:
    """The numbers given out for the store at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{path}/_numbers")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(self._folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _path(self, number: int):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, f"{number:012d}.json")

    def _newest(self, states: list[int]) -> dict:
        for number in reversed(states):
            stream = self._fs.open(self._path(number))
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # its writer was stopped
                continue
            finally:
                stream.close()
        return {"next": 0, "streams": {}}

    def claim(self, stream: str, batch: int, count: int) -> int:
        """The first of ``count`` numbers for this batch."""
        with _LOCK:
            states = self._states()
            state = self._newest(states)
            held = state["streams"].get(stream)
            if held and held["batch"] == batch and held["count"] >= count:
                return held["base"]
            base = state["next"]
            state["streams"][stream] = {"batch": batch, "base": base, "count": count}
            state["next"] = base + count
            out = self._fs.create(self._path(states[-1] + 1 if states else 0), True)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            for old in states[:-2]:
                self._fs.delete(self._path(old), False)
            return base


def numbered(rows: DataFrame, ledger: Ledger, stream: str, batch: int, parts: Sequence[str], within: str) -> DataFrame:
    """All rows of a batch with ``seq``: its parts one after the other, each by its own numbers ``within``, gaps
    included. Rows without a part or a number in it get none."""
    spans = rows.groupBy(*parts).agg(F.min(within).alias("low"), (F.max(within) - F.min(within) + 1).alias("n"))
    held = spans.where(" and ".join(f"`{p}` is not null" for p in parts) + " and n is not null").orderBy(*parts).collect()  # a row a part of the source
    base, shifts = ledger.claim(stream, batch, sum(r.n for r in held)), []
    for r in held:
        shifts.append((*(r[p] for p in parts), base - r.low))
        base += r.n
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    before = rows.sparkSession.createDataFrame(shifts, ", ".join([*(f"`{p}` {kinds[p]}" for p in parts), "__shift long"]))
    return rows.drop("seq").join(F.broadcast(before), list(parts), "left").withColumn("seq", F.col("__shift") + F.col(within)).drop("__shift")
