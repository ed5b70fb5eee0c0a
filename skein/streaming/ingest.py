"""Streams into stored lines, and what follows them."""

from __future__ import annotations

import time
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.store import BLOCK, write_lines
from skein.sources.decode import decode_records, decoded_or_kept, misplaced
from skein.sources.fixtures import kafka_text, log_text
from skein.streaming.late import stream_marked
from skein.streaming.numbers import Ledger, numbered


#: Why a line is not stored although it was understood.
LATE = "older than the newest of its block"


def start(lines: DataFrame, path: str, checkpoint: str, name: str, once: bool = False, then: Callable[[DataFrame, int], None] | None = None, grams: bool = False, every: str = "1 second") -> StreamingQuery:
    """Store a stream's lines by source and level. ``then`` is called with each batch and its number once it is
    stored: a followed search goes on there (see ``follow``). With ``once``, what is there is taken and the
    query ends; else there is a batch ``every`` so often.
    A batch is stored under its number and the stream's, so one that is repeated changes nothing.
    With ``grams``, here and below, trigrams are stored beside the lines (see ``operators.skipping``)."""

    def batch(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        write_lines(kept, path, f"{_own(rows)}-{number}", grams=grams)
        if then is not None:
            then(kept, number)
        kept.unpersist()

    return _begun(lines, checkpoint, name, once, every, batch)


def start_raw(raw: DataFrame, path: str, rejected: str, checkpoint: str, name: str, once: bool = False, block: int | None = BLOCK, then: Callable[[DataFrame, int], None] | None = None, grams: bool = False, every: str = "1 second") -> StreamingQuery:
    """Decode a stream of raw pod lines (value, index_identifier, part, line; see ``sources.tail``) and store them.
    They are numbered by the store's ledger in the order of part and line. A line that can't be decoded, and one
    older than the newest of its source's and level's block (of ``block`` lines; with None none is late), is stored
    alone, with the reason, below ``rejected``. ``then`` is called with the stored lines of each batch and its number."""
    lines = decoded_or_kept(raw.select("index_identifier", "value", "part", "line"))
    return _kept(lines, log_text(), path, rejected, checkpoint, name, once, block, then, grams, every, "value", ["part"], "line")


def start_records(
    records: DataFrame, path: str, checkpoint: str, name: str, once: bool = False, avro_text: Column | None = None, rejected: str | None = None, block: int | None = BLOCK,
    then: Callable[[DataFrame, int], None] | None = None, grams: bool = False, every: str = "1 second",
) -> StreamingQuery:
    """Decode a stream of rows like the Kafka source's and store them, numbered and late lines dropped as in
    ``start_raw``; the order of a partition is its offsets'. Below ``rejected``, if that is given, a record
    without a place or a time is stored alone, as JSON with the reason, and so is the text of a late one."""
    rows = records.drop("seq")
    whole = F.to_json(F.struct(*(F.col(c) for c in rows.columns)))
    lines = decode_records(rows.select("*", misplaced().alias("reason"), F.when(misplaced().isNotNull(), whole).alias("record")), avro_text, keep=("reason", "record"))
    return _kept(lines, kafka_text(), path, rejected, checkpoint, name, once, block, then, grams, every, "record", ["topic", "partition"], "offset")


def _kept(
    lines: DataFrame, search_text: Column, path: str, rejected: str | None, checkpoint: str, name: str, once: bool, block: int | None, then: Callable[[DataFrame, int], None] | None, grams: bool, every: str, raw: str, parts: list[str], within: str
) -> StreamingQuery:
    """Store a stream of lines, numbered by ``parts`` and the number ``within``; those with a ``reason`` and late ones aren't stored."""
    ledger = Ledger(lines.sparkSession, path)
    keyed = lines.withColumn("level", F.when(F.col("reason").isNull(), F.col("level")))
    marked = keyed.withColumn("late", F.lit(False)) if block is None else stream_marked(keyed, [*parts, within], block)

    def batch(rows: DataFrame, number: int) -> None:
        kept, own = rows.persist(), _own(rows)
        all_rows = numbered(kept, ledger, own, number, parts, within)
        gone = ("reason", "late", raw, *(("part", "line") if raw == "value" else ()))
        good = all_rows.where("reason is null and not late").drop(*gone).withColumn("search_text", search_text)
        write_lines(good, path, f"{own}-{number}", grams=grams)
        if rejected is not None:
            bad = all_rows.where("reason is not null or late").select("seq", "index_identifier", F.coalesce(raw, "message").alias("value"), F.coalesce("reason", F.lit(LATE)).alias("reason"))
            bad.write.mode("overwrite").parquet(f"{rejected}/part={own}-{number}")
        if then is not None:
            then(good, number)
        kept.unpersist()

    return _begun(marked, checkpoint, name, once, every, batch)


def _own(rows: DataFrame) -> str:
    """A name for the stream that a batch belongs to; it is the checkpoint's, whatever its path."""
    return md5(rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId").encode()).hexdigest()[:12]


def drained(query: StreamingQuery) -> None:
    """Take all that is there, in as many batches as the source cuts it into, and end."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _begun(rows: DataFrame, checkpoint: str, name: str, once: bool, every: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Sources:
    """The running streams by name: start, stop one, stop those of some names, stop all."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._running: dict[str, StreamingQuery] = {}
        self._begin: dict[str, Callable[[], StreamingQuery]] = {}

    def names(self) -> list[str]:
        return sorted(n for n, q in self._running.items() if q.isActive)

    def start(self, name: str, begin: Callable[[], StreamingQuery]) -> None:
        """Start ``name`` unless it runs; a stopped one begins again from its checkpoint."""
        if name not in self.names():
            self._begin[name] = begin
            self._running[name] = begin()

    def revive(self, wait: float = 2.0) -> list[str]:
        """Begin those again, after ``wait`` seconds, that an error has ended; returns their names."""
        failed = [n for n, q in self._running.items() if not q.isActive and q.exception() is not None]
        if failed:
            time.sleep(wait)
        for name in failed:
            self._running[name] = self._begin[name]()
        return failed

    def stop(self, *names: str) -> None:
        for name in names:
            query = self._running.pop(name, None)
            if query is not None:
                query.stop()

    def stop_all(self) -> None:
        self.stop(*list(self._running))

    def select(self, wanted: dict[str, Callable[[], StreamingQuery]]) -> None:
        """Exactly these run from now on."""
        self.stop(*(n for n in list(self._running) if n not in wanted))
        for name, begin in wanted.items():
            self.start(name, begin)
