"""Registered queries that need a place to write, and raw lines made from decoded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import millis_iso
from skein.operators.store import read_lines, write_lines
from skein.plans.scratch import forget, fresh_path
from skein.sources import fixtures
from skein.sources.decode import numbered
from skein.sources.records import record_stream, write_records
from skein.sources.tail import tail
from skein.streaming.follow import Followed
from skein.streaming.ingest import drained, start, start_raw, start_records
from skein.streaming.late import stream_drop_late


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late drop as a stream over the event table: the events as records, numbered in their order of arrival, come in
    some four bounded batches, and what isn't late goes into a table that is then read."""
    log, out, progress, checkpoint = (fresh_path(spark, n) for n in ("log", "late", "progress", "checkpoint"))
    times = fixtures.late_arrivals(fixtures.record_times(spark, sf_dir))
    placed = numbered(times, F.col("arrival") * (1 << 32) + F.col("seq"), 1 << 52, ["topic", "partition"], "offset")
    none = F.lit(None)
    records = placed.select("topic", "partition", "offset", F.timestamp_millis("timestamp_ms").alias("timestamp"), F.col("seq").cast("string").cast("binary").alias("key"), none.cast("binary").alias("value"), none.cast("array<struct<key:string,value:binary>>").alias("headers"))
    write_records(records, log)
    stream = record_stream(spark, log, progress, max_records=max(1000, times.count() // 4))
    lines = stream.select(F.col("key").cast("string").cast("long").alias("seq"), F.unix_millis("timestamp").alias("timestamp_ms"), F.concat_ws("#", "topic", "partition").alias("index_identifier"), F.lit("KAFKA").alias("level"), "offset")
    kept = stream_drop_late(lines, ["offset"], block=1 << 40)
    drained(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())
    forget(spark, log)
    return spark.read.schema(lines.schema).parquet(out).select("seq", "timestamp_ms")


def raw_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(seq, value) and what else to ``keep``: log lines as they are shipped; by seq modulo 4 flat JSON, nested JSON, text, and
    text without a time, which no decoder takes."""
    stamp = millis_iso(F.col("timestamp_ms"))
    col = F.col
    flat = F.to_json(F.struct(
        stamp.alias("@timestamp"), col("level").alias("log.level"), col("thread_name").alias("process.thread.name"), col("service_name").alias("service.name"), col("service_version").alias("service.version"),
        col("logger").alias("log.logger"), "message", col("correlation_id").alias("correlation.id"), col("request_id").alias("request.id"), col("error_message").alias("error.message"), col("stacktrace").alias("error.stack_trace"), F.lit("x").alias("extra"),
    ))
    nested = F.to_json(F.struct(
        stamp.alias("@timestamp"), F.struct("level", "logger").alias("log"), F.struct(F.lit(7).alias("pid"), F.struct(col("thread_name").alias("name")).alias("thread")).alias("process"),
        F.struct(col("service_name").alias("name"), col("service_version").alias("version"), F.create_map(F.lit("a"), F.lit("b")).alias("node")).alias("service"), "message",
        F.struct(col("correlation_id").alias("id")).alias("correlation"), F.struct(col("request_id").alias("id")).alias("request"), F.struct(col("error_message").alias("message"), col("stacktrace").alias("stack_trace")).alias("error"),
    ))
    kind = F.col("seq") % 4
    payload = F.when(kind == 0, flat).when(kind == 1, nested).otherwise(col("message"))
    prefix = F.when(kind == 3, F.lit("2024-01-01")).otherwise(F.concat(stamp, F.lit("")))
    return lines.select("seq", F.concat_ws(" ", prefix, payload).alias("value"), *keep)


def ship(lines: DataFrame, folder: str) -> None:
    """Write (index_identifier, value, arrival, seq) as log files in a folder a source, in order of arrival."""
    ordered = lines.repartitionByRange("arrival", "seq").sortWithinPartitions("index_identifier", "arrival", "seq")
    ordered.select("index_identifier", "value").write.mode("append").partitionBy("index_identifier").text(folder)


def ingest_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines, shipped in two steps, followed by a tail that is stopped between them, in some batches each; lines
    that can't be decoded and late ones stay out. What is stored then."""
    logs, out, bad, progress, checkpoint = (fresh_path(spark, n) for n in ("logs", "lines", "rejected", "progress", "checkpoint"))
    raw = raw_lines(fixtures.late_arrivals(fixtures.log_lines(spark, sf_dir)), "index_identifier", "arrival")
    n = raw.count()
    half = F.col("arrival") < n // 2
    for step in (raw.where(half), raw.where(~half)):
        ship(step, logs)
        drained(start_raw(tail(spark, logs, progress, max_bytes=max(1 << 16, 60 * n)), out, bad, checkpoint, "ingest_raw_lines", every="0 seconds"))
    forget(spark, logs)
    return read_lines(spark, out).select("index_identifier", "level", "timestamp_ms", "message")


def followed_search(spark: SparkSession, sf_dir: str, query: str, limit: int, bins: int) -> Followed:
    """A search followed over the log lines, which arrive in five batches."""
    incoming, out, state, checkpoint = (fresh_path(spark, n) for n in ("incoming", "lines", "followed", "checkpoint"))
    lines = fixtures.log_lines(spark, sf_dir)
    lines.repartition(5, "seq").write.parquet(incoming)
    followed = Followed(spark, state, query, None, limit, bins)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", "1").parquet(incoming)
    start(stream, out, checkpoint, "followed_search", once=True, then=followed.take).awaitTermination()
    forget(spark, incoming)
    return followed


def dumped(rows: DataFrame, key: str) -> str:
    """A dump of ``rows``, a folder for each value of ``key``; where it lies."""
    path = fresh_path(rows.sparkSession, "dump")
    rows.write.partitionBy(key).json(path)
    return path


def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files, added in three steps, followed from the middle of the time range on by a source that is
    stopped between them, in bounded batches; late records stay out. What is stored then."""
    log, out, progress, checkpoint = (fresh_path(spark, n) for n in ("log", "lines", "progress", "checkpoint"))
    records = fixtures.kafka_records(spark, sf_dir)
    ends = records.agg(F.max("offset").alias("offset"), F.unix_millis(F.min("timestamp")).alias("a"), F.unix_millis(F.max("timestamp")).alias("b"), F.count("*").alias("n")).first()
    third = (ends.offset + 1) // 3
    for step in range(3):
        write_records(records.where((F.col("offset") >= step * third) & (F.col("offset") < (step + 1) * third if step < 2 else F.lit(True))), log)
        stream = record_stream(spark, log, progress, since_ms=(ends.a + ends.b) // 2, max_records=max(1000, ends.n // 4))
        drained(start_records(stream, out, checkpoint, "ingest_records", every="0 seconds"))
    forget(spark, log)
    return read_lines(spark, out).select("composite_event_id", "timestamp_ms", "message")


_STORES: dict[tuple[str, str], str] = {}


def stored_lines(spark: SparkSession, sf_dir: str) -> str:
    """Where the log lines are stored, with their trigrams; they are stored once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        path = fresh_path(spark, "lines")
        write_lines(fixtures.log_lines(spark, sf_dir), path, grams=True)
        _STORES[key] = path
    return _STORES[key]
