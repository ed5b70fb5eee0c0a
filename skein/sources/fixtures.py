"""Adapters: the given tables as log lines, records and consumer offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.decode import numbered

#: So many consumer groups at most; each is one of every partition.
GROUPS = 1000
#: Searchable fields in order.
LOG_FIELDS = ("seq", "level", "timestamp_ms", "message", "index_identifier", "thread_name", "service_name", "service_version", "logger", "correlation_id", "request_id", "error_message", "stacktrace")
KAFKA_FIELDS = ("seq", "level", "timestamp_ms", "message", "index_identifier", "topic", "key", "offset", "partition", "headers", "correlation_id", "request_id", "composite_event_id")


def log_text() -> Column:
    """A log line's searchable text: its fields that aren't null."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in LOG_FIELDS]))


def kafka_text() -> Column:
    """A record's searchable text; a null field is there as the word null."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in KAFKA_FIELDS]))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with epoch milliseconds ``ms`` and the number ``k`` of its properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "user_id", "event_type", "value", "props", F.get_json_object("props", "$.k").alias("k"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with ``search_text``."""
    level = F.lit("UNKNOWN")
    for kind, name in (("error", "ERROR"), ("signup", "WARN"), ("click", "DEBUG"), ("purchase", "INFO")):
        level = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(level)
    error = F.col("event_type") == "error"
    trace = F.concat(F.lit("java.lang.IllegalStateException: failure code "), "k", F.lit("\n\tat a.B.run(B.java:7)"))
    lines = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        level.alias("level"),
        F.col("ms").alias("timestamp_ms"),
        F.concat_ws(" ", F.lit("user"), "user_id", "event_type", F.lit("value"), F.col("value").cast("string")).alias("message"),
        F.concat(F.lit("pod-"), F.col("user_id") % 5).alias("index_identifier"),
        F.concat(F.lit("worker-"), F.col("event_id") % 4).alias("thread_name"),
        F.concat(F.lit("svc-"), "event_type").alias("service_name"),
        F.lit("1.0").alias("service_version"),
        F.lit("app.events").alias("logger"),
        F.col("k").alias("correlation_id"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("req-"), "event_id")).alias("request_id"),
        F.when(error, F.concat(F.lit("failure code "), "k")).alias("error_message"),
        F.when(error & (F.col("event_id") % 2 == 0), trace).alias("stacktrace"),
    )
    return lines.withColumn("search_text", log_text())


def _with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the partition and the offset of their records."""
    e = events(spark, sf_dir).withColumn("partition", (F.col("user_id") % 4).cast("int"))
    return numbered(e, F.col("event_id"), keys=["event_type", "partition"], name="offset")


def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of Spark's Kafka source, headers included, with ``seq``."""
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
    request = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("rq-"), "event_id"))
    return _with_offsets(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.col("event_type").alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("ms").alias("timestamp"),
        F.filter(F.array(header("X-Correlation-Id", F.col("k")), F.when(request.isNotNull(), header("X-Request-Id", request))), lambda h: h.isNotNull()).alias("headers"),
    )


def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, timestamp_ms, index_identifier, level, topic, partition) of the records, for what needs no offset."""
    partition = (F.col("user_id") % 4).cast("int").alias("partition")
    e = events(spark, sf_dir).select("event_id", "ms", "event_type", partition)
    return e.select(F.col("event_id").alias("seq"), F.col("ms").alias("timestamp_ms"), F.concat_ws("#", "event_type", "partition").alias("index_identifier"), F.lit("KAFKA").alias("level"), F.col("event_type").alias("topic"), "partition")


def kafka_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines with ``search_text``."""
    lines = _with_offsets(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.lit("KAFKA").alias("level"),
        F.col("ms").alias("timestamp_ms"),
        F.col("props").alias("message"),
        F.concat_ws("#", "event_type", "partition").alias("index_identifier"),
        F.col("event_type").alias("topic"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("key"),
        "offset",
        "partition",
        F.concat(F.lit("X-Correlation-Id : "), "k").alias("headers"),
        F.col("k").alias("correlation_id"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("rq-"), "event_id")).alias("request_id"),
        F.concat_ws("#", "event_type", "partition", "offset").alias("composite_event_id"),
    )
    return lines.withColumn("search_text", kafka_text())


def late_arrivals(lines: DataFrame) -> DataFrame:
    """``lines`` with ``arrival``: sorting by it, then by seq, is a reproducible local shuffle."""
    return lines.withColumn("arrival", F.col("seq") + (F.col("seq") * 7919) % 50)


def end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, partition, end_offset)"""
    e = events(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition")).agg(F.count("*").alias("end_offset"))


def committed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, topic, partition, current_offset): each order priority as a consumer group of every partition."""
    groups = [r.group_id for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("group_id")).distinct().limit(GROUPS + 1).collect()]
    if len(groups) > GROUPS:
        raise ValueError(f"over {GROUPS} consumer groups")
    behind = (F.ascii(F.substring("group_id", 1, 1)) * 7 + F.col("partition") * 31) % 150
    current = F.greatest(F.lit(0), F.col("end_offset") - behind).cast("long")
    every = F.explode(F.array(*map(F.lit, groups)).cast("array<string>")).alias("group_id")
    return end_offsets(spark, sf_dir).select("*", every).select("group_id", "topic", "partition", current.alias("current_offset"))


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, image, containers, created): suppliers as pods, some with side-car containers first."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    own = F.concat(F.lit("app-"), "s_suppkey")
    image = F.when(F.col("s_suppkey") % 4 == 0, F.lit("registry/plain")).otherwise(F.concat(F.lit("registry:5000/app:"), F.col("s_nationkey")))
    names = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("istio-proxy"), own)).otherwise(F.array(own, F.lit("daprd")))
    return s.select(F.concat(F.lit("pod-"), "s_suppkey").alias("name"), image.alias("image"), names.alias("containers"))
