"""Raw lines and records as typed columns.

A raw line is decoded as flat ECS JSON, else as nested ECS JSON, else kept as text if
its leading timestamp is an instant; a line that is none of these is dropped, though
its number is used up. Required fields must be there and not null, and the level must
be one of ours exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.levels import LEVELS
from skein.functions.scalars import bound, iso_millis

#: The two layouts.
FLAT = (
    "`@timestamp` string, `log.level` string, `process.thread.name` string, `service.name` string, `service.version` string, "
    "`log.logger` string, `message` string, `correlation.id` string, `request.id` string, `error.message` string, `error.stack_trace` string"
)
NESTED = (
    "`@timestamp` string, log struct<level: string, logger: string>, process struct<pid: int, thread: struct<name: string>>, "
    "service struct<name: string, version: string, node: map<string, string>>, message string, correlation struct<id: string>, "
    "request struct<id: string>, ecs struct<version: string>, error struct<message: string, stack_trace: string>"
)
_FLAT_PATHS = ("@timestamp", "log.level", "message", "process.thread.name", "service.name", "service.version", "log.logger", "correlation.id", "request.id", "error.message", "error.stack_trace")
FIELDS = ("level", "timestamp_ms", "message", "thread_name", "service_name", "service_version", "logger", "correlation_id", "request_id", "error_message", "stacktrace")


def split_prefix(line: Column) -> tuple[Column, Column]:
    """(timestamp, payload): cut at the first space; without one all is the timestamp."""
    at = F.instr(line, " ")
    stamp = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
    return stamp, F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(F.lit(""))


def _record(values: dict[str, Column], required: list[Column]) -> Column:
    there = [values["level"].isin(*LEVELS), *(c.isNotNull() for c in required)]
    whole = F.struct(*[values[f].alias(f) for f in FIELDS])
    return F.when(reduce(and_, there), bound(whole, lambda x: F.when(x["timestamp_ms"].isNotNull(), x)))


def flat_ecs(payload: Column) -> Column:
    """The line's fields as a struct, null unless the payload is flat ECS JSON."""
    return bound(F.from_json(payload, FLAT), _from_flat)


def _from_flat(j: Column) -> Column:
    got = {p: j.getField(p) for p in _FLAT_PATHS}
    names = dict(zip(FIELDS, ("log.level", "@timestamp", "message", "process.thread.name", "service.name", "service.version", "log.logger", "correlation.id", "request.id", "error.message", "error.stack_trace")))
    values = {f: got[p] for f, p in names.items()}
    required = [values[f] for f in ("message", "thread_name", "service_name", "logger")]
    values["timestamp_ms"] = iso_millis(values["timestamp_ms"])
    values["service_version"] = F.coalesce(values["service_version"], F.lit(""))
    return _record(values, required)


def nested_ecs(payload: Column) -> Column:
    """The line's fields as a struct, null unless the payload is nested ECS JSON."""
    return bound(F.from_json(payload, NESTED), _from_nested)


def _from_nested(j: Column) -> Column:
    values = {
        "level": j["log"]["level"], "timestamp_ms": iso_millis(j.getField("@timestamp")), "message": j["message"],
        "thread_name": j["process"]["thread"]["name"], "service_name": j["service"]["name"], "service_version": j["service"]["version"],
        "logger": j["log"]["logger"], "correlation_id": j["correlation"]["id"], "request_id": j["request"]["id"],
        "error_message": j["error"]["message"], "stacktrace": j["error"]["stack_trace"],
    }
    return _record(values, [values[f] for f in ("message", "thread_name", "service_name", "service_version", "logger")] + [j["process"]["pid"]])


def raw_line(stamp: Column, payload: Column) -> Column:
    """A line that is no JSON of ours; null unless its timestamp is an instant."""
    none, empty = F.lit(None).cast("string"), F.lit("")
    values = dict(zip(FIELDS, (F.lit("UNKNOWN"), iso_millis(stamp), payload, empty, empty, empty, empty, none, none, none, none)))
    return F.when(values["timestamp_ms"].isNotNull(), F.struct(*[values[f].alias(f) for f in FIELDS]))


def decode_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with the decoded fields in place of the column ``line``; undecodable rows are dropped."""
    rest = [c for c in lines.columns if c != line]
    # as rows of an array the fields are computed once, whatever is read of them
    return lines.select(*rest, F.inline(F.filter(F.array(_decoded(line)), lambda x: x.isNotNull())))


def _decoded(line: str) -> Column:
    def best(stamp: Column, payload: Column) -> Column:
        json = payload.startswith("{")
        return F.coalesce(F.when(json, flat_ecs(payload)), F.when(json, nested_ecs(payload)), raw_line(stamp, payload))

    stamp, payload = split_prefix(F.col(line))
    return bound(F.struct(stamp.alias("stamp"), payload.alias("payload")), lambda x: best(x["stamp"], x["payload"]))


def decoded_or_kept(lines: DataFrame, line: str = "value") -> DataFrame:
    """All of ``lines``: with the decoded fields and no ``line``, or, where it can't be decoded, with the line, its ``reason`` and no fields."""
    rest = [c for c in lines.columns if c != line]
    tried = lines.select(*rest, line, F.explode(F.array(_decoded(line))).alias("__line"))
    bad = F.col("__line").isNull()
    return tried.select(*rest, F.when(bad, F.col(line)).alias(line), F.when(bad, _reason(line)).alias("reason"), "__line.*")


def _reason(line: str) -> Column:
    return F.when(F.coalesce(F.col(line), F.lit("")) == "", F.lit("empty line")).otherwise(F.lit("no time before the text"))


def undecodable(lines: DataFrame, line: str = "value") -> DataFrame:
    """The rows that decode_lines drops, as they are, with the ``reason``."""
    return lines.select("*", _decoded(line).isNull().alias("__bad")).where("__bad").drop("__bad").withColumn("reason", _reason(line))


def header(headers: Column, name: str) -> Column:
    """The last header of this exact name, as text."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(-1))["value"].cast("string")


def flat_headers(headers: Column) -> Column:
    """Name and value of each header, in order, as one text; a null value is the word null."""
    each = F.transform(headers, lambda h: F.concat(h["key"], F.lit(" : "), F.coalesce(h["value"].cast("string"), F.lit("null"))))
    return F.array_join(each, " | ")


def misplaced() -> Column:
    """Why a row like the Kafka source's can't be stored; null where it can."""
    nowhere = F.col("topic").isNull() | F.col("partition").isNull() | F.col("offset").isNull()
    return F.when(nowhere, F.lit("no place in a topic")).when(F.col("timestamp").isNull(), F.lit("no time"))


def decode_records(records: DataFrame, avro_text: Column | None = None, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows of the Kafka source as lines. ``avro_text`` is the decoded value where a registry can decode it; else the value is text. Columns named in ``keep`` stay."""
    value = F.col("value").cast("string")
    headers = F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>"))
    return records.select(
        *[c for c in records.columns if c in keep],
        F.lit("KAFKA").alias("level"),
        F.unix_millis("timestamp").alias("timestamp_ms"),
        (value if avro_text is None else F.coalesce(avro_text, value)).alias("message"),
        F.concat_ws("#", "topic", "partition").alias("index_identifier"),
        "topic",
        F.col("key").cast("string").alias("key"),
        "offset",
        "partition",
        flat_headers(headers).alias("headers"),
        header(headers, "X-Correlation-Id").alias("correlation_id"),
        header(headers, "X-Request-Id").alias("request_id"),
        F.concat_ws("#", "topic", "partition", "offset").alias("composite_event_id"),
    )


def numbered(lines: DataFrame, order: Column, shard: int = 1 << 20, keys: Sequence[str] = (), name: str = "seq") -> DataFrame:
    """``lines`` with their number from 0 in this order (of each key, where there are any), before anything
    is dropped: counted per range of the order first, so no task numbers more than a range."""
    sharded = lines.withColumn("__order", order).withColumn("__shard", F.floor(F.col("__order") / shard))
    place = [*keys, "__shard"]
    earlier = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__shift")
    before = sharded.groupBy(*place).count().select(*place, shift)  # a row a range
    own = F.row_number().over(Window.partitionBy(*place).orderBy("__order")) - 1
    placed = sharded.withColumn("__own", own).join(before, place)
    return placed.select(*lines.columns, (F.col("__own") + F.col("__shift")).cast("long").alias(name))
