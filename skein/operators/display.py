"""Lines as text: list rows, details, web rows, and the parts that get coloured."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.scalars import bound, html_escape, millis_iso, running


def log_row() -> Column:
    """Time, level, service, correlation, the message's first 1000 characters, error, stack trace."""
    return F.concat_ws(" ", millis_iso(F.col("timestamp_ms")), "level", "service_name", "correlation_id", F.substring("message", 1, 1000), "error_message", "stacktrace")


def kafka_row() -> Column:
    """Time, level, composite id, topic, correlation, request, message."""
    return F.concat_ws(" ", millis_iso(F.col("timestamp_ms")), "level", "composite_event_id", "topic", "correlation_id", "request_id", "message")


def web_row() -> Column:
    """[date and time] [level] message, fit for HTML."""
    stamp = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd HH:mm:ss")
    return html_escape(F.concat(F.lit("["), stamp, F.lit("] ["), "level", F.lit("] "), "message"))


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.cast("string").alias("value")) for i, (label, value) in enumerate(pairs)])
    return F.filter(each, lambda f: f["value"].isNotNull())


def log_fields(lines: DataFrame) -> DataFrame:
    """(seq, position, label, value) of a log line's details, null ones left out."""
    pairs = [
        ("Timestamp", millis_iso(F.col("timestamp_ms"))), ("Correlation ID", F.col("correlation_id")), ("Request ID", F.col("request_id")), ("Level", F.col("level")),
        ("Service", F.concat_ws(":", "service_name", "service_version")), ("Logger", F.col("logger")), ("Thread", F.col("thread_name")), ("Error Message", F.col("error_message")),
    ]
    return lines.select("seq", F.inline(_fields(pairs)))


def kafka_fields(lines: DataFrame) -> DataFrame:
    """(seq, position, label, value) of a record's details; a null key is the word null."""
    pairs = [
        ("Timestamp", millis_iso(F.col("timestamp_ms"))), ("Correlation ID", F.col("correlation_id")), ("Request ID", F.col("request_id")), ("Topic", F.col("topic")), ("Partition", F.col("partition")),
        ("Offset", F.col("offset")), ("Key", F.coalesce("key", F.lit("null"))), ("Composite Event ID", F.col("composite_event_id")), ("Headers", F.col("headers")),
    ]
    return lines.select("seq", F.inline(_fields(pairs)))


def log_body() -> Column:
    """The message, with error and stack trace in paragraphs of their own."""
    return F.concat("message", F.coalesce(F.concat(F.lit("\n\nError: "), "error_message"), F.lit("")), F.coalesce(F.concat(F.lit("\n\nStack Trace:\n"), "stacktrace"), F.lit("")))


class _Number(str):
    """A number as it was read."""


def _spread(x: object, margin: str) -> str:
    if isinstance(x, _Number):
        return x
    deeper = margin + "    "
    if isinstance(x, dict) and x:
        return "{\n" + ",\n".join(f"{deeper}{json.dumps(k, ensure_ascii=False)}: {_spread(v, deeper)}" for k, v in x.items()) + f"\n{margin}}}"
    if isinstance(x, list) and x:
        return "[\n" + ",\n".join(deeper + _spread(v, deeper) for v in x) + f"\n{margin}]"
    return json.dumps(x, ensure_ascii=False)


def pretty(text: str | None) -> str | None:
    """JSON with four spaces a level, keys in their order and numbers as written; any other text as it is."""
    try:
        return text if text is None else _spread(json.loads(text, parse_float=_Number, parse_int=_Number), "")
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    return text.map(pretty)


def content_kind(text: Column, stacktrace: Column) -> Column:
    """How a message is shown: json, trace (it has one, or comes with one) or plain."""
    return F.when(F.ltrim(text).startswith("{") | F.ltrim(text).startswith("["), F.lit("json")).when(stacktrace.isNotNull(), F.lit("trace")).otherwise(F.lit("plain"))


def trace_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, kind) of each line of a trace; kinds are frame, error, indented frame, other."""
    each = lines.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    line = F.col("line")
    kind = F.when(line.startswith("at "), F.lit("frame")).when(line.contains("Exception") | line.contains("Error"), F.lit("error"))
    return each.select(key, "line_no", "line", kind.when(line.startswith("\tat "), F.lit("indented frame")).otherwise(F.lit("other")).alias("kind"))


#: The parts of JSON text, in order of preference; a string that isn't closed runs to the end.
_PART = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"?|[{}\[\],:]|[-0-9][0-9.eE+-]*|true|false|null|[ \t\n\r]+|[\s\S]'


def json_tokens(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, token, kind) of each part of JSON text. A string is a key until a colon has
    come after the last opening bracket or comma. Each text is read within its row."""
    opens = lambda t: F.when(t.isin("{", "[", ",", ":"), t).otherwise(F.lit(""))
    last = lambda tokens: running(F.transform(tokens, opens), lambda a, x: F.when(x != "", x).otherwise(a), F.lit(""))
    pairs = bound(F.regexp_extract_all(F.col(text), F.lit(_PART), F.lit(0)), lambda t: F.zip_with(t, last(t), lambda x, y: F.struct(x.alias("token"), y.alias("last"))))
    parts = lines.select(key, F.posexplode(pairs).alias("position", "part")).select(key, "position", "part.token", "part.last")
    token = F.col("token")
    kind = F.when(token.isin(*"{}[],:"), F.lit("structure")).when(token.startswith('"'), F.when(F.col("last") == ":", F.lit("string")).otherwise(F.lit("key")))
    kind = kind.when(token.rlike("^[-0-9]"), F.lit("number")).when(token.isin("true", "false", "null"), F.lit("literal")).when(token.rlike(r"^[ \t\n\r]"), F.lit("space"))
    return parts.select(key, "position", "token", kind.otherwise(F.lit("other")).alias("kind"))
