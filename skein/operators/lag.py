"""Consumer lag: by partition, severity and topic, and where to start reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least lag of each severity.
SEVERITIES = (("High", 100), ("Medium", 10), ("Low", 1))


def lag_rows(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """(group_id, topic, partition, current_offset, end_offset, lag) of partitions with a known end, in order."""
    both = committed.join(ends, ["topic", "partition"])
    return both.select("group_id", "topic", "partition", "current_offset", "end_offset", (F.col("end_offset") - F.col("current_offset")).alias("lag")).orderBy("group_id", "topic", "partition")


def unmatched(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Committed partitions without a known end."""
    return committed.join(ends, ["topic", "partition"], "left_anti")


def lagging(rows: DataFrame) -> DataFrame:
    return rows.where("lag > 0")


def severity(lag: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(SEVERITIES):
        out = F.when(lag >= least, F.lit(name)).otherwise(out)
    return out


def by_severity(rows: DataFrame) -> DataFrame:
    """(severity, lag, topics, percent, tip): shares of the whole lag; the tip names three topics."""
    found = rows.where("lag > 0").groupBy(severity(F.col("lag")).alias("severity")).agg(F.sum("lag").alias("lag"), F.sort_array(F.collect_set("topic")).alias("names"))
    whole = F.sum("lag").over(Window.partitionBy(F.lit(1)))  # three rows at most
    more = F.when(F.size("names") > 3, F.lit(", ...")).otherwise(F.lit(""))
    tip = F.concat(F.array_join(F.slice("names", 1, 3), ", "), more)
    return found.select("severity", "lag", F.size("names").cast("long").alias("topics"), (F.col("lag") * 100.0 / whole).alias("percent"), tip.alias("tip"))


def total_lag(rows: DataFrame, hide_zero: bool = False) -> DataFrame:
    """The whole lag; with ``hide_zero`` only what is behind counts."""
    return (lagging(rows) if hide_zero else rows).agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag"))


def by_topic(rows: DataFrame) -> DataFrame:
    """(topic, topic_lag, group_id, partition, lag, rank): a topic's partitions, the furthest behind first."""
    order = Window.partitionBy("topic").orderBy(F.desc("lag"), "group_id", "partition")
    totals = rows.groupBy("topic").agg(F.sum("lag").alias("topic_lag"))
    ranked = rows.select("topic", "group_id", "partition", "lag", F.row_number().over(order).alias("rank"))
    return ranked.join(totals, "topic").select("topic", "topic_lag", "group_id", "partition", "lag", "rank")


def column_widths(rows: DataFrame) -> DataFrame:
    """The widest text of each column, and where each column begins."""
    widths = rows.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in rows.columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("long").alias("width")) for i, c in enumerate(rows.columns)])
    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    each = widths.select(F.inline(pairs))  # a row a column
    return each.select("position", "column", "width", F.coalesce(F.sum("width").over(order), F.lit(0)).alias("begins"))


def start_offsets(partitions: DataFrame, by_time: DataFrame, ends: DataFrame) -> DataFrame:
    """(topic, partition, start_offset): by time, else the end, else 0."""
    key = ["topic", "partition"]
    both = partitions.join(by_time, key, "left").join(ends, key, "left")
    return both.select(*key, F.coalesce("time_offset", "end_offset", F.lit(0)).cast("long").alias("start_offset"))


def offsets_since(lines: DataFrame, since_ms: Column) -> DataFrame:
    """(topic, partition, time_offset): the first record at or after a time."""
    return lines.where(F.col("timestamp_ms") >= since_ms).groupBy("topic", "partition").agg(F.min("offset").alias("time_offset"))
