"""Time-by-level histograms of an answer, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import clamp, day


def bounds(lines: DataFrame, bins: int) -> DataFrame:
    """One row: start, end, interval of ``bins`` equal parts (1 ms at least)."""
    span = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    ends = lines.agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))
    return ends.select("start_ms", "end_ms", F.greatest(F.lit(1), F.floor(span / max(1, bins))).cast("long").alias("interval_ms"))


def _placed(lines: DataFrame, bins: int) -> DataFrame:
    """(bin, level, start_ms, interval_ms, n) where there are lines."""
    at = F.floor((F.col("timestamp_ms") - F.col("start_ms")) / F.col("interval_ms"))
    placed = lines.select("timestamp_ms", "level").join(F.broadcast(bounds(lines, bins)), F.lit(True))  # one row
    return placed.groupBy(clamp(at, F.lit(0), F.lit(bins - 1)).cast("int").alias("bin"), "level", "start_ms", "interval_ms").agg(F.count("*").alias("n"))


def histogram(lines: DataFrame, bins: int) -> DataFrame:
    """(bin, level, n) where there are lines."""
    return _placed(lines, max(1, bins)).select("bin", "level", "n")


def dense(lines: DataFrame, bins: int) -> DataFrame:
    """(bin, time_ms, total) of every bin, empty ones included; no bins of no lines."""
    bins = max(1, bins)
    totals = _placed(lines, bins).groupBy("start_ms", "interval_ms", "bin").agg(F.sum("n").alias("n"))
    held = totals.groupBy("start_ms", "interval_ms").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))  # one row, an entry a bin
    every = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    total = F.coalesce(F.try_element_at("held", F.col("bin")), F.lit(0))
    return every.select("bin", (F.col("start_ms") + F.col("interval_ms") * F.col("bin")).alias("time_ms"), total.alias("total"))


def header(lines: DataFrame) -> DataFrame:
    """(total, seconds, per_second); a duration counts as one second at least."""
    got = lines.agg(F.count("*").alias("total"), F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"))
    seconds = F.greatest(F.lit(1), F.coalesce(F.floor((F.col("b") - F.col("a")) / 1000), F.lit(0))).cast("long")
    return got.select("total", seconds.alias("seconds"), (F.col("total") / seconds).alias("per_second"))


def highest(lines: DataFrame, bins: int) -> DataFrame:
    return histogram(lines, bins).groupBy("bin").agg(F.sum("n").alias("total")).agg(F.max("total").alias("highest"))


def shares(lines: DataFrame, bins: int) -> DataFrame:
    """(bin, level, n, percent of its bin)"""
    of_bin = F.sum("n").over(Window.partitionBy("bin"))
    return histogram(lines, bins).select("bin", "level", "n", (F.col("n") * 100.0 / of_bin).alias("percent"))


def drill_down(lines: DataFrame, bins: int, base: int = 0) -> DataFrame:
    """(bin, offset): the lines from each bin to the newest, on top of the offset that the chart began at."""
    order = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return dense(lines, bins).select("bin", (F.sum("total").over(order) + base).cast("long").alias("offset"))


def date_markers(lines: DataFrame, bins: int) -> DataFrame:
    """(bin, date) where the date differs from the bin before."""
    order = Window.orderBy("bin")
    dated = dense(lines, bins).select("bin", day(F.col("time_ms")).alias("date"))
    return dated.withColumn("before", F.lag("date").over(order)).where("before is null or before <> date").select("bin", "date")


def width_for(start_ms: int, end_ms: int, bins: int) -> int:
    """The least power of two, in milliseconds, at which bins that begin at its multiples are no more than ``bins``."""
    width = 1
    while end_ms // width - start_ms // width + 1 > max(1, bins):
        width *= 2
        if start_ms < 0 <= end_ms and width > end_ms and width >= -start_ms:
            break  # what lies on both sides of 0 takes two bins at any width
    return width


def aligned(lines: DataFrame, bins: int) -> DataFrame:
    """(time_ms, width_ms, level, n): bins of a power of two milliseconds, beginning at its multiples, as narrow as ``bins``
    of them (two at least, where times lie on both sides of 0) can be. When the range grows bins only merge in pairs, so counts can be kept up to date."""
    ends = lines.agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b")).first()
    width = 1 if ends.a is None else width_for(ends.a, ends.b, bins)
    return binned(lines.where("timestamp_ms is not null"), width)


def binned(lines: DataFrame, width: int) -> DataFrame:
    begin = F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(width).cast("long"))
    return lines.groupBy(begin.alias("time_ms"), F.lit(width).cast("long").alias("width_ms"), "level").agg(F.count("*").alias("n"))


def next_scale(highest_now: int, scale: int) -> int:
    """The chart's scale: it follows a maximum over 1.5 times, or under a third of, itself."""
    if scale <= 0 or highest_now > 1.5 * scale or highest_now < scale / 3:
        return max(1, highest_now)
    return scale
