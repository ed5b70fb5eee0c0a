"""Search: a condition on text, levels and a snapshot; newest first, in pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.levels import DEFAULT_LEVELS
from skein.functions.scalars import grams
from skein.operators import skipping, store
from skein.operators.query import Query, parse

#: Fixed value: rows of a page.
PAGE = 10_000
NEWEST = ("timestamp_ms", "seq")


def newest_first() -> list[Column]:
    """The order of answers; seq settles ties."""
    return [F.desc(c) for c in NEWEST]


def matches(lines: DataFrame, query: str | Query = "", levels: Sequence[str] | None = DEFAULT_LEVELS, as_of_seq: int | None = None, where: Column | None = None, legacy: bool = False) -> DataFrame:
    """The lines that fit. Cheap conditions, which reach the scan, come first; ``levels`` None means all of them."""
    q = parse(query) if isinstance(query, str) else query
    found = lines
    if levels is not None:
        found = found.where(F.col("level").isin(*levels))
    if as_of_seq is not None:
        found = found.where(F.col("seq") <= as_of_seq)
    found = found.where(q.to_column(legacy=legacy))
    return found if where is None else found.where(where)


def search(lines: DataFrame, query: str | Query = "", levels: Sequence[str] | None = DEFAULT_LEVELS, as_of_seq: int | None = None, where: Column | None = None, offset: int = 0, limit: int | None = PAGE, legacy: bool = False) -> DataFrame:
    """A page of the matches, newest first: each task keeps its best offset + limit rows."""
    return paged(matches(lines, query, levels, as_of_seq, where, legacy), offset, limit)


def paged(found: DataFrame, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    """A page of these lines, newest first."""
    found = found.orderBy(*newest_first())
    found = found.offset(max(0, offset)) if offset > 0 else found
    return found if limit is None else found.limit(limit)


def search_by_time(lines: DataFrame, query: str | Query = "", levels: Sequence[str] | None = DEFAULT_LEVELS, as_of_seq: int | None = None, where: Column | None = None, offset: int = 0, limit: int = PAGE, bucket_ms: int = 3_600_000) -> DataFrame:
    """The same page for very many tasks: lines are counted by time first, and only those not older than
    where the page ends are ranked, instead of the best offset + limit rows of every task."""
    found = matches(lines, query, levels, as_of_seq, where)
    bucket = F.floor(F.col("timestamp_ms") / bucket_ms)
    newer = F.sum("n").over(Window.orderBy(F.desc("bucket"))) - F.col("n")
    counts = found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # a row an hour
    oldest = counts.select("bucket", newer.alias("newer")).where(F.col("newer") < offset + limit).agg(F.min("bucket").alias("__oldest"))
    near = found.join(F.broadcast(oldest), bucket >= F.col("__oldest")).drop("__oldest").orderBy(*newest_first())  # one row
    return (near.offset(offset) if offset > 0 else near).limit(limit)


def stored_matches(spark: SparkSession, path: str, query: str | Query = "", levels: Sequence[str] | None = DEFAULT_LEVELS, as_of_seq: int | None = None, where: Column | None = None) -> DataFrame:
    """The stored lines that fit; files whose trigrams rule them out aren't opened."""
    q = parse(query) if isinstance(query, str) else query
    lines = store.read_lines(spark, path)
    every = lines.inputFiles()
    chosen = skipping.candidate_files(spark, path, lines, q)
    if len(chosen) < len(every):
        lines = store.read_lines(spark, path, skipping.readable(chosen)) if chosen else lines.where(F.lit(False))
    return matches(lines, q, levels, as_of_seq, where)


def visible(page: DataFrame, length: int) -> DataFrame:
    """The first ``length`` rows of a page, oldest first."""
    return page.orderBy(*newest_first()).limit(length).orderBy(*NEWEST)


def merged(*sources: DataFrame) -> DataFrame:
    """The rows of all sources, duplicates kept; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def gram_candidates(lines: DataFrame, query: str | Query, column: str = "grams") -> DataFrame:
    """The lines whose trigrams hold all of each positive term's. Terms of under three letters or
    digits have no whole trigram and don't narrow; no line that fits the query is lost."""
    q = parse(query) if isinstance(query, str) else query
    for term in q.must:
        wanted = grams(F.lit(term))
        whole = F.filter(wanted, lambda g: F.length(g) == 3)
        lines = lines.where(F.size(F.array_except(whole, F.col(column))) == 0)
    return lines


def with_grams(lines: DataFrame) -> DataFrame:
    return lines.withColumn("grams", grams(F.col("search_text")))


def follow_offset(offset: int, step: int) -> int:
    """A page position moved by ``step``, at least 0; at 0 the newest lines are followed."""
    return max(0, offset + step)
