"""Trigrams of stored files: which files can hold a term at all.

Beside the lines, below ``_grams``, lies a table of (file, gram), sorted by gram and with Bloom filters, so that
looking up a term's trigrams reads the row groups that have them. A search then opens only files that have
all trigrams of all its terms. A file without an entry, such as one just written, is always opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import grams, squeezed
from skein.operators.query import Query, parse
from skein.plans.folders import Folders

#: What a task holds at most before it passes on what it has.
HELD = 1_000_000


def _of(text: str) -> set[str]:
    """The distinct trigrams of a squeezed text; one shorter gram below three characters."""
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) > 2 else {text} - {""}


def gram_counts(texts: DataFrame, text: Column) -> DataFrame:
    """(gram, n): in how many rows each trigram of the squeezed text is. A task counts its rows before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(_of(x.as_py() or ""))
                if len(counts) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    return texts.select(squeezed(text)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _within(file: str) -> str:
    """A file's path in its store."""
    return "part=" + file.split("/part=", 1)[1]


def write_grams(spark: SparkSession, path: str, part: str) -> None:
    """Store the trigrams of a part's files, unless that is done."""
    if Folders(spark, path).exists(f"_grams/part={part}/_SUCCESS") or not Folders(spark, path).match(f"part={part}/*=*/*=*/*"):
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for file, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([_within(file)] * (len(found) + 1), pa.string()), pa.array(["", *found], pa.string())], ["file", "gram"])
            held.clear()

        for batch in batches:
            for file, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(file, set()).update(_of(x or ""))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    lines = spark.read.parquet(f"{path}/part={part}").select(F.col("_metadata.file_path").alias("file"), squeezed(F.col("search_text")))
    found = lines.mapInArrow(run, "file string, gram string").repartitionByRange("gram").sortWithinPartitions("gram", "file")
    found.write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{path}/_grams/part={part}")


def _wanted(spark: SparkSession, q: Query) -> list[str]:
    """The whole trigrams of the query's terms."""
    if not q.must:
        return []
    row = spark.range(1).select(F.array_distinct(F.flatten(F.array(*(grams(F.lit(t)) for t in q.must))))).first()
    return sorted(g for g in row[0] if len(g) == 3)


def candidate_files(spark: SparkSession, path: str, lines: DataFrame, query: str | Query) -> list[str]:
    """Of the stored files that ``lines`` reads, those that can hold a line that fits. No line is lost: terms without a
    whole trigram, and files without an entry, narrow nothing."""
    every = lines.inputFiles()
    wanted = _wanted(spark, parse(query) if isinstance(query, str) else query)
    if not wanted or not Folders(spark, path).match("_grams/part=*/_SUCCESS"):
        return every
    table = spark.read.schema("file string, gram string").parquet(f"{path}/_grams")
    having = table.where(F.col("gram").isin("", *wanted)).groupBy("file").agg(F.count_distinct(F.nullif("gram", F.lit(""))).alias("n"))
    without = {r.file for r in having.where(F.col("n") < len(wanted)).select("file").collect()}  # names of files, which the driver lists anyway
    return [f for f in every if _within(f) not in without]


def readable(files: list[str]) -> list[str]:
    """Paths that Spark reads, of the URIs that it shows."""
    return [unquote(f) for f in files]
