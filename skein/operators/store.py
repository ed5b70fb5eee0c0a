"""Stored lines: partitioned tables, clearing, counting, and the latest entries of a log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import skipping
from skein.plans.folders import Folders
from skein.sources.decode import numbered

#: Fixed value: lines of a block.
BLOCK = 4096
#: What Spark leaves in a folder whose files are all there.
DONE = "_SUCCESS"


def write_lines(lines: DataFrame, path: str, part: str | None = None, rows_per_file: int = 0, grams: bool = False) -> None:
    """Store lines by source and level, so that both are read only where they are asked for. Rows of one
    source and level are spread by a hash of seq, over as many tasks as the session shuffles to. A part is
    there for readers once all of it is written; one that is there isn't written again, so a repeated
    batch changes nothing. With ``grams`` the files' trigrams are stored too (see ``skipping``)."""
    spark, name = lines.sparkSession, part or "p-" + uuid.uuid4().hex
    folders = Folders(spark, path)
    if name in _replaced(folders):
        return
    if not folders.exists(f"part={name}/{DONE}"):
        spread = F.pmod(F.xxhash64("seq"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = lines.repartition("index_identifier", "level", spread).sortWithinPartitions("index_identifier", "level", "seq")
        dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("index_identifier", "level").parquet(f"{path}/part={name}")
    if grams:
        skipping.write_grams(spark, path, name)


def read_lines(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The lines of the parts that are complete, or of these files of theirs."""
    parts = [f"{path}/part={p}" for p in parts_of(spark, path)] if files is None else files
    kept = lambda: spark.read.option("basePath", path)
    found = kept().parquet(*parts) if parts else spark.read.parquet(path)
    text = {"index_identifier", "level", "part"}  # whatever they look like
    if any(f.name in text and f.dataType != T.StringType() for f in found.schema):
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in found.schema])
        found = kept().schema(schema).parquet(*parts)
    return found.drop("part")


def _done(folders: Folders) -> list[str]:
    return [p.split("/")[0].removeprefix("part=") for p in folders.match(f"part=*/{DONE}")]


def _replaced(folders: Folders) -> set[str]:
    """The parts that others, which are complete, stand for."""
    done = {f"{p}.json" for p in _done(folders)}
    return {old for name in folders.match("_merged/*.json") if name.split("/")[1] in done for old in folders.read_json(name)}


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The parts that readers see."""
    folders = Folders(spark, path)
    gone = _replaced(folders)
    return [p for p in _done(folders) if p not in gone]


def merge_parts(spark: SparkSession, path: str, parts: list[str] | None = None, rows_per_file: int = 0, grams: bool = False) -> str | None:
    """Store these parts (or all there are) as one, in fewer and larger files; its name, or None where there are no two.

    What it stands for is written down first, so readers see the old parts until the new one is complete
    and then that one alone. A batch that is repeated later is known to be in it. The old parts stay,
    for those who are reading them, until ``delete_merged``."""
    olds = [p for p in parts_of(spark, path) if parts is None or p in parts]
    if len(olds) < 2:
        return None
    name, folders = f"m-{uuid.uuid4().hex}", Folders(spark, path)
    before = [old for p in olds if folders.exists(f"_merged/{p}.json") for old in folders.read_json(f"_merged/{p}.json")]
    lines = read_lines(spark, path, [f"{path}/part={p}" for p in olds])
    folders.write_json(f"_merged/{name}.json", [*olds, *before])
    write_lines(lines, path, name, rows_per_file, grams)
    return name


def delete_merged(spark: SparkSession, path: str) -> None:
    """Delete the parts that others stand for, and their trigrams."""
    folders = Folders(spark, path)
    for old in _replaced(folders):
        folders.delete(f"part={old}")
        folders.delete(f"_grams/part={old}")


def clear_stored(spark: SparkSession, path: str, name: str) -> None:
    """Delete a source's stored lines; other sources' files stay as they are, and what comes later is stored."""
    folders = Folders(spark, path)
    own = folders.key_folder("index_identifier", name)
    for folder in folders.match("part=*"):
        folders.delete(f"{folder}/{own}")


def clear_stored_topic(spark: SparkSession, path: str, topic: str) -> None:
    """Delete the stored lines of a topic's partitions."""
    folders = Folders(spark, path)
    for folder in folders.match("part=*/index_identifier=*"):
        if folders.value_of(folder.rsplit("/", 1)[1]).startswith(f"{topic}#"):
            folders.delete(folder)


def clear_source(lines: DataFrame, name: str) -> DataFrame:
    """All lines but one source's."""
    return lines.where(F.col("index_identifier") != name)


def clear_topic(lines: DataFrame, topic: str) -> DataFrame:
    """All lines but those of a topic's partitions."""
    return lines.where(~F.startswith("index_identifier", F.lit(f"{topic}#")))


def line_counts(lines: DataFrame) -> DataFrame:
    """(index_identifier, n)"""
    return lines.groupBy("index_identifier").agg(F.count("*").alias("n"))


def block_numbers(lines: DataFrame, block: int = BLOCK, shard: int = 1 << 20) -> DataFrame:
    """(index_identifier, level, block, n, min_seq, max_seq, max_timestamp) of blocks by arrival."""
    keys = ["index_identifier", "level"]
    placed = numbered(lines.select(*keys, "seq", "timestamp_ms"), F.col("seq"), shard, keys, "__n")
    ends = (F.count("*").alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.max("timestamp_ms").alias("max_timestamp"))
    return placed.groupBy(*keys, F.floor(F.col("__n") / block).alias("block")).agg(*ends)


def late_dropped(lines: DataFrame, keys: list[str], order: list[str], shard: int = 1 << 20) -> DataFrame:
    """Lines that aren't older than any line before them of the same keys. ``order`` is that of arrival, a
    number first. Maxima combine: each range of arrivals carries that of the ranges before it, so a large
    key is worked on by range."""
    sharded = lines.withColumn("__shard", F.floor(F.col(order[0]) / shard))
    place = [*keys, "__shard"]
    earlier = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sharded.groupBy(*place).agg(F.max("timestamp_ms").alias("__max")).select(*place, F.max("__max").over(earlier).alias("__carried"))  # a row a range
    before = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = sharded.withColumn("__newest", F.max("timestamp_ms").over(before)).join(carried, place)
    newest = F.greatest("__newest", "__carried")
    return seen.where(newest.isNull() | (F.col("timestamp_ms") >= newest)).select(*lines.columns)


def point(lines: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """The one record at this place."""
    return lines.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))


def latest(log: DataFrame) -> DataFrame:
    """(key, value) of each key's latest entry in (key, value, deleted, version), removed keys left out."""
    best = log.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("last"))
    return best.where("not last.deleted").select("key", "last.value")
