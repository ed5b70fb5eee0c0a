"""Dumps of inventories and consumer offsets: JSON, one object a line, in a folder for each group (``key=value``).

Spark's own JSON source reads them: conditions on the key decide which folders are read at all, others reach
the parser, and files are spread over tasks by size. (A Python source with ``pushFilters`` was tried: Spark 4.1
keeps the conditions of one use of its DataFrame for the next, which then lacks rows.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dump(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of the dump at ``path``, with the group's name as column ``key``, a string. Fields that a row lacks are null,
    fields that ``schema`` doesn't name are left out. A line that is no JSON is an error; empty lines are none."""
    return spark.read.schema(f"{schema}, {key} string").option("mode", "FAILFAST").json(path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, topic, partition, current_offset) of a dump of consumer groups."""
    return dump(spark, path, "group_id", "topic string, partition int, current_offset long").select("group_id", "topic", "partition", "current_offset")


def ends(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition, end_offset) of a dump of topics."""
    return dump(spark, path, "topic", "partition int, end_offset long").select("topic", "partition", "end_offset")


def pods(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, name, image, containers) of a dump of namespaces."""
    return dump(spark, path, "namespace", "name string, image string, containers array<string>").select("namespace", "name", "image", "containers")
