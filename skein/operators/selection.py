"""Lists to choose from: filters, carried-over choices and what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def picked(items: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Items whose text contains the filter, in any case."""
    return items.where(F.contains(F.lower(column), F.lit(text.lower())))


def carried_over(fresh: DataFrame, before: DataFrame, column: str = "name") -> DataFrame:
    """``fresh`` with ``selected``: chosen before."""
    chosen = before.select(F.col(column).alias("__chosen")).distinct()
    return fresh.join(chosen, F.col(column) == F.col("__chosen"), "left").withColumn("selected", F.col("__chosen").isNotNull()).drop("__chosen")


def changes(old: DataFrame, new: DataFrame, column: str = "name") -> DataFrame:
    """(column, action): what to stop and what to start."""
    stop = old.join(new, column, "left_anti").select(column, F.lit("stop").alias("action"))
    return stop.unionByName(new.join(old, column, "left_anti").select(column, F.lit("start").alias("action")))


def of_topics(partitions: DataFrame, topics: list[str]) -> DataFrame:
    """The partitions of these topics."""
    return partitions.where(F.col("topic").isin(*topics)) if topics else partitions.where("false")


def without(assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """Assigned partitions less those of these topics."""
    return assigned.join(topics, "topic", "left_anti")


def toggled_all(items: DataFrame, text: str, column: str = "name") -> DataFrame:
    """All items the filter shows are switched on, or off if all of them are on."""
    shown = F.contains(F.lower(column), F.lit(text.lower()))
    on = items.agg(F.coalesce(F.bool_and(F.when(shown, F.col("selected"))), F.lit(False)).alias("__on"))
    return items.join(F.broadcast(on), F.lit(True)).withColumn("selected", F.when(shown, ~F.col("__on")).otherwise(F.col("selected"))).drop("__on")


def cleared(items: DataFrame) -> DataFrame:
    return items.withColumn("selected", F.lit(False))


def summary(items: DataFrame, column: str = "name", shown: int = 5) -> DataFrame:
    """(selected, total, names): the first few chosen names and how many more there are."""
    first = items.where("selected").select(column).orderBy(column).limit(shown).agg(F.array_join(F.sort_array(F.collect_list(column)), ", ").alias("first"))
    counts = items.agg(F.count_if("selected").alias("selected"), F.count("*").alias("total"))
    more = F.when(F.col("selected") > shown, F.concat(F.lit(" + "), F.col("selected") - shown, F.lit(" more"))).otherwise(F.lit(""))
    return counts.join(F.broadcast(first), F.lit(True)).select("selected", "total", F.concat("first", more).alias("names"))
