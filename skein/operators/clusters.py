"""Clusters of messages that differ only in their variable parts.

UUIDs, hexadecimal runs and numbers become marks; messages of as many words and the same
masked text are one cluster. Words that merely vary (in, out) aren't variable parts here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is masked, in this order.
MASKS = ((r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "<uuid>"), (r"\b0[xX][0-9a-fA-F]+\b", "<hex>"), (r"[0-9]+(\.[0-9]+)?", "<num>"))


def template(message: Column) -> Column:
    for pattern, mark in MASKS:
        message = F.regexp_replace(message, pattern, mark)
    return message


def clusters(lines: DataFrame) -> DataFrame:
    """(message_pattern, words, n, first_seq), the largest first."""
    masked = lines.select("seq", template(F.col("message")).alias("message_pattern"))
    grouped = masked.groupBy("message_pattern").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return grouped.select("message_pattern", F.size(F.split("message_pattern", " ")).alias("words"), "n", "first_seq").orderBy(F.desc("n"), "message_pattern")


def cluster_of(lines: DataFrame) -> DataFrame:
    """(seq, message, message_pattern): each line with its cluster."""
    return lines.select("seq", "message", template(F.col("message")).alias("message_pattern"))
