"""A ``key=value`` settings file: the first = parts, a later key wins, other lines don't count."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settings(lines: Iterable[str]) -> dict[str, str]:
    return dict(line.rstrip("\n").split("=", 1) for line in lines if "=" in line)


def load(path: str | Path) -> dict[str, str]:
    """The file's settings; a missing file is an error."""
    with open(path, encoding="utf-8") as f:
        return settings(f)


def settings_table(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """(key, value) of settings in a table of lines, the last in ``order`` of each key."""
    parts = lines.where(F.contains(line, F.lit("="))).select(F.split(line, "=", 2).alias("p"), F.col(order).alias("o"))
    return parts.groupBy(parts["p"][0].alias("key")).agg(F.max_by(parts["p"][1], "o").alias("value"))
