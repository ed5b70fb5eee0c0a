"""Severity levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in ordinal order (also the order of stacks and legends).
LEVELS = ("INFO", "WARN", "DEBUG", "ERROR", "UNKNOWN", "KAFKA")
#: Shown unless the caller says otherwise.
DEFAULT_LEVELS = tuple(x for x in LEVELS if x != "UNKNOWN")


def level_of_name(name: Column) -> Column:
    """A level's name in any case, UNKNOWN for anything else."""
    return F.when(F.upper(name).isin(*LEVELS), F.upper(name)).otherwise(F.lit("UNKNOWN"))


def level_of_ordinal(ordinal: Column) -> Column:
    """The level with this ordinal, UNKNOWN out of range."""
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), F.when(ordinal >= 0, ordinal)), F.lit("UNKNOWN"))


def ordinal_of(level: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1).cast("int")


def toggled(levels: tuple[str, ...], level: str) -> tuple[str, ...]:
    """The selection with ``level`` switched; the last one left can't be switched off."""
    if level not in LEVELS:
        raise ValueError(f"no level {level!r}")
    rest = tuple(x for x in levels if x != level)
    if level in levels:
        return rest or levels
    return tuple(x for x in LEVELS if x in levels or x == level)
