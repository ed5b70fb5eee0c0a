"""Late lines: one older than the newest of its block is dropped.

A block holds the accepted lines of a source and level; at 4096 of them the next begins,
with nothing to compare with. The fold is the same in batch and as a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.store import BLOCK

KEYS = ("index_identifier", "level")


def fold(times: Iterable[int], newest: int, held: int, block: int) -> tuple[list[bool], int, int]:
    """(accepted, newest, held) after these times, in order of arrival."""
    out = []
    for t in times:
        if held >= block:
            newest, held = 0, 0
        ok = t >= newest
        out.append(ok)
        if ok:
            newest, held = t, held + 1
    return out, newest, held


def drop_late(lines: DataFrame, order: list[str], block: int = BLOCK, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The accepted lines. Rows of a key are read in order of arrival, one after the other; a task
    holds two numbers of the key at hand, not its rows."""
    at, ids = lines.columns.index("timestamp_ms"), [lines.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, newest, held = None, 0, 0
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in ids)))
            times = batch.column(at).to_pylist()
            keep: list[bool] = []
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if names[i] != current:
                    current, newest, held = names[i], 0, 0
                ok, newest, held = fold(times[i:j], newest, held, block)
                keep += ok
                i = j
            yield batch.filter(pa.array(keep, pa.bool_()))

    return lines.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, lines.schema)


_STATE = T.StructType([T.StructField("newest", T.LongType()), T.StructField("held", T.LongType())])
_NO_TIME = -(1 << 63)


def stream_marked(lines: DataFrame, order: list[str], block: int = BLOCK, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All lines of a stream, with ``late``: whether the line is older than the newest of its block. Newest time and
    count of each key are the stream's state. A line without a time or a key isn't late and changes nothing.

    Batches follow each other as the source gives them. Of a batch, a task holds one key's rows at a
    time, to sort them: bound batches where they are read (``max_bytes`` of a tail, ``max_records`` of a
    record source, ``maxFilesPerTrigger`` and the like elsewhere)."""
    exact = {"timestamp_ms", *order}
    kinds = {f.name: f.dataType for f in lines.schema}
    text = lambda c: F.col(c) if c in exact or kinds[c] == T.StringType() else F.col(c).cast("string").alias(c)
    plain = lines.select(*map(text, lines.columns)).withColumn("timestamp_ms", F.coalesce("timestamp_ms", F.lit(_NO_TIME)))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, held = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        times = rows["timestamp_ms"].to_numpy()
        counted = (times != _NO_TIME) & all(k is not None for k in key)
        ok, newest, held = fold(times[counted].tolist(), newest, held, block)
        late = np.zeros(len(rows), bool)
        late[counted] = ~np.array(ok, bool)
        state.update((newest, held))
        yield rows.assign(late=late)

    schema = T.StructType([*plain.schema.fields, T.StructField("late", T.BooleanType())])
    marked = plain.groupBy(*keys).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
    back = lambda c: F.col(c).cast(kinds[c]).alias(c)
    return marked.withColumn("timestamp_ms", F.nullif("timestamp_ms", F.lit(_NO_TIME))).select(*map(back, lines.columns), "late")


def stream_drop_late(lines: DataFrame, order: list[str], block: int = BLOCK, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The lines of a stream that aren't late, see ``stream_marked``."""
    return stream_marked(lines, order, block, keys).where("not late").drop("late")
