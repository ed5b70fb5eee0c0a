"""Operator 1: vector bin packing of token pieces by the dot-product heuristic.

Examples go into sequences under three limits at once: tokens, segments and
loss-bearing tokens. A task works on its own rows, pool after pool; nothing is
shuffled, and a pool is bounded in rows, so memory doesn't grow with the input
or with one source's share of it.

Within a pool, an open sequence takes the item whose demand vector has the
largest dot product with the room that is left, each dimension divided by its
limit (Panigrahy et al., "Heuristics for vector bin packing"). When no item
fits and items may be cut, the best item is cut to the room. What is left of a
task's last pool is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.llm.tokens import Ids

if TYPE_CHECKING:
    from tokenizers import Tokenizer


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold, each 1 at least. A loss-bearing token is one that has a predecessor in its
    piece and, where the rows say which parts of the text bear loss, begins in one of those."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    pool: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.pool) < 1:
            raise ValueError(f"each limit is 1 at least: {self}")


def pack_pool(tokens: np.ndarray, loss: np.ndarray, limits: Limits, last: bool = True, borne: list[np.ndarray | None] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (item, start within the item, length).

    Items longer than a sequence are cut at its length first. ``borne`` gives, for each item, how many
    of its first 0, 1, ... tokens bear loss; an item without it has its loss in proportion to length,
    rounded up. With ``last`` false, the sequence that
    could not be filled is left out: its items (or what is left of them) are the
    tail that the caller carries on, as are all others not mentioned.
    """
    left_t, left_l = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    start = np.zeros(len(tokens), np.int64)
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    done: list[list[tuple[int, int, int]]] = []

    def take(i: int, n: int) -> tuple[int, int, int]:
        if borne is not None and borne[i] is not None:
            part = int(borne[i][start[i] + n] - borne[i][start[i]])
        else:
            part = int(left_l[i]) if n == left_t[i] else int(-(-left_l[i] * n // left_t[i]))
        got = (i, int(start[i]), int(n))
        start[i] += n
        left_t[i] -= n
        left_l[i] -= part
        return got, part

    while True:
        live = np.flatnonzero(left_t > 0)
        if not len(live) or (not last and left_t[live].sum() < limits.tokens):
            break
        # one sequence: first the largest item, then by dot product with the room
        room = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
        sequence: list[tuple[int, int, int]] = []
        while room[0] > 0 and room[1] > 0 and len(live):
            fits = live[(left_t[live] <= room[0]) & (left_l[live] <= room[2])]
            weight = room / cap
            if len(fits):
                score = left_t[fits] * (weight[0] / cap[0]) + weight[1] / cap[1] + left_l[fits] * (weight[2] / cap[2])
                i = int(fits[np.argmax(score)])
                n = int(left_t[i])
            else:
                score = np.minimum(left_t[live], room[0]) * (weight[0] / cap[0]) - left_l[live] * (1 - weight[2]) / cap[2]
                i = int(live[np.argmax(score)])
                n = int(min(left_t[i], room[0]))
                if borne is not None and borne[i] is not None:
                    n = min(n, int(np.searchsorted(borne[i], borne[i][start[i]] + room[2], "right")) - 1 - int(start[i]))
                elif left_l[i]:
                    n = min(n, int(room[2] * left_t[i] // left_l[i]))
                if n <= 0:
                    break
            got, part = take(i, n)
            sequence.append(got)
            room -= (n, 1, part)
            live = live[left_t[live] > 0]
        done.append(sequence)
    return done


def powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces, cut into sequences whose lengths are the binary digits of the total."""
    total = sum(n for _, _, n in sequence)
    out, pieces = [], list(sequence)
    for bit in reversed(range(total.bit_length())):
        want, got = total & (1 << bit), []
        while want:
            i, at, n = pieces.pop(0)
            if n > want:
                pieces.insert(0, (i, at + want, n - want))
                n = want
            got.append((i, at, n))
            want -= n
        if got:
            out.append(got)
    return out


def _pool_rows(items: list[tuple], limits: Limits, last: bool):
    """(rows, carried): items are (doc_id, start, ids, loss, doc_tokens, borne)."""
    tokens = np.array([len(x[2]) for x in items], np.int64)
    loss = np.array([x[3] for x in items], np.int64)
    sequences = pack_pool(tokens, loss, limits, last, [x[5] for x in items])
    used = np.zeros(len(items), np.int64)
    for sequence in sequences:
        for i, _, n in sequence:
            used[i] += n
    carried = []
    for k in np.flatnonzero(used < tokens):
        d, at, ids, lost, total, borne = items[k]
        n = int(used[k])
        left = max(0, lost - -(-lost * n // len(ids))) if borne is None else int(borne[-1] - borne[n])
        carried.append((d, at + n, ids[n:], left, total, None if borne is None else borne[n:]))
    cut = []
    for sequence in sequences:
        short = sum(n for _, _, n in sequence)
        cut += [sequence] if short == limits.tokens else powers_of_two(sequence)
    return cut, carried


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def borne_by(one: Tokenizer, text: str, parts: list) -> np.ndarray:
    """How many of the first 0, 1, ... tokens of ``text``, the end id included, begin in one of ``parts``."""
    starts = np.array([a for a, _ in one.encode(text, add_special_tokens=False).offsets] + [len(text)], np.int64)
    bears = np.zeros(len(starts), np.int64)
    for p in parts:
        if p is not None and p["start"] is not None and p["end"] is not None:
            bears |= (starts >= p["start"]) & (starts < p["end"])
    return np.concatenate([[0], np.cumsum(bears)])


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, loss: str | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    ``loss`` names a column, an array of structs (start, end) in characters: the parts of the text whose
    tokens bear loss. Where it is null, and without it, all do. Parts may overlap; one that lacks an end
    counts for nothing. A piece's first token bears none, which a cut may bring below the limit.

    A null text counts as empty and gives the end id alone. A null doc_id stays
    null; repeated rows are packed each for itself. Very long texts are cut into pieces. Other
    columns, whatever their names, are not looked at. An empty table gives no row.
    ``sequence_id`` is unique over the result: the task's number in the high 31
    bits, the sequence's number within the task in the low 32.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        ids_of = Ids(tokenizer, "byte", "<u4")
        one = Tokenizer.from_file(tokenizer) if loss is not None else None
        end = np.array([end_id], "<u4")
        context = TaskContext.get()
        sequence_id = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        pool: list[tuple] = []

        def out(ready: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ready)], names)

        def close(last: bool) -> None:
            nonlocal sequence_id, pool
            items, (sequences, pool) = pool, _pool_rows(pool, limits, last)
            for sequence in sequences:
                offset = 0
                for i, at, n in sequence:
                    d, base, ids, _, total, borne = items[i]
                    lost = n - 1 if borne is None else int(borne[at + n] - borne[at + 1])
                    rows.append((d, base + at, n, crc32(ids[at : at + n].tobytes()), total, sequence_id, offset, lost))
                    offset += n
                sequence_id += 1

        for batch in batches:
            for d, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([np.frombuffer(ids_of(text or ""), "<u4"), end])
                total, at = len(ids), 0
                borne = None if parts is None else borne_by(one, text or "", parts)
                while total - at >= limits.tokens and limits.loss_tokens >= limits.tokens - 1:
                    piece = ids[at : at + limits.tokens]
                    rows.append((d, at, limits.tokens, crc32(piece.tobytes()), total, sequence_id, 0, limits.tokens - 1 if borne is None else int(borne[at + limits.tokens] - borne[at + 1])))
                    sequence_id += 1
                    at += limits.tokens
                if at < total:
                    pool.append((d, at, ids[at:], total - at - 1 if borne is None else int(borne[-1] - borne[at]), total, None if borne is None else borne[at:]))
                if len(pool) >= limits.pool:
                    close(False)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        if pool:
            close(True)
        if rows:
            yield out(rows)

    parts = F.lit(None) if loss is None else F.col(loss)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), parts.cast("array<struct<start:long,end:long>>")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
