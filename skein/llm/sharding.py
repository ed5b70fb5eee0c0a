"""Operator 11: documents into shards by a consistent-hash ring with bounded loads.

Each shard has many points on the ring of 64-bit hashes; a document's key, its text, lies where
the text's hash does and belongs to the next point clockwise (Karger et al., 1997). A shard has
room for a bounded number of rows (Mirrokni, Thorup and Zadimoghaddam, "Consistent hashing with
bounded loads"): keys that overflow a full shard go on to the next point, and so on.

Keys are let in by the number of points they passed, fewest first, then clockwise, so the
places don't depend on how the input is cut. Keys between two neighbouring points (an arc) take
the same way; hence the counts of the arcs alone decide how many of an arc go where, and a
row's rank in the order of the ring says which of them it is. Only the counts of the arcs, as
many as the ring has points, come to the driver.

Equal texts share a place on the ring and lie together, in one shard unless that is full; a text
with a third of all rows goes on clockwise over as many shards as it takes. Rows are ranked in
ranges of (hash, doc_id, number), so not even equal rows need to lie in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import forget, fresh_path, table

POINTS = 200


class Ring:
    """The points of ``shards`` shards in clockwise order."""

    def __init__(self, shards: int, points: int = POINTS):
        if shards < 1 or points < 1:
            raise ValueError("a ring needs a shard and a point at least")
        at = [(xxhash.xxh64_intdigest(f"{s}/{i}"), s) for s in range(shards) for i in range(points)]
        at = sorted((h - (1 << 64) if h >> 63 else h, s) for h, s in at)
        self.shards = shards
        self.place = np.array([h for h, _ in at], np.int64)
        self.shard = np.array([s for _, s in at], np.int64)

    def arc(self, hashes: np.ndarray) -> np.ndarray:
        """The number of points before each hash; the last arc runs on to the first point."""
        return np.searchsorted(self.place, hashes, "left")

    def rooms(self, rows: int, slack: float = 0.0) -> np.ndarray:
        """The rows that each shard may hold: as equal as can be, or with ``slack`` that much more than the mean."""
        if slack > 0:
            return np.full(self.shards, math.ceil((1 + slack) * rows / self.shards), np.int64)
        return rows // self.shards + (np.arange(self.shards) < rows % self.shards).astype(np.int64)

    def spans(self, counts: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first rank, shard, first slot) of the runs of rows, in the order of the ring, that go to one shard;
        ``counts`` are the rows of each arc."""
        n = len(self.place)
        left, room, used = counts.astype(np.int64).copy(), rooms.astype(np.int64).copy(), np.zeros(self.shards, np.int64)
        rank = np.cumsum(counts) - counts
        runs: list[np.ndarray] = []
        for passed in range(n):
            live = np.flatnonzero(left)
            if not len(live):
                break
            to = self.shard[(live + passed) % n]
            live, to = live[room[to] > 0], to[room[to] > 0]
            order = np.argsort(to, kind="stable")
            live, to = live[order], to[order]
            total = np.cumsum(left[live])
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
            earlier = (total - left[live]) - np.repeat((total - left[live])[first], np.diff(np.r_[first, len(to)]))
            taken = np.clip(room[to] - earlier, 0, left[live])
            some = taken > 0
            live, to, earlier, taken = live[some], to[some], earlier[some], taken[some]
            runs.append(np.stack([rank[live], to, used[to] + earlier]))
            left[live] -= taken
            rank[live] += taken
            np.subtract.at(room, to, taken)
            np.add.at(used, to, taken)
        if left.any():
            raise ValueError("the shards have no room for all rows")
        found = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        return found[0], found[1], found[2]


def arc_counts(keys: DataFrame, ring: Ring) -> np.ndarray:
    """The rows of each arc; a task sends a row an arc at most."""
    arcs = len(ring.place) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(arcs, np.int64)
        for batch in batches:
            n += np.bincount(ring.arc(batch.column(0).to_numpy()), minlength=arcs)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["arc", "n"])

    counts = np.zeros(arcs, np.int64)
    for r in keys.select("hash").mapInArrow(run, "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[r.arc] = r.n
    return counts


def place(docs: DataFrame, shards: int, points: int = POINTS, slack: float = 0.0, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs`` (doc_id, text).

    Without ``slack`` the shards' counts are at most one apart; with it no shard has more than
    ceil((1 + slack) * rows / shards). Slots count a shard's rows from 0 without a gap. ``size``
    is the text's bytes in UTF-8 and 16. With ``carry`` the column ``row`` holds all columns of
    the row as a struct, whatever their names; else they are not looked at.

    A null text counts as empty. A null doc_id stays null. Repeated rows have a place each, and
    so have rows of one doc_id. Very long texts are hashed where they are read and, without
    ``carry``, never move. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ring = Ring(shards, points)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.xxhash64(text).alias("hash"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("number"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    held, ordered = fresh_path(spark, "keys"), fresh_path(spark, "ring")
    keys.write.parquet(held)
    keys = spark.read.schema(keys.schema).parquet(held)
    counts = arc_counts(keys, ring)
    order = ["hash", "doc_id", "number"]
    by_ring = keys.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "number").withColumn("at", F.monotonically_increasing_id())
    by_ring.write.parquet(ordered)
    by_ring = spark.read.schema(by_ring.schema).parquet(ordered)
    forget(spark, held)
    parts = by_ring.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()  # a row a partition
    part = np.array([r.part for r in parts], np.int64)
    base = np.cumsum([0, *(r["count"] for r in parts)])[:-1]
    first, shard, slot = ring.spans(counts, ring.rooms(int(counts.sum()), slack))
    names = [c for c in by_ring.columns if c != "at"]
    schema = by_ring.drop("at").schema.add("shard", "integer").add("slot", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("at")).to_numpy()
            rank = base[np.searchsorted(part, at >> 33)] + (at & (1 << 33) - 1)
            k = np.searchsorted(first, rank, "right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shard[k], pa.int32()), pa.array(slot[k] + rank - first[k])], [*names, "shard", "slot"])

    return by_ring.mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, shards: int, rows_per_file: int = 100_000, **how) -> None:
    """Write the rows of ``docs``, all their columns, below ``path`` in a folder a shard, in files of
    ``rows_per_file`` rows in the order of their slots. Columns named shard and slot are replaced."""
    placed = place(docs, shards, carry=True, **how)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    file = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.repartition("shard", file).sortWithinPartitions("shard", "slot").select(*own, "shard", "slot")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts are at most one apart."""
    placed = place(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
