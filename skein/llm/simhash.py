"""Operator 2: SimHash near duplicates by covering locality-sensitive hashing.

Pagh, "CoveringLSH" (2016): give each of the 64 positions a non-zero vector m(i)
of r + 1 bits. For each non-zero vector v there is a table whose mask keeps the
positions with an odd inner product <m(i), v>. Any r positions leave a v that is
orthogonal to all of their vectors, so two fingerprints that differ in at most r
positions agree under some mask: no pair within the radius is missed.

Fingerprints are made distinct before they are dealt out, so exact copies cost
one row, however many there are. In a bucket the links are found by spreading
from a seed over what isn't reached yet, and only a star for each class leaves
the task, never the pairs. A bucket of more than ``bucket_limit`` distinct
fingerprints isn't held in a task: its members go to an exact second way, in
which each emits the points within half the radius in the positions the mask
leaves free; two members are linked if and only if they share such a point.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import table, written
from skein.llm.graph import components

BITS = 64


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as unsigned 64-bit numbers."""
    n = 1 << (radius + 1)
    vectors = [i % (n - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """The fingerprint of one text: a bit is set if over half of the shingle hashes have it."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    ends = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, block):
        spans = zip(starts[k : min(n, k + block)].tolist(), ends[k : k + block].tolist())
        hashes = b"".join([digest(joined[a:b], seed) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = [_signed(fingerprint(t or b"", words)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _spread(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(root, member) of each class of linked members, without singletons."""
    rest = members
    while len(rest):
        seed, rest = rest[0], rest[1:]
        todo = [seed]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                todo += list(reached)
                for x in reached:
                    yield seed, x


def links(distinct: DataFrame, radius: int = 4, bucket_limit: int = 20_000) -> DataFrame:
    """(a, b): stars that connect exactly the classes of ``distinct`` (fp) linked at ``radius`` or less."""
    keep = masks(radius)
    cells = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in keep])).alias("mask", "key"))
    cells = cells.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars: set[tuple[int, int]] = set()
        over: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        size, current, spilt = 0, None, False

        def out() -> pa.RecordBatch:
            rows = [(int(a), int(b), None) for a, b in stars] + [(None, int(x), m) for m, x in over]
            stars.clear()
            over.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["a", "b", "mask"])

        def close() -> None:
            nonlocal size, spilt
            if not spilt and size > 1:
                stars.update((a.view(np.int64), b.view(np.int64)) for a, b in _spread(np.concatenate(held).view(np.uint64), radius))
            held.clear()
            size, spilt = 0, False

        for batch in batches:
            fp, mask, key = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for i, j in zip(bounds, bounds[1:]):
                if i == j:
                    continue
                if current != (group := (int(mask[i]), int(key[i]))):
                    close()
                    current = group
                held.append(fp[i:j])
                size += j - i
                if spilt or size > bucket_limit:
                    over += [(current[0], x) for part in held for x in part]
                    held.clear()
                    spilt = True
                if len(over) + len(stars) > 100_000:
                    yield out()
        close()
        if stars or over:
            yield out()

    found = written(cells.mapInArrow(run, "a long, b long, mask int"), "links")
    stars = found.where("mask is null").select("a", "b")
    crowded = found.where("mask is not null")
    if crowded.isEmpty():
        return stars
    return stars.unionByName(_by_midpoints(crowded.select("mask", F.col("b").alias("fp")), keep, radius))


def _by_midpoints(crowded: DataFrame, keep: list[int], radius: int) -> DataFrame:
    """The links of buckets too large for a task, through shared points within half the radius."""
    flips = []
    for m in keep:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append([_signed(sum(1 << i for i in c)) for k in range((radius + 1) // 2 + 1) for c in combinations(free, k)])
    sets = crowded.sparkSession.createDataFrame([(k, x) for k, x in enumerate(flips)], "mask int, flips array<long>")
    points = crowded.join(F.broadcast(sets), "mask").select("mask", "fp", F.explode("flips").alias("flip"))
    points = points.select("mask", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("mask", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    return points.join(least, ["mask", "point"]).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket_limit: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id that links reach. Null and blank texts have fingerprint zero and
    link like any other. A null doc_id is never a component's id while the component
    has another; repeated rows are returned each. Very long texts are taken whole. Other
    columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    fp = written(fingerprints(docs, words), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, bucket_limit))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(classes, "root").select(F.col("fp").alias("of_fp"), "component_id")
    named = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fp.join(of_fp, fp["fp"] == of_fp["of_fp"], "left").select("doc_id", named, "component_id")


def deduplicate(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the smallest doc_id of each component.

    Rows that share a doc_id are told apart by fingerprint, and of those that share both
    one stays. Rows without doc_id can't be named and stay.
    """
    near = written(near_duplicates(docs, words, radius).where("doc_id is not null"), "near")
    goes = near.where("doc_id != component_id").select(F.col("doc_id").alias("__id")).distinct()
    several = near.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    key = docs["doc_id"].cast("long")
    if several.isEmpty():
        return docs.join(goes, key == F.col("__id"), "left_anti")
    several = written(several, "several")
    single = docs.join(goes.unionByName(several).distinct(), key == F.col("__id"), "left_anti")
    stays = near.where("doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__kept")).distinct()
    rows = docs.join(several, key == F.col("__id"), "left_semi")
    at, schema = docs.columns.index("text"), T.StructType([*rows.schema.fields, T.StructField("__fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            fps = pa.array([f"{fingerprint(t or b'', words):016x}" for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], schema.names)

    marked = rows.mapInArrow(run, schema)
    kept = marked.join(stays, (marked["doc_id"].cast("long") == stays["__id"]) & (marked["__fingerprint"] == stays["__kept"]))
    return single.unionByName(kept.dropDuplicates(["__id", "__fingerprint"]).select(*docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
