"""Operator 10: token ids in files, under a canonical length-limited Huffman code.

The code comes from the counts of all ids, at most one row for each id of the
vocabulary, by package-merge (Larmore and Hirschberg, 1990) with at most 16 bits.
A canonical code is given by its lengths alone; they are written beside the blocks.

A file is a sequence of blocks, each independent of the others:

    bytes  content (numbers little-endian)
    4      "TKB1"
    4 x 3  documents, ids, payload bytes
    d      1 where the document has no doc_id
    8 x d  doc_id
    4 x d  ids of the document, end id included
    4 x c  bit offset in the payload of every 128th id
    p      payload, codes from the most significant bit on
    any    zero bytes, skipped

The offsets let a reader start at any 128th id. The decoder here uses them to step
through all 128-id runs of a block at once, one table look-up for 16 bits a step.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import rawfiles
from skein.llm.common import forget, fresh_path, table, written
from skein.llm.tokens import Ids

BITS = 16
RUN = 128
BLOCK_IDS = 1 << 18
BLOCKS_PER_FILE = 32
_HEAD = struct.Struct("<4sIII")


def code_lengths(counts: np.ndarray, most: int = BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit codes of {most} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    n, row = len(used), leaves
    is_leaf = [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = row[0 : len(row) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        order = np.argsort(merged, kind="stable")
        row = merged[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        a = int(flags[:take].sum())
        lengths[used[:a]] += 1
        take = 2 * (take - a)
    return lengths


class Codec:
    """Codes and decoding table of the canonical code with these lengths."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order].astype(np.int64)
        span = np.int64(1) << (BITS - size)
        left = np.cumsum(span) - span
        self.lengths = lengths.astype(np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = left >> (BITS - size)
        self.symbol = np.zeros(1 << BITS, np.uint32)
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.size = np.ones(1 << BITS, np.int64)
        self.size[: span.sum()] = np.repeat(size, span)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(bit offset of every RUNth id, payload)."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        words = int(end[-1] + 15) // 16 if len(ids) else 0
        value = self.codes[ids] << (32 - (at & 15) - size)
        word = at >> 4
        out = np.bincount(word, value >> 16, words + 1) + np.bincount(word + 1, value & 0xFFFF, words + 1)[: words + 1]
        return at[::RUN].astype("<u4"), out[:words].astype(">u2").tobytes()

    def decode(self, n: int, offsets: np.ndarray, payload: bytes) -> np.ndarray:
        words = np.frombuffer(payload + bytes(2 * RUN + 4), ">u2").astype(np.uint32)
        pairs = words[:-1] << 16 | words[1:]
        at = offsets.astype(np.int64)
        out = np.empty((len(at), RUN), np.uint32)
        last = len(pairs) - 1
        for k in range(RUN):
            window = pairs[np.minimum(at >> 4, last)] >> (16 - (at & 15)).astype(np.uint32) & 0xFFFF
            out[:, k] = self.symbol[window]
            at += self.size[window]
        return out.reshape(-1)[:n]


def write_block(codec: Codec, doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts)
    offsets, payload = codec.encode(ids)
    if len(payload) >= 1 << 29:
        raise ValueError(f"a block of {len(ids)} ids is longer than its bit offsets can tell; split the document")
    return b"".join([
        _HEAD.pack(b"TKB1", len(parts), len(ids), len(payload)),
        bytes(d is None for d in doc_ids),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(p) for p in parts], "<u4").tobytes(),
        offsets.tobytes(),
        payload,
        b"\x00",
    ])


def read_blocks(codec: Codec, content: bytes) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(doc_ids, ids of each) of every block of a file."""
    at = 0
    while at < len(content):
        if content[at] == 0:
            at += 1
            continue
        magic, docs, n, size = _HEAD.unpack_from(content, at)
        if magic != b"TKB1":
            raise ValueError(f"no block at byte {at}")
        at += _HEAD.size
        null = content[at : at + docs]
        at += docs
        doc_ids = np.frombuffer(content, "<i8", docs, at).tolist()
        at += 8 * docs
        lengths = np.frombuffer(content, "<u4", docs, at)
        at += 4 * docs
        runs = -(-n // RUN)
        offsets = np.frombuffer(content, "<u4", runs, at)
        at += 4 * runs
        ids = codec.decode(n, offsets, content[at : at + size])
        at += size
        yield [None if null[i] else d for i, d in enumerate(doc_ids)], np.split(ids, np.cumsum(lengths.astype(np.int64))[:-1])


def tokenised(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian 16-bit ids of each row's text, with the end id behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer, kind, "<u2")
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = [ids_of(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows; a task sends a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, "<u2"), minlength=1 << 16)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order (nulls first, equal ids by
    content). Ranges are cut by doc_id and the content's first bytes, so of nulls and repeated ids only
    rows that begin alike lie in one task."""
    spark = docs.sparkSession
    held = fresh_path(spark, "ids")
    tokenised(docs, tokenizer, kind, end_id).write.parquet(held)
    ids = spark.read.schema("doc_id long, ids binary").parquet(held)
    counts = np.zeros(1 << 16, np.int64)
    for r in id_counts(ids).collect():  # bounded by the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    rawfiles.write(spark.createDataFrame([(b"TKC1" + lengths.tobytes() + b"\x00",)], "unit binary").coalesce(1), "unit", f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_block(codec, doc_ids, parts)], pa.binary())], ["unit"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(d)
                parts.append(np.frombuffer(x, "<u2"))
                n += len(parts[-1])
                if n >= BLOCK_IDS:
                    yield out()
                    doc_ids, parts, n = [], [], 0
        if parts:
            yield out()

    ordered = ids.repartitionByRange("doc_id", F.substring("ids", 1, 64)).sortWithinPartitions("doc_id", "ids")
    rawfiles.write(ordered.mapInArrow(run, "unit binary"), "unit", f"{path}/blocks", BLOCKS_PER_FILE)
    forget(spark, held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, piece, doc_id, before, n_tokens, ids_crc32) of each document in the files below ``path``;
    ``before`` counts the ids before it in its file."""
    code = rawfiles.read(spark, f"{path}/code").where(F.length("content") > 0).first()
    lengths = np.frombuffer(code.content, np.uint8, 1 << 16, 4)
    names = ["part", "piece", "doc_id", "before", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for part, piece, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                before = 0
                for doc_ids, parts in read_blocks(codec, content):
                    rows = []
                    for d, ids in zip(doc_ids, parts):
                        rows.append((part, piece, d, before, len(ids), crc32(ids.astype("<u4").tobytes())))
                        before += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    files = rawfiles.read(spark, f"{path}/blocks").select(number(r"part-(\d+)-").alias("part"), number(r"-c(\d+)\.").alias("piece"), "content")
    return files.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files written for ``docs`` (doc_id, text).

    A null text counts as empty: the end id alone. Rows without doc_id come first; repeated
    ids lie side by side and are returned each. Other columns are not looked at. A text of over
    2^28 ids about is an error. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write(docs, path, tokenizer, kind, end_id)
    rows = written(read(spark, path), "token-rows")
    files = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))  # a row a partition
    of_file = files.select("part", "piece", F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("piece")), F.lit(0)).alias("shift"))
    placed = rows.join(of_file.join(of_part, "part"), ["part", "piece"])
    return placed.select("doc_id", (F.col("base") + F.col("shift") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
