"""Operator 12: ranked lexical search by accumulator-limited, term-at-a-time evaluation.

A document's score for an item sums, over the item's terms, an integer weight of the term (by
its document frequency) times an integer impact of its occurrences (by the document's length).

1. ``indexed`` cuts each text into terms and keeps, of those that items have, the number and the
   occurrences: a row a document, a Parquet table.
2. Document frequencies, the number of documents and of their terms are summed; a task sends a
   row for each of the items' terms at most.
3. A task inverts its rows in segments of bounded size and answers all items on each. An item's
   terms come rarest first. Each term has a bound, its weight times its greatest impact in the
   segment. As long as the bounds of the terms to come add up to the k-th best partial score (or
   the task's k-th best score so far), a term gives accumulators to documents that had none.
   Then none are created any more: a document without one can't come near (Moffat and Zobel,
   "Self-indexing inverted files for fast text retrieval"). The survivors, those that can
   still reach the k-th, are updated exactly to the last term.
4. The tasks' best k of each item are ranked, in shares of the documents first.

Items are taken in blocks bounded in rows and in bytes, the only thing that is broadcast; each
block is a pass over the documents. Documents are never shuffled, whatever their terms' skew.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import forget, fresh_path, table

ITEMS, ITEM_BYTES = 2000, 4 << 20
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 2_000_000
SHARES = 64
# In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so this cuts at all ASCII characters but letters and digits.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with A-Z in lower case."""
    return TERM.findall((text or b"").lower())


@dataclass(frozen=True)
class Items:
    """A block of items. Terms are numbered; an item is a list of (term, occurrences)."""

    ids: list[int]
    terms: list[bytes]
    wanted: list[list[tuple[int, int]]]


def blocks(items: DataFrame, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """The items in blocks of at most ``most`` rows and ``most_bytes`` bytes (or one item), an item an id: that with the least text."""
    one = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).cast("binary").alias("text"))
    ids: list[int] = []
    numbers: dict[bytes, int] = {}
    wanted: list[list[tuple[int, int]]] = []
    size = 0
    for r in one.toLocalIterator():
        text = bytes(r.text or b"")
        if ids and (len(ids) >= most or size + len(text) > most_bytes):
            yield Items(ids, list(numbers), wanted)
            ids, numbers, wanted, size = [], {}, [], 0
        ids.append(r.item_id)
        wanted.append([(numbers.setdefault(t, len(numbers)), n) for t, n in Counter(terms_of(text)).items()])
        size += len(text)
    if ids:
        yield Items(ids, list(numbers), wanted)


def indexed(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row of ``docs`` (doc_id, text) with a term: how many terms the text has,
    and of those in ``terms`` the numbers, ascending, and occurrences, as little-endian 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}.get
        for batch in batches:
            doc_ids, counts, found, times = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                ids = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                ids, tf = np.unique(ids[ids >= 0], return_counts=True)
                doc_ids.append(d)
                counts.append(len(words))
                found.append(ids.astype("<u4").tobytes())
                times.append(tf.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, all their terms, document frequency of each of the items' terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            n[0] += batch.num_rows
            n[1] += int(batch.column(0).to_numpy().sum())
            for x in batch.column(1):
                n[2 + np.frombuffer(x.as_py(), "<u4").astype(np.int64)] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["what", "n"])

    out = np.zeros(n_terms + 2, np.int64)
    for r in index.select("n", "terms").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect():  # a row a term of the block
        out[r.what] = r.n
    return int(out[0]), int(out[1]), out[2:]


class Segment:
    """Some documents' postings by term, with impacts."""

    def __init__(self, n_terms: int, terms: list[bytes], tfs: list[bytes], m: np.ndarray):
        number = np.frombuffer(b"".join(terms), "<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
        order = np.argsort(number, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])
        self.start = np.searchsorted(number[order], np.arange(n_terms + 1))
        self.best = np.zeros(n_terms, np.int64)
        used = np.flatnonzero(np.diff(self.start))
        if len(used):
            self.best[used] = np.maximum.reduceat(self.impact, self.start[used])
        self.size = len(terms)
        self.sums = np.zeros(self.size, np.int64)

    def answer(self, wanted: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that may be among the best ``k`` and have ``least`` at least. ``wanted`` are
        (term, weight times occurrences), rarest first."""
        sums = self.sums
        sums[:] = 0
        bounds = np.array([w * self.best[t] for t, w in wanted] + [0], np.int64)
        rest = np.cumsum(bounds[::-1])[::-1]
        live: np.ndarray | None = None
        for j, (t, w) in enumerate(wanted):
            if live is None and rest[j] < least:
                live = np.flatnonzero(sums)
            doc, impact = self.doc[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]]
            if live is None:
                sums[doc] += w * impact
                if self.size >= k:
                    least = max(least, int(np.partition(sums, -k)[-k]))
            else:
                live = live[sums[live] + rest[j] >= least]
                if not len(live):
                    break
                if not len(doc):
                    continue
                at = np.minimum(np.searchsorted(doc, live), len(doc) - 1)
                has = doc[at] == live
                sums[live[has]] += w * impact[at[has]]
                if len(live) >= k:
                    least = max(least, int(np.partition(sums[live], -k)[-k]))
        found = np.flatnonzero(sums) if live is None else live
        found = found[sums[found] >= max(1, least)]
        return found, sums[found].copy()


def _best(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


def answers(index: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """(item_id, doc_id, score): each task's best ``k`` of each item."""
    ordered = [sorted(((t, int(weights[t]) * n) for t, n in w if weights[t]), key=lambda x: (-int(weights[x[0]]), x[0])) for w in items.wanted]
    sent = index.sparkSession.sparkContext.broadcast((items.ids, ordered, len(items.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, vocabulary = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        held = [none] * len(ids)
        rows: list[tuple] = []
        postings = 0

        def close() -> None:
            nonlocal rows, postings
            doc_ids = np.array([r[0] or 0 for r in rows], np.int64)
            null = np.array([r[0] is None for r in rows], bool)
            m = 100 - 25 + 25 * np.array([r[1] for r in rows], np.int64) * n_docs // n_terms
            segment = Segment(vocabulary, [r[2] for r in rows], [r[3] for r in rows], m)
            for i, terms in enumerate(wanted):
                d, z, s = held[i]
                found, scores = segment.answer(terms, k, int(s[-1]) if len(s) == k else 0)
                if len(found):
                    d, z, s = np.r_[d, doc_ids[found]], np.r_[z, null[found]], np.r_[s, scores]
                    best = _best(d, z, s, k)
                    held[i] = d[best], z[best], s[best]
            rows, postings = [], 0

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(r)
                postings += len(r[2]) // 4
                if len(rows) >= segment_docs or postings >= segment_postings:
                    close()
        if rows:
            close()
        item = np.repeat(np.array(ids, np.int64), [len(h[0]) for h in held])
        d, z, s = (np.concatenate([h[i] for h in held]) if held else none[i] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(d, mask=z), pa.array(s)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, most: int = ITEMS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each of ``items`` (item_id, text) the ``k`` rows of ``docs`` (doc_id, text) with the highest scores above 0.

    Equal scores go by doc_id, rows without one last. A null or empty text has no term and counts
    nowhere; very long texts are taken whole. Repeated rows of ``docs`` are documents each. Of
    items with the same id the least text is searched, items without an id aren't. Other columns,
    whatever their names, are not looked at. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    out = fresh_path(spark, "answers")
    spark.createDataFrame([], "item_id long, doc_id long, score long").write.parquet(f"{out}/block=-1")
    for number, block in enumerate(blocks(items, most)):
        held = fresh_path(spark, "postings")
        index = indexed(docs, block.terms)
        index.write.parquet(held)
        index = spark.read.schema(index.schema).parquet(held)
        n_docs, n_terms, df = statistics(index, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        answers(index, block, weights, n_docs, n_terms, k, segment_docs).write.parquet(f"{out}/block={number}")
        forget(spark, held)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = spark.read.schema("item_id long, doc_id long, score long").parquet(out).withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT * FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT item_id, term, count(*) AS times, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
      FROM q JOIN f USING (term), s GROUP BY item_id, term, docs, df),
r AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM g JOIN p USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
