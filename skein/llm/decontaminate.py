"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. Documents are cut into windows of 128 words that overlap by half, and written down
   as the benchmark's words that each holds, but for those common in the benchmark itself.
2. Vocabulary: these words, weighted by their frequency over all documents; words in
   over ``max_share`` of them go, unless a passage would have too few left.
3. A randomised SVD (Halko, Martinsson and Tropp, 2011, by subspace iteration) of the
   windows' TF-IDF matrix A: each pass sums A'(A X) over all tasks, a matrix as large as
   the vocabulary times the rank, whatever the number of documents.
4. Windows and benchmark passages are compared by the cosine of their latent vectors; a
   window must also hold ``contained`` of the passage's own latent vector. That yields the
   candidates of every passage whose latent vector stands for it: of at least ``sure_words``
   vocabulary words, which are ``sure_share`` of its words, and with ``sure_energy`` of its
   weight (see ``sure_passages``). For the others, short or made of frequent words or badly
   represented, an inverted index of each passage's rarest words finds every stretch that
   can be verified: see ``Index``. All candidates pass a filter without loss before verification.
5. Candidates are verified on their words: a passage of which ``copy`` is a common
   subsequence of a stretch of the document is a copy; from ``paraphrase`` on it is one
   if its answer is found there too: the last sentence, with the words before it if it has
   under ``ANSWER``, or the last quarter where that sentence is over half of the passage.

Benchmark passages have at most 64 words, so each lies whole in some window; longer
items are cut. Distinct passages are taken in blocks of about ``block``, so what is
collected and broadcast is bounded; documents are never shuffled.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import forget, fresh_path, table, written

PASSAGE = 64
ANSWER = 4  # the least words of an answer
WINDOW, STRIDE = 128, 64
BLOCKS = "blocks binary, words binary, last int"
REACH = PASSAGE + PASSAGE // 2  # the longest stretch that is compared with a passage
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Settings:
    rank: int = 192
    passes: int = 3
    max_passages: float = 0.05
    max_share: float = 0.005
    least_words: int = 8
    cosine: float = 0.25
    contained: float = 0.35
    copy: float = 0.8
    paraphrase: float = 0.55
    answer: float = 0.8
    block: int = 2_000  # passages
    sure_words: int = 10
    sure_share: float = 0.15
    sure_energy: float = 0.25


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case; ASCII characters but letters and digits part them."""
    return text.lower().encode().translate(_APART).split()


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence, a bit for each of a's elements (Hyyrö, 2004)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & where.get(x, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@dataclass
class Passages:
    """The benchmark's passages: what a task needs to find and to verify them."""

    items: list[int | None] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    answers: list[list[bytes]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Passages:
        """The passages of items (id, text)."""
        return cls.from_rows((item, b" ".join(words), n) for item, text in rows for words, n in cut(text or ""))

    @classmethod
    def from_rows(cls, rows) -> Passages:
        """From (item, words joined by spaces, number of the answer's words)."""
        out = cls()
        for item, joined, answer in rows:
            words = bytes(joined).split(b" ")
            out.items.append(item)
            out.words.append(words)
            out.answers.append(words[-answer:])
        return out


def cut(text: str) -> Iterator[tuple[list[bytes], int]]:
    """(words, number of the answer's words) of each passage of an item."""
    sentences = [s for s in map(words_of, _SENTENCE.split(text)) if s]
    words = [w for s in sentences for w in s]
    for i in range(0, len(words), PASSAGE):
        part = words[i : i + PASSAGE]
        if i and len(part) < PASSAGE // 4:
            part = words[-PASSAGE:]
        last = len(sentences[-1])
        if i + PASSAGE < len(words) or last > len(part) / 2:
            last = len(part) // 4
        yield part, min(len(part), max(ANSWER, last))


class Sparse:
    """A matrix by the places and values of what isn't zero; rows by columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int):
        key, inverse = np.unique(row.astype(np.int64) << 32 | column, return_inverse=True)
        self.row, self.column, self.rows = key >> 32, key & (1 << 32) - 1, rows
        self.value = np.bincount(inverse, value, len(key))
        self._by_column = np.argsort(self.column, kind="stable")

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with ``x``."""
        out = np.zeros((self.rows, x.shape[1]))
        there, starts = np.unique(self.row, return_index=True)
        out[there] = segment_sums(x[self.column] * self.value[:, None], starts)
        return out

    def transposed_times(self, x: np.ndarray, columns: int) -> np.ndarray:
        order, out = self._by_column, np.zeros((columns, x.shape[1]))
        there, starts = np.unique(self.column[order], return_index=True)
        out[there] = segment_sums(x[self.row[order]] * self.value[order][:, None], starts)
        return out


class Lookup:
    """text -> number of each word in a word list, -1 for others."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self._get = {w: struct.pack("<i", i) for w, i in vocabulary.items()}.get

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._get, words_of(text or ""), repeat(b"\xff\xff\xff\xff"))), "<i4")


def segment_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next, by differences of running sums."""
    running = np.cumsum(rows, axis=0, dtype=np.float64)
    if not len(starts):
        return np.zeros((0, rows.shape[1]), rows.dtype)
    sums = running[np.append(starts[1:], len(rows)) - 1]
    sums[1:] -= running[starts[1:] - 1]
    return sums.astype(rows.dtype)


def picked_sums(x: np.ndarray, pick: np.ndarray, starts: np.ndarray, part: int = 32) -> np.ndarray:
    """The sums of ``x[pick]`` over each stretch of ``pick`` from one start to the next, none of them empty. The k-th
    rows of all stretches are added at once, so no more than a row a stretch is held; long stretches are summed in parts."""
    sizes = np.diff(np.append(starts, len(pick)))
    if len(sizes) and sizes.max() > part:
        parts = -(-sizes // part)
        first = np.cumsum(parts) - parts
        inner = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * part
        return picked_sums(picked_sums(x, pick, inner, part), np.arange(len(inner)), first, part)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = starts[order], -sizes[order]
    sums = x[pick[start]]
    for k in range(1, part):
        upto = np.searchsorted(sizes, -k)  # so many have over k rows
        if not upto:
            break
        sums[:upto] += x[pick[start[:upto] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def last_window(n: int) -> int:
    """The number of the last window of a text of n words."""
    return max(0, -(-(n - WINDOW) // STRIDE))


def windows(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, which hit) for hits at these word positions of a text of n words; all lie in one or two windows."""
    last = last_window(n)
    high = np.minimum(at // STRIDE, last)
    low = at // STRIDE - 1
    two = (low >= 0) & (low < high)
    hit = np.arange(len(at))
    return np.concatenate([high, low[two]]), np.concatenate([hit, hit[two]])


class Index:
    """Candidates without loss. A stretch that holds ``share`` of a passage's n words misses m = (1 - share) n
    at most, so of its m + k rarest words it holds k; only those are indexed, whatever their frequency.
    Passages that are ``left_out`` have no entries; what is verifiable is told of all."""

    SURE, ENTRIES, PIECE = 8, 2_000_000, 24

    def __init__(self, passages: list[np.ndarray], answers: list[np.ndarray], frequency: np.ndarray, settings: Settings, left_out: np.ndarray):
        share, size = min(settings.copy, settings.paraphrase), np.array([len(x) for x in passages])
        self.words = np.full((len(passages), PASSAGE), len(frequency) + 1, np.int32)  # padded with what no text has
        for i, x in enumerate(passages):
            self.words[i, : len(x)] = x
        answer, place = np.array([len(x) for x in answers]), np.arange(PASSAGE)
        self.in_answer = (place >= (size - answer)[:, None]) & (place < size[:, None])
        self.least_words, self.copied, self.answered = settings.paraphrase * size, settings.copy * size, settings.answer * answer
        self.blocks = -(-(size + size // 2 - 1) // self.PIECE) + 1  # that a stretch to be verified can lie in
        lists: dict[int, list[tuple[int, int]]] = {}
        self.least = np.zeros(len(passages), np.int64)
        for j, words in enumerate(passages):
            held = math.ceil(share * len(words) - 1e-9)
            self.least[j] = min(held, self.SURE)
            if left_out[j]:
                continue
            rarest = sorted(words.tolist(), key=lambda w: (frequency[w], w))[: len(words) - held + int(self.least[j])]
            for w, times in Counter(rarest).items():
                lists.setdefault(w, []).append((j, times))
        self.size = np.zeros(len(frequency) + 1, np.int64)  # the last is for words of no passage
        for w, entries in lists.items():
            self.size[w] = len(entries)
        self.start = np.cumsum(self.size) - self.size
        entries = [e for w in sorted(lists) for e in lists[w]]
        self.passage, self.times = (np.array([e[i] for e in entries], np.int64) for i in (0, 1))

    def verifiable(self, line: np.ndarray, start: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Whether a stretch in the 2 x REACH words from each start on can be verified as the passage. Some row of
        PIECEs that it can lie in must hold enough of the passage's words and of its answer's, and what the
        passage has in common with all these words, in order, is long enough: bit by bit (Hyyrö, 2004), for all at once."""
        out, pieces = np.zeros(len(start), bool), 2 * REACH // self.PIECE
        for k in range(0, len(start), 100):
            p = passage[k : k + 100]
            same = line[start[k : k + 100, None] + np.arange(2 * REACH)][:, :, None] == self.words[p][:, None, :]
            there = same.reshape(len(p), pieces, self.PIECE, PASSAGE).any(2)
            upto = np.concatenate([np.zeros((len(p), 1, PASSAGE), np.int8), np.cumsum(there, axis=1, dtype=np.int8)], axis=1)
            end = np.minimum(np.arange(pieces) + self.blocks[p][:, None], pieces)
            inside = np.take_along_axis(upto, end[:, :, None], 1) > upto[:, :-1]
            held, answered = inside.sum(2), (inside & self.in_answer[p][:, None, :]).sum(2)
            enough = (held >= self.copied[p][:, None]) | (answered >= self.answered[p][:, None])
            left = np.flatnonzero(((held >= self.least_words[p][:, None]) & enough).any(1))
            where = np.packbits(same[left], axis=2, bitorder="little").view("<u8")[:, :, 0]
            row = np.full(len(left), 2**64 - 1, np.uint64)
            with np.errstate(over="ignore"):
                for t in np.ascontiguousarray(where.T):
                    u = row & t
                    row = row + u | row - u
            out[k + left] = PASSAGE - np.bitwise_count(row) >= self.least_words[p[left]]
        return out

    def candidates(self, line: np.ndarray) -> Iterator[tuple[int, int]]:
        """(cell, passage): the passages that may be in the 2 x REACH words from cell x REACH on; any REACH words lie
        whole in such a stretch. The line ends with 2 x REACH words of no passage."""
        found = line[: len(line) - 2 * REACH]
        at = np.flatnonzero(self.size[found] > 0)
        if not len(at):
            return
        cell = at // REACH
        cells = np.concatenate([cell, np.maximum(cell - 1, 0)])
        key = np.unique(cells * len(self.size) + np.tile(found[at], 2))
        cells, word = key // len(self.size), key % len(self.size)
        size = self.size[word]
        upto = np.cumsum(size)
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        # parts of whole cells, bounded in entries and in counters
        part = upto[np.append(first[1:], len(cells)) - 1] // self.ENTRIES * len(found) + cells[first] // max(1, self.ENTRIES // len(self.least))
        cuts = first[np.flatnonzero(np.diff(part, prepend=-1))]
        for a, b in zip(cuts, np.append(cuts[1:], len(cells))):
            n, base = size[a:b], cells[a]
            entry = np.repeat(self.start[word[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            counts = np.bincount(np.repeat(cells[a:b] - base, n) * len(self.least) + self.passage[entry], self.times[entry])
            there = np.flatnonzero(counts)
            there = there[counts[there] >= self.least[there % len(self.least)]]
            cell, passage = there // len(self.least) + base, there % len(self.least)
            good = self.verifiable(line, cell * REACH, passage)
            yield from zip(cell[good].tolist(), passage[good].tolist())


def block_words(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(blocks, words, last): of each text with vocabulary words, their numbers and the STRIDE words that each lies in,
    as 32-bit numbers in order, and the text's last window; a window is the block of its number and the next."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found = lookup(text)
                at = np.flatnonzero(found >= 0)
                if len(at):
                    rows.append(((at // STRIDE).astype("<i4").tobytes(), found[at].tobytes(), last_window(len(found))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int32()))], ["blocks", "words", "last"])

    return docs.select("text").mapInArrow(run, BLOCKS)


def document_frequency(passages: DataFrame, size: int) -> np.ndarray:
    """The number of rows of block_words that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n[np.unique(np.frombuffer(x, "<i4"))] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["word", "n"])

    out = np.zeros(size, np.int64)
    for r in passages.select("words").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n  # a row a vocabulary word
    return out


def kept_words(passages: DataFrame, renumber: np.ndarray) -> DataFrame:
    """Rows of block_words under new numbers; words with the number -1 are left out, and rows without any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, word, last in zip(*(c.to_pylist() for c in batch.columns)):
                new = renumber[np.frombuffer(word, "<i4")]
                stays = new >= 0
                if stays.any():
                    rows.append((np.frombuffer(block, "<i4")[stays].tobytes(), new[stays].astype("<i4").tobytes(), last))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int32()))], ["blocks", "words", "last"])

    return passages.mapInArrow(run, BLOCKS)


STEP = 4_000  # blocks whose sums are held at once


def gram_sums(texts: Iterator[tuple[bytes, bytes, int]], x: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A x) for the windows of these rows of block_words. A window is the sum of two blocks, so a block's share
    of A'(A x) is the sum of its own and its neighbours' products, each as often as they have windows in common."""
    block, word, size, last = [], [], [], []
    for b, w, end in texts:
        block.append(np.frombuffer(b, "<i4"))
        word.append(np.frombuffer(w, "<i4"))
        size.append(len(block[-1]))
        last.append(end)
    if not block:
        return
    block, word, text = np.concatenate(block), np.concatenate(word), np.repeat(np.arange(len(size)), size)
    starts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(text) != 0)) + 1])
    block, text, ends = block[starts], text[starts], np.append(starts[1:], len(word))
    own = (block <= np.array(last)[text]).astype(x.dtype) + (block > 0)  # windows of each block
    follows = (np.diff(block) == 1) & (np.diff(text) == 0)
    for k in range(0, len(starts), STEP):
        e = min(k + STEP, len(starts))
        a, z = max(0, k - 1), min(e + 1, len(starts))  # with the neighbours
        latent = picked_sums(x, word[starts[a] : ends[z - 1]], starts[a:z] - starts[a])
        both = latent * own[a:z, None]
        before = np.flatnonzero(follows[a : z - 1])
        both[before] += latent[before + 1]
        both[before + 1] += latent[before]
        found = word[starts[k] : ends[e - 1]]
        back = np.repeat(np.arange(k - a, e - a), ends[k:e] - starts[k:e])
        order = np.argsort(found, kind="stable")
        terms, first = np.unique(found[order], return_index=True)
        out[terms] += picked_sums(both, back[order], first)


def _gram(passages: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'(A X) for the weighted basis: its rows are weight x X's rows; the result is weighted once by the caller."""
    held = passages.sparkSession.sparkContext.broadcast(basis)
    size, rank = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, out = held.value.astype(np.float32), np.zeros((size, rank))
        for batch in batches:
            gram_sums(zip(*(c.to_pylist() for c in batch.columns)), x, out)
        used = np.flatnonzero(out.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([x.tobytes() for x in out[used]], pa.binary())], ["word", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[word] = sums.get(word, 0) + np.frombuffer(row)
        rows = [x.tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["word", "row"])

    schema = "word int, row binary"
    out = np.zeros((size, rank))
    for r in passages.mapInArrow(run, schema).repartition("word").mapInArrow(add, schema).collect():  # a row a vocabulary word
        out[r.word] = np.frombuffer(r.row)
    return out


def latent_basis(passages: DataFrame, weight: np.ndarray, extra: Sparse, share: float, settings: Settings) -> np.ndarray:
    """Weighted right singular vectors of the windows' TF-IDF matrix, the benchmark's own rows (``extra``, times ``share``) included."""
    size = len(weight)
    rank = min(settings.rank, size)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(size, rank)))
    small = np.eye(rank)
    for _ in range(settings.passes):
        z = weight[:, None] * _gram(passages, weight[:, None] * q) + share**2 * extra.transposed_times(extra.times(q), size)
        small = q.T @ z
        basis = q
        q, _ = np.linalg.qr(z)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return (weight[:, None] * (basis @ turn[:, ::-1])).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def sure_passages(own: Sparse, latent: np.ndarray, sizes: np.ndarray, settings: Settings) -> np.ndarray:
    """Whether each passage's latent vector stands for it. ``own`` are the passages' weighted words, ``sizes`` all their words."""
    n = len(sizes)
    words, whole = np.bincount(own.row, minlength=n), np.bincount(own.row, own.value**2, n)
    kept = (latent.astype(float) ** 2).sum(1) >= settings.sure_energy * whole
    return (words >= settings.sure_words) & (words >= settings.sure_share * sizes) & kept


def _searcher(docs: DataFrame, passages: Passages, settings: Settings):
    """A function, to be made in each task, from texts to hits: (row, item, kind, cosine, lcs, start, passage's words)."""
    spark = docs.sparkSession
    every = sorted({w for words in passages.words for w in words})
    own = Counter(w for words in passages.words for w in set(words))
    rarest = {w for words in passages.words for w in sorted(set(words), key=lambda w: (own[w], w))[: settings.least_words]}
    tried = sorted(w for w in every if own[w] <= settings.max_passages * len(passages.words) or w in rarest)
    path = fresh_path(spark, "windows")
    held_words = written(block_words(docs, {w: i for i, w in enumerate(tried)}), path=path)
    frequency, rows = document_frequency(held_words, len(tried)), docs.count()
    number = {w: i for i, w in enumerate(tried)}
    needed = {w for words in passages.words for w in sorted({w for w in words if w in number}, key=lambda w: (frequency[number[w]], w))[: settings.least_words]}
    kept = [i for i, w in enumerate(tried) if frequency[i] <= settings.max_share * rows or w in needed]
    vocabulary = {tried[i]: k for k, i in enumerate(kept)}
    renumber = np.full(len(tried), -1, np.int32)
    renumber[kept] = np.arange(len(kept))
    held_words = written(kept_words(held_words, renumber), "kept-windows")
    forget(spark, path)
    weight = np.log((1 + rows) / (1 + frequency[kept])) + 1e-3
    places = [(i, vocabulary[w]) for i, words in enumerate(passages.words) for w in words if w in vocabulary]
    row, column = (np.array(x, np.int64) for x in zip(*places)) if places else (np.zeros(0, np.int64),) * 2
    extra = Sparse(row, column, weight[column], len(passages.words))
    # the benchmark's own rows get as much weight as all windows together, or rare words would be lost
    share = np.sqrt((weight**2 * frequency[kept]).sum() / max(1e-9, (extra.value**2).sum()) + 1)
    basis = latent_basis(held_words, weight, extra, share, settings)
    sought = Sparse(row, column, np.ones(len(row)), len(passages.words)).times(basis).astype(np.float32)
    # words that weren't counted are common in the benchmark itself
    known = np.array([frequency[number[w]] if w in number else rows for w in every], np.int64)
    place = {w: i for i, w in enumerate(every)}
    numbered = lambda lists: [np.array([place[w] for w in x], np.int64) for x in lists]
    sizes = np.array([len(x) for x in passages.words], np.int64)
    index = Index(numbered(passages.words), numbered(passages.answers), known, settings, sure_passages(extra, sought, sizes, settings))
    held = spark.sparkContext.broadcast((vocabulary, basis, sought, passages, every, index))

    def verify(marks: np.ndarray, found: np.ndarray, at: int, to: int, words: np.ndarray, answer: np.ndarray) -> tuple[float, float, int]:
        """(share of the passage, share of the answer, start) of the best stretch around these words; zeros
        where it can't be a copy or a paraphrase, as too few of the passage's or the answer's words are there at all."""
        n, best = len(words), (0.0, 0)
        a, b = max(0, at - n), min(len(found), to + n)
        region, span = found[a:b], n + n // 2
        marks[words] = 1
        there = marks[region] > 0
        marks[region[there]] = 2
        held = (marks[words] == 2).sum()
        enough = held >= settings.paraphrase * n and (held >= settings.copy * n or (marks[answer] == 2).sum() >= settings.answer * len(answer))
        marks[words] = 0
        if not enough:
            return 0.0, 0.0, 0
        mine, running = words.tolist(), np.concatenate([[0], np.cumsum(there)])
        starts = np.arange(0, max(1, len(region) - span + n // 2), max(1, n // 4))
        ends = np.minimum(len(region), starts + span)
        enough = running[ends] - running[starts]
        for k in np.flatnonzero(enough >= settings.paraphrase * n).tolist():
            if enough[k] > best[0] * n:
                i, j = int(starts[k]), int(ends[k])
                best = max(best, (common_subsequence(mine, region[i:j][there[i:j]].tolist()) / n, -a - i))
        start = -best[1]
        answered = common_subsequence(answer.tolist(), found[start : start + span].tolist()) / max(1, len(answer))
        return best[0], answered, start

    def make():
        vocabulary, basis, sought, passages, every, index = held.value
        place = {w: i for i, w in enumerate(every)}
        lookup = Lookup(place)
        unit, length = _unit(sought), np.linalg.norm(sought, axis=1)
        number = np.array([vocabulary.get(w, -1) for w in every] + [-1], np.int32)
        marks = np.zeros(len(every) + 1, np.int8)  # the last is for words of no passage
        wanted = [np.array([place[w] for w in x], np.int32) for x in passages.words]
        answers = [np.array([place[w] for w in x], np.int32) for x in passages.answers]

        def search(texts: list[str | None]) -> list[tuple]:
            hits: list[tuple] = []
            pending: list[tuple] = []
            size = 0

            def close() -> None:
                nonlocal size
                if not pending:
                    return
                window = np.concatenate([p[1] for p in pending])
                owner = np.repeat(np.arange(len(pending)), [len(p[1]) for p in pending])
                word = np.concatenate([p[2] for p in pending])
                starts = np.concatenate([[0], np.flatnonzero((np.diff(window) != 0) | (np.diff(owner) != 0)) + 1])[: len(word)]
                latent = picked_sums(basis, word, starts)
                near = latent @ unit.T
                norms = np.linalg.norm(latent, axis=1)
                least = np.maximum(settings.cosine * norms[:, None], settings.contained * length)
                best: dict[tuple[int, object], tuple] = {}

                def check(own: int, j: int, at: int, to: int, cosine) -> None:
                    key = (own, passages.items[j])
                    share_so_far = best.get(key, (0,) * 5)[4]
                    if share_so_far >= 1:
                        return
                    row, found = pending[own][0], pending[own][3]
                    share, answered, start = verify(marks, found, at, to, wanted[j], answers[j])
                    kind = "copy" if share >= settings.copy else "paraphrase" if share >= settings.paraphrase and answered >= settings.answer else None
                    if kind and share > share_so_far:
                        best[key] = (row, passages.items[j], kind, cosine(start), share, start, len(wanted[j]))

                # all texts one after the other, each from a new cell on, with an empty one before the next
                cells = np.array([-(-len(p[3]) // REACH) + 1 for p in pending])
                first_cell = np.cumsum(cells) - cells
                line = np.full((int(cells.sum()) + 2) * REACH, -1, np.int32)
                for p, c in zip(pending, first_cell.tolist()):
                    line[c * REACH : c * REACH + len(p[3])] = p[3]
                i, j = np.nonzero((near >= least) & (near > 0))
                around = first_cell[owner[starts[i]]] * REACH + window[starts[i]] * STRIDE - (REACH - STRIDE)
                good = index.verifiable(line, np.maximum(around, 0), j)
                for i, j in zip(i[good].tolist(), j[good].tolist()):
                    at = int(window[starts[i]]) * STRIDE
                    check(int(owner[starts[i]]), j, at, at + WINDOW, lambda _: float(near[i, j] / norms[i]))  # noqa: B023
                place_of = {(o, w): i for i, (o, w) in enumerate(zip(owner[starts].tolist(), window[starts].tolist()))}
                for at_cell, j in index.candidates(line):
                    own = int(np.searchsorted(first_cell, at_cell, "right")) - 1
                    cell = at_cell - int(first_cell[own])

                    def cosine(start: int) -> float:
                        i = place_of.get((own, start // STRIDE), place_of.get((own, start // STRIDE - 1)))  # noqa: B023
                        return 0.0 if i is None else float(near[i, j] / max(norms[i], 1e-12))  # noqa: B023

                    check(own, j, cell * REACH, (cell + 2) * REACH, cosine)
                hits.extend(best.values())
                pending.clear()
                size = 0

            for row, text in enumerate(texts):
                found = lookup(text)
                known = number[found]
                at = np.flatnonzero(known >= 0)
                if len(at) or (index.size[found] > 0).any():
                    window, hit = windows(at, len(found))
                    order = np.argsort(window, kind="stable")
                    pending.append((row, window[order], known[at][hit[order]], found))
                    size += max(len(hit), len(found) // 4)
                if size >= 25_000:
                    close()
            close()
            return hits

        return search

    return make


HIT = "item_id long, kind string, cosine double, lcs double, start_word long, passage_words long"


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Passages]:
    """The distinct passages of the benchmark, dealt into blocks by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, b" ".join(words), n) for item, text in zip(*(c.to_pylist() for c in batch.columns)) for words, n in cut(text)]
            for i in range(0, len(rows), 10_000):
                columns = zip(zip(*rows[i : i + 10_000]), (pa.int64(), pa.binary(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["item", "words", "answer"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    held = written(items.mapInArrow(run, "item long, words binary, answer int").distinct(), "passages")
    blocks = -(-held.count() // settings.block)
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        passages = Passages.from_rows(sorted(map(tuple, part.collect()), key=str))  # bounded by the block
        if passages.words:
            yield passages


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each document row and benchmark item found in it: (doc_id, item_id, kind, cosine, lcs, start_word, passage_words).

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not
    looked at. Null and empty texts hold nothing and are found nowhere. Null ids stay
    null; repeated rows are reported each, repeated items under their id once. Very long
    texts are searched whole; of several stretches that hold an item that with the longest
    common subsequence is told, the first of equal ones that was looked at. With an empty
    benchmark, or no documents, there are no rows.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = f"doc_id long, {HIT}"
    names = [f.split()[0] for f in schema.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())

    def found(make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = make()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = [(ids[h[0]], *h[1:]) for h in search(batch.column(1).to_pylist())]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits), types)], names)

        return given.mapInArrow(run, schema)

    parts = [found(_searcher(given, p, settings)) for p in _blocks(benchmark, settings)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found.

    Null and empty texts stay, rows without doc_id are judged like others and repeated rows
    each for itself. Very long texts are searched whole. With an empty benchmark all rows stay;
    an empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def kept(left: DataFrame, make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = make()
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[h[0] for h in search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(stays))

        return left.mapInArrow(run, docs.schema)

    given = docs.select(F.col("text").cast("string"))
    for passages in _blocks(benchmark, settings):
        docs = kept(docs, _searcher(given, passages, settings))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
