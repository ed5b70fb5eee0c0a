"""Operator 5: language-model scores from a log-frequency Bloom filter.

Talbot and Osborne, "Smoothed Bloom filter language models" (2007): an n-gram with
quantised count q is entered q times, once for each level up to its own; its count
is read by probing level after level until one is missing.

The model is a bigram model with a Dirichlet prior. With q(n) the quantised count of
an n-gram,
    p(w|h) = (q(h w) + PRIOR p(w)) / (q(h) + PRIOR),   p(w) = (q(w) + 1) / (N + V + 1),
and the text's boundary is a token like any other. As a logarithm that is a sum of a
term of w, one of h and, only for pairs that training has, log10(1 + q(h w) / (PRIOR p(w))).

A filter of all n-grams grows with the corpus and can't be broadcast. So it holds the
words and pairs that make up 1/``share`` of the tokens each, at most ``share`` of either;
these are also the keys that could crowd a task. All other tokens are dealt out by
n-gram, to as many parts as the corpus fills; a part counts its own n-grams exactly,
quantises the counts by the filter's own steps and returns sums a row. So every n-gram
counts, however rare, and the share decides only the way that a count travels.

1. One pass counts words, and pairs that are frequent in a block of tokens: any pair
   over twice the share in all (and OFTEN a block) is found in this way.
2. One pass deals out the other tokens, and counts the frequent pairs exactly.
3. One pass scores the frequent words and pairs by probes of the broadcast filter.

A pair's tokens go to one part with the quantised count of w where w is frequent; where
it is rare they go by w, so w's own count is found there too.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table, written
from skein.llm.language_id import crc32_of_id

BOUNDARY = b"\n"  # no word has white space
PRIOR = 4.0
STEP = 1.2
BLOCK = 2_000_000  # tokens that a task takes at once
PART = 2_000_000  # tokens of a part
OFTEN = 4  # the least count in a block of a pair that is looked at as a frequent one
WORDS = 200_000  # words that are remembered from one block to the next
_NO_WORD = (1 << 24) - 1


def word_hash(word: bytes) -> int:
    """xxhash64 as a signed number; equal for two of a billion words with a chance of 3 in 100."""
    return struct.unpack("<q", xxhash.xxh64_digest(word)[::-1])[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each STEP times as many, 0 for less than 1."""
    counts = np.asarray(counts, float)
    return np.where(counts >= 1, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(STEP) + 1e-9), 0).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return np.where(level > 0, STEP ** (level - 1.0) * (1 + STEP) / 2, 0.0)


class LogBloom:
    """Quantised counts of 64-bit keys. ``floor`` is the least count worth a level, or less by under a step."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, floor: float, probes: int = 6, bits_per_entry: int = 12):
        # a power of STEP, so that a count's level has the same bounds in every filter
        self.floor, self.probes = STEP ** math.floor(math.log(floor) / math.log(STEP) + 1e-9), probes
        levels = self.level(counts)
        size = max(1024, int(levels.sum()) * bits_per_entry)
        self.mask = np.uint64((1 << (size - 1).bit_length()) - 1)
        self.most = int(levels.max(initial=0))
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for j in range(1, self.most + 1):
            for at in self._places(keys[levels >= j], j):
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def level(self, counts: np.ndarray) -> np.ndarray:
        return level(np.asarray(counts, float) / self.floor)

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            first = _mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
            second = _mix(first ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
            for i in range(self.probes):
                yield (first + np.uint64(i) * second) & self.mask

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Estimates: the middle of the level's range, 0 for keys that aren't held."""
        level = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for j in range(1, self.most + 1):
            level[alive] = j
            for at in self._places(keys[alive], j):
                hit = self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                if not hit.all():
                    # places of the remaining probes must follow, so mark instead of cutting
                    level[alive[~hit]] = -1
            level[level == -1] = j - 1
            alive = alive[level[alive] == j]
            if not len(alive):
                break
        return self.floor * middle(level)


def pair_key(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(24)) | np.asarray(b).astype(np.uint64)


def word_key(a: np.ndarray) -> np.ndarray:
    return pair_key(a, _NO_WORD)


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(h.view(np.uint64)) + w.view(np.uint64))


def word_term(quantised: np.ndarray) -> np.ndarray:
    """What a token adds to a score but for the pair that it ends: log10 of (q + 1) PRIOR / (q + PRIOR), as it is h as often as w."""
    return np.log10((quantised + 1) * PRIOR / (quantised + PRIOR))


def pair_term(quantised: np.ndarray, word: np.ndarray, size: float) -> np.ndarray:
    """log10(1 + q(h w) / (PRIOR p(w))), with q(w) in ``word``; ``size`` is N + V + 1."""
    return np.log10(1 + quantised * size / (PRIOR * (word + 1)))


class _Numbers(dict):
    """word -> its number, as four bytes; new words get the next one."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(0, np.int64)
        self._fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        self._fresh.append(word)
        value = self[word] = struct.pack("<i", len(self))
        return value

    def all_hashes(self) -> np.ndarray:
        if self._fresh:
            new = np.fromiter(map(xxhash.xxh64_intdigest, self._fresh), np.uint64, len(self._fresh))
            self.hashes = np.concatenate([self.hashes, new.view(np.int64)])
            self._fresh = []
        return self.hashes


@dataclass
class _Block:
    """Tokens of whole texts: other columns and number of tokens of each text, each token's number, and the numbers' hashes."""

    rows: list[tuple]
    sizes: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    def before(self) -> np.ndarray:
        """The number before each token; each text ends with the boundary, so the first of all begins after the last."""
        return np.concatenate([self.at[-1:], self.at[:-1]])

    def per_row(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.cumsum(self.sizes) - self.sizes)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Block]:
    """Blocks of ``most`` tokens, or whatever the text that fills one has; text, as binary, is the last column."""
    numbers = _Numbers()
    end = numbers[BOUNDARY]
    rows, sizes, parts, n = [], [], [], 0

    def block() -> _Block:
        return _Block(rows, np.array(sizes), np.frombuffer(b"".join(parts), "<i4"), numbers.all_hashes())

    for batch in batches:
        *others, texts = (c.to_pylist() for c in batch.columns)
        for row, text in zip(zip(*others), texts):
            parts.append(b"".join(map(numbers.__getitem__, (text or b"").lower().split())) + end)
            rows.append(row)
            sizes.append(len(parts[-1]) // 4)
            n += sizes[-1]
            if n >= most:
                yield block()
                rows, sizes, parts, n = [], [], [], 0
                if len(numbers) > WORDS:
                    numbers = _Numbers()
                    end = numbers[BOUNDARY]
    if rows:
        yield block()


def counted(given: DataFrame, share: int, block: int) -> DataFrame:
    """(pair, h, w, train, total) of ``given`` (train, text): all words with w 0, and of pairs those
    counts that make up 1/``share`` of a block, and are OFTEN at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block):
            n, learnt = len(b.hashes), np.repeat(np.array([r[0] for r in b.rows]), b.sizes)
            total, train = np.bincount(b.at, minlength=n), np.bincount(b.at[learnt], minlength=n)
            used = np.flatnonzero(total)
            yield _count_rows(False, b.hashes[used], np.zeros(len(used), np.int64), train[used], total[used])
            keys, times = np.unique(b.before().astype(np.int64) * n + b.at, return_counts=True)
            often = times >= max(OFTEN, len(b.at) / share)
            keys, times = keys[often], times[often]
            yield _count_rows(True, b.hashes[keys // n], b.hashes[keys % n], np.zeros_like(times), times)

    schema = "pair boolean, h long, w long, train long, total long"
    return given.mapInArrow(run, schema).groupBy("pair", "h", "w").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _count_rows(pair: bool, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), pair)), *(pa.array(c, pa.int64()) for c in columns)], ["pair", "h", "w", "train", "total"])


@dataclass
class Model:
    """What is broadcast: the frequent words by ascending hash with their counts, the keys of the
    frequent pairs, and (once these are counted) the filter."""

    hashes: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    tokens: int
    words: int
    total: int
    least: int
    bloom: LogBloom | None = None
    low: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))  # keys below the filter's floor, and their quantised counts

    @property
    def size(self) -> float:
        return float(self.tokens + self.words + 1)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the frequent words, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int32) if len(self.hashes) else np.full(len(hashes), -1, np.int32)

    def quantised(self, keys: np.ndarray) -> np.ndarray:
        """The quantised counts of words and pairs: by probes of the filter, or as listed for those
        below its floor, which are frequent outside training only."""
        out = self.bloom.count(keys)
        at = np.minimum(np.searchsorted(self.low[0], keys), len(self.low[0]) - 1)
        return np.where(self.low[0][at] == keys, self.low[1][at], out) if len(self.low[0]) else out

    def fill(self, pair_counts: np.ndarray) -> None:
        """Make the filter, of the words and, given their counts, the pairs."""
        keys = np.concatenate([word_key(np.arange(len(self.hashes))), self.pairs])
        counts = np.concatenate([self.counts, pair_counts])
        self.bloom = LogBloom(keys, counts, max(1, self.least // 2))
        low = np.flatnonzero(counts < self.bloom.floor)
        low = low[np.argsort(keys[low])]
        self.low = keys[low], middle(level(counts[low]))

    def finder(self):
        """A function from pair keys to their places among the frequent pairs, or -1; most are told apart by a bit table."""
        bits = 23
        seen = np.zeros(1 << bits, bool)
        slot = lambda keys: (_mix(keys) >> np.uint64(64 - bits)).astype(np.int64)
        seen[slot(self.pairs)] = True

        def find(keys: np.ndarray) -> np.ndarray:
            out = np.full(len(keys), -1, np.int64)
            maybe = np.flatnonzero(seen[slot(keys)])
            at = np.minimum(np.searchsorted(self.pairs, keys[maybe]), len(self.pairs) - 1)
            out[maybe] = np.where(self.pairs[at] == keys[maybe], at, -1) if len(self.pairs) else -1
            return out

        return find


def frequent(counts: DataFrame, share: int) -> Model:
    """The frequent words and pairs, each at most ``share``, and the boundary in any case."""
    words = counts.where("not pair")
    sums = words.agg(F.sum("train").alias("tokens"), F.count_if(F.col("train") > 0).alias("words"), F.sum("total").alias("total")).first()
    least = max(1, -(-int(sums.total or 0) // share))
    held = words.where((F.col("total") >= least) | (F.col("h") == word_hash(BOUNDARY))).orderBy("h").select("h", "train").toArrow()  # at most share + 1 rows
    pairs = counts.where(F.col("pair") & (F.col("total") >= least)).select("h", "w").toArrow()  # at most share rows
    model = Model(held["h"].to_numpy(), held["train"].to_numpy(), np.zeros(0, np.uint64), int(sums.tokens or 0), int(sums.words), int(sums.total or 0), least)
    model.pairs = np.sort(pair_key(*(model.places(pairs[c].to_numpy()) for c in ("h", "w"))))  # both words of a frequent pair are frequent
    return model


def _quantised_words(model: Model) -> np.ndarray:
    return level(model.counts).astype(np.uint8)


# What a packet holds. Of a block's packets one has the ids and marks of all its rows.
_DEALT = {
    "ids": "<i8", "marks": "<i8", "rows": "<u4", "train": "?", "n": "<u4", "rare_n": "<u4", "keys": "<u8", "levels": "u1", "rare": "<i8", "rare_keys": "<u4", "hot": "<u4", "hot_n": "<i8",
}
_SUMS = {"ids": "<i8", "marks": "<i8", "rows": "<u4", "known": "<u4", "logs": "<f8", "more": "<f8"}


def _packet_schema(kinds: dict[str, str], key: str) -> str:
    return f"{key}, " + ", ".join(f"{name} binary" for name in kinds)


class _Packets:
    """Packets that go out together."""

    def __init__(self, kinds: dict[str, str], *numbers: str):
        self._kinds, self._numbers, self.size = kinds, numbers, 0
        self._columns: list[list] = [[] for _ in (*numbers, *kinds)]

    def add(self, *values) -> None:
        n = len(self._numbers)
        for column, x in zip(self._columns, values[:n]):
            column.append(int(x))
        for column, x, kind in zip(self._columns[n:], values[n:], self._kinds.values()):
            column.append(np.asarray(x).astype(kind).tobytes())
            self.size += len(column[-1])

    def batch(self) -> pa.RecordBatch:
        n = len(self._numbers)
        arrays = [pa.array(c, pa.int64() if i < n else pa.binary()) for i, c in enumerate(self._columns)]
        self._columns, self.size = [[] for _ in self._columns], 0
        return pa.RecordBatch.from_arrays(arrays, [*self._numbers, *self._kinds])


def _joined(packets: list[dict], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(p[name] for p in packets), kind) for name, kind in kinds.items()}


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """(key, packets) of rows that are sorted by the key."""
    held: list[dict] = []
    for batch in batches:
        for packet in batch.to_pylist():
            if held and packet[key] != held[0][key]:
                yield held[0][key], held
                held = []
            held.append(packet)
    if held:
        yield held[0][key], held


def dealt(given: DataFrame, model: Model, parts: int, block: int) -> DataFrame:
    """The tokens of ``given`` (train, id, mark, text) that don't end a frequent pair, in packets for each
    part: rows with id, mark and numbers of tokens; pairs with the level of w; rare words with a key of h;
    and the counts in training of frequent pairs."""
    held = given.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = held.value
        find, levels = m.finder(), _quantised_words(m)
        small = np.uint16 if parts < 1 << 16 else np.int64  # sorted by digits
        number = TaskContext.get().partitionId() << 32
        out = _Packets(_DEALT, "part", "block")
        for b in _blocks(batches, block):
            place, h = m.places(b.hashes), b.before()
            first, second = place[h], place[b.at]
            both = np.flatnonzero((first >= 0) & (second >= 0))
            found = np.full(len(b.at), -1, np.int32)
            found[both] = find(pair_key(first[both], second[both]))
            train, *names = (np.array(x) for x in zip(*b.rows))
            row = np.repeat(np.arange(len(b.sizes), dtype=np.int32), b.sizes)
            hot = found[(found >= 0) & train[row]]
            cold = np.flatnonzero(found < 0)
            rare = second[cold] < 0
            keys = pair_hash(b.hashes[h[cold]], b.hashes[b.at[cold]])
            with np.errstate(over="ignore"):
                owner = np.where(rare, _mix(b.hashes[b.at[cold]].view(np.uint64)), _mix(keys + np.uint64(1)))
            part = (owner % np.uint64(parts)).astype(small)
            order = np.argsort(part, kind="stable")
            part = part[order]
            hot, hot_n = np.unique(hot, return_counts=True)
            hot_order = np.argsort(hot % parts, kind="stable")
            hot, hot_n = hot[hot_order], hot_n[hot_order]
            there = np.unique(np.concatenate([part, hot % parts])) if len(part) + len(hot) else np.zeros(1, np.int64)
            cuts, ends = (np.searchsorted(part, there, side) for side in ("left", "right"))
            hot_cuts, hot_ends = (np.searchsorted(hot % parts, there, side) for side in ("left", "right"))
            for k, p in enumerate(there.tolist()):
                mine, of_hot = order[cuts[k] : ends[k]], slice(hot_cuts[k], hot_ends[k])
                is_rare, rows, tokens = rare[mine], row[cold[mine]], b.at[cold[mine]]
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                n = np.diff(np.append(starts, len(rows)))
                rare_n = np.add.reduceat(is_rare, starts, dtype=np.int64) if len(starts) else n
                own = rows[starts]
                out.add(
                    p, number, *(names if k == 0 else (x[:0] for x in names)), own, train[own], n - rare_n, rare_n, keys[mine[~is_rare]], levels[second[cold[mine[~is_rare]]]],
                    b.hashes[tokens[is_rare]], keys[mine[is_rare]] >> np.uint64(32), hot[of_hot], hot_n[of_hot],
                )
                if out.size > 1 << 23:
                    yield out.batch()
            number += 1
        if out.size:
            yield out.batch()

    return given.mapInArrow(run, _packet_schema(_DEALT, "part long, block long"))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _run_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each element, the sum over its run."""
    return np.repeat(np.add.reduceat(x, starts), np.diff(np.append(starts, len(x)))) if len(x) else np.zeros(0)


def part_sums(packets: dict[str, np.ndarray], size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, logs, more) of each row of a part: known rare words, their log10(c + 1), and what they and the part's pairs add to the score."""
    rows = len(packets["rows"])
    train = packets["train"].astype(np.int64)
    row = np.repeat(np.arange(rows), packets["n"])
    order = np.argsort(packets["keys"])
    keys, row = packets["keys"][order], row[order]
    n = _run_sums(train[row], _starts(keys))
    term = pair_term(middle(level(n)), middle(packets["levels"][order].astype(np.int64)), size)
    more = np.bincount(row, term, rows).astype(float)  # of no rows, numpy counts in whole numbers
    row = np.repeat(np.arange(rows), packets["rare_n"])
    order = np.lexsort((packets["rare_keys"], packets["rare"]))
    words, keys, row = packets["rare"][order], packets["rare_keys"][order], row[order]
    count, n = _run_sums(train[row], _starts(words)), _run_sums(train[row], _starts(words, keys))
    word = middle(level(count))
    more += np.bincount(row, word_term(word) + pair_term(middle(level(n)), word, size), rows)
    return np.bincount(row, count > 0, rows).astype(np.int64), np.bincount(row, np.log10(count + 1), rows).astype(float), more


def gathered(packets: DataFrame, parts: int, size: float) -> DataFrame:
    """(id, mark, known, logs, more) of each row, summed over the parts; with a null mark, the place of a
    frequent pair as id and its count as known. A part counts its n-grams and answers each block with a
    packet of sums, which are added up by block. A task holds a part, of PART tokens about and with no
    n-gram of over 2/share of all tokens, or the answers to a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packets(_SUMS, "block")
        for part, held in _grouped(batches, "part"):
            got = _joined(held, _DEALT)
            hot = np.unique(got["hot"])
            n = np.bincount(np.searchsorted(hot, got["hot"]), got["hot_n"], len(hot))
            out.add(-1 - part, [], [], hot, n, [], [])
            sums = part_sums(got, size)
            ends = np.cumsum([len(p["rows"]) // 4 for p in held])
            for p, end in zip(held, ends):
                mine = slice(end - len(p["rows"]) // 4, end)
                names = (np.frombuffer(p[c], _SUMS[c]) for c in ("ids", "marks"))
                out.add(p["block"], *names, got["rows"][mine], *(x[mine] for x in sums))
                if out.size > 1 << 23:
                    yield out.batch()
        if out.size:
            yield out.batch()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _grouped(batches, "block"):
            got = _joined(held, _SUMS)
            if block < 0:
                hot = got["rows"].astype(np.int64)
                nothing = np.zeros(len(hot))
                columns = (hot, pa.nulls(len(hot), pa.int64()), got["known"].astype(np.int64), nothing, nothing)
            else:
                known, logs, more = (np.bincount(got["rows"], got[c], len(got["ids"])) for c in ("known", "logs", "more"))
                columns = (got["ids"], got["marks"], known.astype(np.int64), logs.astype(float), more.astype(float))
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "mark", "known", "logs", "more"])
            for i in range(0, whole.num_rows, 100_000):
                yield whole.slice(i, 100_000)

    answers = packets.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(count, _packet_schema(_SUMS, "block long"))
    sums = answers.repartition("block").sortWithinPartitions("block").mapInArrow(add, "id long, mark long, known long, logs double, more double")
    return sums.groupBy("id", "mark").agg(*[F.sum(c).alias(c) for c in ("known", "logs", "more")])


def scored(given: DataFrame, model: Model, block: int) -> DataFrame:
    """(doc_id, held_out, id, mark, n_tokens, known, logs, more) of each row of ``given`` (doc_id, held_out,
    id, mark, text), from its frequent words and pairs by probes of the filter."""
    held = given.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "id", "mark", "n_tokens", "known", "logs", "more"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        find, exact = m.finder(), np.append(m.counts, 0)  # the last is for rare words
        words, pairs = np.full(len(exact), np.nan), np.full(len(m.pairs), np.nan)  # probed when first met
        words[-1] = 0.0

        def probed(memo: np.ndarray, at: np.ndarray, keys) -> np.ndarray:
            new = np.flatnonzero((np.bincount(at, minlength=len(memo)) > 0) & np.isnan(memo))
            memo[new] = m.quantised(keys(new))
            return memo[at]

        for b in _blocks(batches, block):
            place, h = m.places(b.hashes), b.before()
            first, second = place[h], place[b.at]
            both = np.flatnonzero((first >= 0) & (second >= 0))
            found = find(pair_key(first[both], second[both]))
            both, found = both[found >= 0], found[found >= 0]
            second[second < 0] = len(exact) - 1
            word = probed(words, second, word_key)
            more = word_term(word)
            # no pair is more frequent than its words; the filter may tell a step too much
            pair = np.minimum(probed(pairs, found, lambda at: m.pairs[at]), np.minimum(word[both], words[first[both]]))
            more[both] += pair_term(pair, word[both], m.size)
            count = exact[second]
            sums = (b.per_row(x) for x in ((count > 0).astype(np.int64), np.log10(count + 1), more))
            columns = [*zip(*b.rows), b.sizes, *sums]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    return given.mapInArrow(run, "doc_id long, held_out boolean, id long, mark long, n_tokens long, known long, logs double, more double")


def score(docs: DataFrame, held_out: Column, share: int = 1_000_000, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Rows where ``held_out`` is not true train the model. A null text counts as empty: the
    boundary alone. A null doc_id trains and is scored; repeated rows count each. Without
    training rows every probability is 1. An empty table gives no rows. Other columns are
    not looked at. Rows are told apart by doc_id and a 64-bit hash of the text. A task holds a
    block or a part in memory, some 30 bytes a token; a packet between them has block/parts
    tokens, so both are to be raised with memory where there are over 10^12 tokens.
    """
    flag = F.coalesce(held_out, F.lit(False)).alias("held_out")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col("doc_id").cast("long"), flag, text.alias("text"))
    mark = F.xxhash64(F.col("doc_id").isNull(), "text").alias("mark")
    given = given.select("doc_id", "held_out", F.coalesce("doc_id", F.lit(0)).alias("id"), mark, "text")
    train = (~F.col("held_out")).alias("train")
    model = frequent(written(counted(given.select(train, "text"), share, block), "counts"), share)
    parts = max(1, -(-model.total // part))
    sums = written(gathered(dealt(given.select(train, "id", "mark", "text"), model, parts, block), parts, model.size), "sums")
    hot = sums.where("mark is null").select("id", "known").toArrow()  # at most a row a frequent pair
    n = np.zeros(len(model.pairs), np.int64)
    n[hot["id"].to_numpy()] = hot["known"].to_numpy()
    model.fill(n)
    rows = written(scored(given, model, block), "scores")
    # repeated rows have been summed together, and have equal shares in that
    copies = rows.groupBy("id", "mark").agg(F.count("*").alias("copies"))
    more = sums.join(copies, ["id", "mark"]).select("id", "mark", "copies", *[F.col(c).alias(f"more_{c}") for c in ("known", "logs", "more")])
    more = more.select("id", "mark", (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"), *[(F.col(c) / F.col("copies")).alias(c) for c in ("more_logs", "more_more")])
    size = F.col("n_tokens") * F.lit(math.log10(model.size))
    total = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return rows.join(more, ["id", "mark"], "left").select(
        "doc_id", "held_out", "n_tokens", total("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (total("logs") - size).alias("base_score"), (total("more") - size).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those whose id's crc32 doesn't leave 2 over a multiple of 7."""
    return score(table(spark, sf_dir, "documents"), crc32_of_id() % 7 == 2)
