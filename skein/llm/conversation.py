"""Operator 13: repair of a conversation's structure by divide and conquer.

A repaired conversation's roles are nothing, or perhaps one system turn and then pairs of user and
assistant. Rows may be kept, given another role, deleted, and empty turns inserted, each at a cost;
of the cheapest edits those whose initials, the audit, are least in ASCII are taken.

The language has four states, so what a run of rows does is four by four numbers: the cost from
each state to each other, and for each first state the order in which the best audits to the last
states stand. (Two audits of the same rows are never a prefix of one another, as each row has one
letter but I and the last letter is a row's; so the least way over a crossing is decided by the order
of the ways up to it.) Runs combine, hence

1. rows are numbered in order of (conversation, turn, role, text) by ranges, without their texts; only
   equal rows' first numbers are grouped, to tell duplicates;
2. a conversation's rows in a range of 65,536 numbers are a segment, a letter a row; each segment's
   costs and orders are computed where it lies;
3. segments' costs meet, a small row a segment: forward and backward vectors of four costs meet in
   the middle of a conversation, the crossing with the least audit among the cheapest is chosen, and
   both halves are solved alike (Hirschberg, 1975);
4. each segment is solved the same way between its two states, down to single rows, in linear space;
5. texts move once, to be read beside the audit of their conversation, in order, a batch at a time.

So a conversation with a third of all rows is numbered, weighed and solved in many tasks. Its hash,
which the query asks for, can only be taken from first to last: a task streams it, holding a batch
and a letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table, written

BLOCK_BITS = 16
FAR = 1 << 60
# States: nothing yet, after system, after user, after assistant; and what an end in each costs, an I for each 3.
START, SYSTEM, USER, ASSISTANT = range(4)
END = (0, 6, 3, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"
# A row's letter is this plus 4 times its role's place in "sua" (3: another) plus its fault's number.
LETTER = ord("a")
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Matrix = tuple[tuple[tuple[int, int], ...], ...]  # of [first][last]: (cost, place in order)
Vector = Sequence[tuple[int, int]]


def _turn(state: int) -> int:
    """The state after the user's or assistant's turn that may follow."""
    return ASSISTANT if state == USER else USER


def _moves(role: int, fault: int) -> Iterator[tuple[int, int, int, str]]:
    """(first, last, cost, audit) of all that may be done with a row, with a turn inserted before it or none."""
    for first in range(4):
        yield first, first, 4, "D"
        if fault in (BLANK, DUPLICATE):
            continue
        more = 3 if fault == TRUNCATED else 0
        for state, cost, before in ((first, more, ""), (_turn(first), more + 3, "I")):
            yield first, _turn(state), cost + 3, before + "R"
            if (role == 0 and state == START) or (role in (1, 2) and _turn(state) == role + 1):
                yield first, role + 1, cost, before + "K"


def _ordered(ways: Sequence[tuple[int, tuple]]) -> tuple[tuple[int, int], ...]:
    """(cost, place) from (cost, what to sort by) of each last state."""
    place = {key: i for i, key in enumerate(sorted(key for cost, key in ways if cost < FAR))}
    return tuple((cost, place[key]) if cost < FAR else (FAR, 4) for cost, key in ways)


def _row(role: int, fault: int) -> tuple[Matrix, dict[tuple[int, int], str]]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for first, last, cost, audit in _moves(role, fault):
        best[first, last] = min(best.get((first, last), (FAR, "")), (cost, audit))
    matrix = tuple(_ordered([best.get((s, t), (FAR, "")) for t in range(4)]) for s in range(4))
    return matrix, {k: audit for k, (_, audit) in best.items()}


_ROWS = {chr(LETTER + 4 * role + fault): _row(role, fault) for role in range(4) for fault in range(4)}
_ONE: Matrix = tuple(tuple((0, 0) if s == t else (FAR, 4) for t in range(4)) for s in range(4))


def follow(vector: Vector, matrix: Matrix) -> Vector:
    """The costs and order after ``matrix``; of equal costs the way that is first so far."""
    ways = []
    for t in range(4):
        cost, place, s = min((vector[s][0] + matrix[s][t][0], vector[s][1], s) for s in range(4))
        ways.append((min(cost, FAR), (place, matrix[s][t][1])))
    return _ordered(ways)


def joined(a: Matrix, b: Matrix) -> Matrix:
    """Both, one after the other."""
    return tuple(follow(row, b) for row in a)


def before(matrix: Matrix, costs: Sequence[int]) -> list[int]:
    """The costs to the end from before ``matrix``, given those behind it."""
    return [min(cost + c for (cost, _), c in zip(row, costs)) for row in matrix]


def crossings(runs: Sequence[Matrix], first: int, last: int) -> list[tuple[int, int]]:
    """The first and last state of each run on the best way from ``first`` to ``last``."""
    if len(runs) == 1:
        return [(first, last)]
    half = len(runs) // 2
    ahead = reduce(follow, runs[:half], _ONE[first])
    behind = reduce(lambda costs, m: before(m, costs), reversed(runs[half:]), [0 if t == last else FAR for t in range(4)])
    at = min(range(4), key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
    return crossings(runs[:half], first, at) + crossings(runs[half:], at, last)


def solved(letters: str, first: int, last: int) -> str:
    """The audit of rows between two states."""
    if len(letters) > 16:
        return "".join(_ROWS[x][1][way] for x, way in zip(letters, crossings([_ROWS[x][0] for x in letters], first, last)))
    return _solved_short(letters, first, last)


@lru_cache(1 << 16)
def _solved_short(letters: str, first: int, last: int) -> str:
    return "".join(_ROWS[x][1][way] for x, way in zip(letters, crossings([_ROWS[x][0] for x in letters], first, last)))


def weighed(letters: str) -> Matrix:
    """The costs and orders of a run of rows."""
    if len(letters) <= 16:
        return _weighed_short(letters)
    half = len(letters) // 2
    return joined(weighed(letters[:half]), weighed(letters[half:]))


@lru_cache(1 << 16)
def _weighed_short(letters: str) -> Matrix:
    return reduce(joined, (_ROWS[x][0] for x in letters), _ONE)


def illegal_pairs(letters: str) -> int:
    roles = [(ord(x) - LETTER) >> 2 for x in letters]
    return sum(p not in LEGAL for p in zip(roles, roles[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with the faults that each row's number calls for; nulls of
    role and text are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), own("role").alias("role"), own("text").alias("text"), number.alias("__n")).where("__n <> 0")
    text = F.when(F.col("__n") == 1, F.lit("")).when(F.col("__n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__n") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__n") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("__twice")).drop("__twice")


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, at): ``at`` numbers the rows in order, by ranges."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), initial.alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("number"))
    order = ["conv_id", "turn", "role", "digest", "number"]
    return written(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("number").withColumn("at", F.monotonically_increasing_id()), "order")


def _segments(ordered: DataFrame, block_bits: int) -> DataFrame:
    """(conv_id, segment, letters): a row for each conversation and range of 2^block_bits numbers; ``segment`` is its first number."""
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("first").isNull() & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    letter = F.char(F.lit(LETTER) + 4 * F.col("initial") + fault)
    marked = ordered.join(firsts, "at", "left").select("conv_id", "at", letter.alias("letter"))
    held = F.array_sort(F.collect_list(F.struct("at", "letter")))  # of 2^block_bits rows at most
    grouped = marked.groupBy("conv_id", F.shiftright("at", block_bits).alias("block")).agg(held.alias("held"))
    return written(grouped.select("conv_id", F.col("held")[0]["at"].alias("segment"), F.array_join(F.col("held.letter"), "").alias("letters")), "segments")


def _weights(segments: DataFrame) -> DataFrame:
    """(conv_id, segment, what): its cost and order matrix flat, first and last role, illegal pairs and faults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what = []
            for letters in batch.column(2).to_pylist():
                flat = [x for row in weighed(letters) for way in row for x in way]
                faults = [sum(letters.count(chr(LETTER + 4 * r + f)) for r in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
                what.append([*flat, (ord(letters[0]) - LETTER) >> 2, (ord(letters[-1]) - LETTER) >> 2, illegal_pairs(letters), *faults])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(what, pa.list_(pa.int64()))], ["conv_id", "segment", "what"])

    return segments.mapInArrow(run, "conv_id long, segment long, what array<long>")


_BOUNDS = "conv_id long, segment long, first int, last int, tail int, blank long, duplicate long, truncated long, illegal long, cost long"


def _bounds(weights: DataFrame) -> DataFrame:
    """A row a segment: the states between which it is to be solved, and the turns to add at its end. A
    conversation's figures are in its first segment's row."""
    names = [c.split()[0] for c in _BOUNDS.split(", ")]
    types = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] * 5

    def conversation(conv_id: int | None, parts: list[tuple[int, list[int]]]) -> Iterator[tuple]:
        runs = [tuple(tuple((w[8 * s + 2 * t], w[8 * s + 2 * t + 1]) for t in range(4)) for s in range(4)) for _, w in parts]
        ahead = reduce(follow, runs, _ONE[START])
        last = min(range(4), key=lambda s: (ahead[s][0] + END[s], ahead[s][1]))
        meets = sum((a[33], b[32]) not in LEGAL for (_, a), (_, b) in zip(parts, parts[1:]))
        sums = [sum(w[i] for _, w in parts) for i in (35, 36, 37, 34)]
        figures = (*sums[:3], sums[3] + meets, ahead[last][0] + END[last])
        for i, ((segment, _), (s, t)) in enumerate(zip(parts, crossings(runs, START, last))):
            yield conv_id, segment, s, t, END[t] // 3 if i == len(parts) - 1 else 0, *(figures if i == 0 else (None,) * 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: int | None = None
        parts: list[tuple[int, list[int]]] = []
        rows: list[tuple] = []
        for batch in batches:
            for conv_id, segment, what in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and conv_id != of:
                    rows += conversation(of, parts)
                    parts = []
                of = conv_id
                parts.append((segment, what))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                rows = []
        if parts:
            rows = list(conversation(of, parts))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return written(weights.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, _BOUNDS), "bounds")


def _audits(segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """(conv_id, segment, audit)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solved(x, s, t) + "I" * n for x, s, t, n in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["conv_id", "segment", "audit"])

    both = segments.join(bounds.select("segment", "first", "last", "tail"), "segment")
    return both.select("conv_id", "segment", "letters", "first", "last", "tail").mapInArrow(run, "conv_id long, segment long, audit string")


_REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _applied(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows with their edits, a conversation's together and in order."""
    none = F.lit(None)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), none.cast("long").alias("segment"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text")
    edits = audits.select("conv_id", F.lit(0).alias("kind"), "segment", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"))
    order = ["conv_id", "kind", "segment", "turn", "role", "digest"]
    stream = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")
    names, types = [c.split()[0] for c in _REPAIRED.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pieces: list[str] = []
        of, audit, at, state, position = None, "", 0, START, 0

        def put(edit: str, role: str, text: str, to: int) -> None:
            nonlocal state, position
            rows.append((of, position, edit, role, text))
            state, position = to, position + 1

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", NAMES[_turn(state)], "", _turn(state))
                at += 1

        for batch in batches:
            for conv_id, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if not pieces:  # the next conversation; what is to be added to the last one
                        insert()
                        of, audit, at, state, position = conv_id, "", 0, START, 0
                    elif conv_id != of:
                        raise ValueError("a conversation has edits but no rows")
                    pieces.append(text)
                    continue
                if pieces:
                    audit, pieces = "".join(pieces), []
                insert()
                edit = audit[at]
                at += 1
                if edit == "R":
                    put(edit, NAMES[_turn(state)], text, _turn(state))
                else:
                    put(edit, role, text, state if edit == "D" else "sua".index(role[0]) + 1)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                rows = []
        insert()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return stream.mapInArrow(run, _REPAIRED)


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of rows as ``_applied`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: int | None = None
        edits: list[str] = []
        kept, sha = 0, hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for conv_id, edit, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if edits and conv_id != of:
                    done.append((of, "".join(edits), sha.hexdigest()))
                    edits, kept, sha = [], 0, hashlib.sha256()
                of = conv_id
                edits.append(edit)
                if edit != "D":
                    sha.update((f"\n{role}:{text}" if kept else f"{role}:{text}").encode())
                    kept += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])
                done = []
        if edits:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array(["".join(edits)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    return repaired.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def _steps(rows: DataFrame, block_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows in order, bounds, audits)"""
    ordered = _in_order(rows)
    segments = _segments(ordered, block_bits)
    bounds = _bounds(_weights(segments))
    return ordered, bounds, _audits(segments, bounds)


def _named(conversations: DataFrame) -> DataFrame:
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), own("role"), own("text"))


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of ``conversations`` (conv_id, turn, role, text) and the turns
    added to them, in order, with what was done to each: K kept, R given another role, D to be deleted, I inserted.

    Rows go by turn, nulls first, those of one turn by role and then by the text's MD5. A null role
    or text is one space. Rows without conv_id are a conversation. A row that repeats role and text
    of an earlier one is a duplicate. Roles count by their first letter; any but s, u and a must
    change or go. Very long texts and conversations are streamed. Other columns, whatever their
    names, are not looked at. An empty table gives no rows.
    """
    rows = _named(conversations)
    return _applied(rows, _steps(rows, block_bits)[2])


def report(conversations: DataFrame, ids: DataFrame | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """A row for each conversation, of ``ids`` (conv_id) too: gaps, faults and illegal neighbours, the cost of
    the repair, its audit, and the SHA-256 of the repaired rows. Rows are taken as in ``repair``; a
    conversation without rows has zeros, an empty audit and the hash of nothing."""
    rows = _named(conversations)
    ordered, bounds, audits = _steps(rows, block_bits)
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    parts = [
        conversations.select(F.col("conv_id").cast("long")).distinct() if ids is None else ids.select(F.col("conv_id").cast("long")).distinct(),
        ordered.groupBy("conv_id").agg(gap.alias("gaps")),
        bounds.where("cost is not null").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost"),
        _digests(_applied(rows, audits)),
    ]
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    texts = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    figures = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers]
    return one.groupBy("conv_id").agg(*figures, *(F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in texts.items()))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return report(damaged(conversations), conversations)


def _step_sql(first: int) -> str:
    """The least (cost, audit) to the end from state ``first`` over row ``r``, given those behind it, b.b0 to b.b3."""
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    way = lambda cost, edit, last: f"{{'c': {cost} + b.b{last}.c, 'a': '{edit}' || b.b{last}.a}}"
    ways = [way(4, "D", first)]
    for state, cost, edit in ((first, 0, ""), (turn[first], 3, "I")):
        ways.append(way(f"{cost + 3} + r.more", edit + "R", turn[state]))
        for letter, last in (("s", 1), ("u", 2), ("a", 3)):
            if (state == 0) if letter == "s" else turn[state] == last:
                ways.append(way(f"CASE WHEN r.initial = '{letter}' THEN {cost} + r.more ELSE {1 << 40} END", edit + "K", last))
    return f"list_min([{', '.join(ways)}])"


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs),
k AS (SELECT *, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])) AS crc FROM conversations, t),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(crc, 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM n WHERE fault <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
r AS (SELECT *, CASE fault WHEN 'blank' THEN {1 << 40} WHEN 'duplicate' THEN {1 << 40} WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f),
b AS (SELECT conv_id, max(i) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS b0, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS b1, {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS b2, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS b3 FROM r GROUP BY conv_id
      UNION ALL SELECT b.conv_id, b.i - 1, {", ".join(map(_step_sql, range(4)))} FROM b JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i),
a AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM b WHERE i = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS spot FROM a),
p AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
l AS (SELECT p.*, CASE WHEN edit <> 'I' THEN text ELSE '' END AS text, role,
        max(CASE WHEN edit = 'K' AND place = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led FROM p LEFT JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot)) AS repaired_sha256
      FROM l WHERE edit <> 'D' GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""
