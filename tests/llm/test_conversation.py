import hashlib
import random
import re
from functools import lru_cache
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.conversation import END, LETTER, START, crossings, damaged, joined, op13_conversations, repair, report, solved, weighed

LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def cheapest(rows):
    """(cost, audit) of rows (initial, fault), from the end, any edit at any place."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in "0a" else []
        turn = "a" if state == "u" else "u"
        if inserted < 3:
            c, audit = best(i, turn, inserted + 1)
            ways.append((c + 3, "I" + audit))
        if i < len(rows):
            initial, fault = rows[i]
            c, audit = best(i + 1, state, 0)
            ways.append((c + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                c, audit = best(i + 1, turn, 0)
                ways.append((c + 3 + more, "R" + audit))
                if initial == turn or (initial == "s" and state == "0"):
                    c, audit = best(i + 1, initial, 0)
                    ways.append((c + more, "K" + audit))
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), 0, -1):  # so that the recursion stays flat
        for state in "0sua":
            best(i, state, 0)
    return best(0, "0", 0)


def want(conversations, ids=()):
    out = {}
    for c in {*ids, *(r[0] for r in conversations)}:
        rows = [(t, " " if r is None else r, " " if x is None else x) for i, t, r, x in conversations if i == c]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            last = LAST.search(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults)))
        state, i, lines = "0", 0, []
        for edit in audit:
            role, text = ("", "") if edit == "I" else rows[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
            state = role[0]
        turns = [r[0] for r in rows if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damage(conversations):
    out = []
    for c, t, role, text in conversations:
        n = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [] if n == 0 else [(c, t, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def figures(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert figures(op13_conversations(spark, sf)) == want(damage(rows), {r[0] for r in rows})


HARD = [
    (1, None, "user", "no turn."), (1, 0, None, "no role."), (1, 1, "assistant", None), (1, 2, "User", "upper"), (1, 3, "", "none."), (1, 3, "", "none."),
    (2, 5, "system", "a."), (2, 5, "system", "b."), (2, 9, "unknown", "keeps its u?"), (2, -4, "assistant", "Ü日本! \n\t"), (3, 1, "user", ""), (4, 7, "system", "alone."),
    (None, 1, "user", "nobody's"), (None, 2, "assistant", "nobody's."), (5, 1, "user", "word " * 100_000 + "."), (5, 2, "tool", "x. "), (6, 1, "assistant", "a:b\nc."), (6, 1, "assistant", "a:b\nc."),
]


@pytest.mark.parametrize("block_bits", [16, 1])
def test_hard_rows(spark, block_bits):
    rng = random.Random(3)
    rows = HARD + [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(["a.", "b.", "c", " ", "d!", f"e{rng.random()}."])) for c in range(10, 40) for _ in range(rng.randrange(1, 12))]
    rows += [(99, i, "uas"[i * i % 7 % 3], f"line {i}" + ".!?  "[i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as segment", "1 as at", "2 as audit", "3 as `a.b`").repartition(4)
    assert figures(report(df, block_bits=block_bits)) == want(rows)
    assert figures(report(damaged(df), df, block_bits=block_bits)) == want(damage(rows), {r[0] for r in rows})


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(none).count() == 0 and repair(none).count() == 0
    gone = figures(report(none, spark.createDataFrame([(1,), (None,)], "conv_id long")))
    assert gone == dict.fromkeys((1, None), (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))


def test_repaired_rows_follow_the_pattern(spark):
    rows = [(c, i, r, f"{i}.") for c, roles in enumerate(["uau", "aa", "sus", "s", "xua", "uuaa"]) for i, r in enumerate({"u": "user", "a": "assistant", "s": "system", "x": "tool"}[k] for k in roles)]
    out = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "position").collect()
    for c in range(6):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out if r.conv_id == c and r.edit != "D"))
    assert [r.position for r in out if r.conv_id == 0] == [0, 1, 2, 3]
    assert [(r.edit, r.role, r.text) for r in out if r.conv_id == 0][-1] == ("I", "assistant", "")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40), st.integers(1, 7))
def test_any_cut_gives_the_least_audit(rows, size):
    letters = "".join(chr(LETTER + 4 * r + f) for r, f in rows)
    parts = [letters[i : i + size] for i in range(0, len(letters), size)]
    runs = [weighed(p) for p in parts]
    whole = runs[0]
    for r in runs[1:]:
        whole = joined(whole, r)
    assert whole == weighed(letters)
    last = min(range(4), key=lambda s: (whole[START][s][0] + END[s], whole[START][s][1]))
    audit = "".join(solved(p, s, t) for p, (s, t) in zip(parts, crossings(runs, START, last))) + "I" * (END[last] // 3)
    faults = ["", "truncated", "blank", "duplicate"]
    assert (whole[START][last][0] + END[last], audit) == cheapest(tuple(("sua"[r] if r < 3 else "x", faults[f]) for r, f in rows))
