import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.lexical import Segment, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def want(docs, items, k):
    """Every document scored for every item."""
    held = [(d, Counter(w), len(w)) for d, w in ((d, cut(t)) for d, t in docs) if w]
    total, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, w, _ in held for t in w)
    least = {}
    for i, t in items:
        if i is not None and (i not in least or least[i] is None or (t is not None and t < least[i])):
            least[i] = t
    out = []
    for i, text in least.items():
        scored = []
        for d, words, n in held:
            m = 75 + 25 * n * total // all_terms
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * words[t] // (1000 * words[t] + 12 * m)) for t in cut(text) if t in words)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def got(spark, docs, items, k=20, parts=3, **how):
    frame = lambda rows, id: spark.createDataFrame(rows, f"{id} long, text string").selectExpr("*", "1 as score", "2 as n", "3 as terms").repartition(parts)
    return sorted(map(tuple, search(frame(docs, "doc_id"), frame(items, "item_id"), k, **how).collect()), key=lambda r: r[:2])


HARD_DOCS = [(1, None), (2, ""), (3, " \t.,"), (4, "alpha beta"), (5, "ALPHA Beta"), (6, "alpha beta"), (6, "alpha beta"), (None, "alpha beta"), (None, "gamma"), (-7, "Ünïcode 日本 ÜNÏCODE \x7falpha"), (8, "beta " * 100_000 + "gamma"), (9, "a-b_c'd")]
HARD_ITEMS = [(1, "alpha ALPHA gamma"), (2, None), (3, ""), (4, "nothing of it"), (None, "alpha"), (5, "ünïcode 日本 d"), (6, "alpha"), (6, "beta"), (6, "beta"), (7, "beta alpha beta")]


@pytest.mark.parametrize(("k", "segment", "most"), [(20, 16_384, 2000), (2, 3, 2), (1, 1, 1)])
def test_hard_rows(spark, k, segment, most):
    assert got(spark, HARD_DOCS, HARD_ITEMS, k, segment_docs=segment, most=most) == want(HARD_DOCS, HARD_ITEMS, k)


def test_empty_tables(spark):
    assert got(spark, [], HARD_ITEMS, parts=1) == got(spark, HARD_DOCS, [], parts=1) == got(spark, [(1, "...")], HARD_ITEMS, parts=1) == []


def test_many_ties_and_small_segments(spark):
    random = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(int(random.integers(0, 400)), " ".join(random.choice(words, random.integers(1, 12), p=np.arange(40, 0, -1) / 820))) for _ in range(1500)]
    items = [(i, " ".join(random.choice(words, 6))) for i in range(60)]
    for segment in (16_384, 50):
        assert got(spark, docs, items, 7, segment_docs=segment, most=25) == want(docs, items, 7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 5), max_size=6), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 9), st.integers(1, 50)), max_size=6, unique_by=lambda x: x[0]), st.integers(1, 5), st.integers(0, 3000))
def test_a_segment_loses_none_of_the_best(docs, wanted, k, least):
    binary = lambda x: np.array(x, "<u4").tobytes()
    m = np.array([75 + 10 * len(d) for d in docs])
    segment = Segment(10, [binary(sorted(d)) for d in docs], [binary([d[t] for t in sorted(d)]) for d in docs], m)
    scores = [sum(w * (10**9 * d[t] // (1000 * d[t] + 12 * int(m[i]))) for t, w in wanted if t in d) for i, d in enumerate(docs)]
    found, values = segment.answer(wanted, k, least)
    assert all(scores[i] == v for i, v in zip(found, values))
    kth = sorted(scores)[-k] if len(scores) >= k else 0
    assert set(found.tolist()) == {i for i, s in enumerate(scores) if s >= max(1, least, kth)}


def test_accumulators_stop_being_created():
    """Once the rare term has filled the first k, the common one adds to those alone."""
    binary = lambda x: np.array(x, "<u4").tobytes()
    terms = [binary([0, 1]) if i < 10 else binary([1]) for i in range(1000)]
    segment = Segment(2, terms, [binary([1] * (len(t) // 4)) for t in terms], np.full(1000, 75))
    found, _ = segment.answer([(0, 9000), (1, 10)], 10, 0)
    assert found.tolist() == list(range(10)) and np.flatnonzero(segment.sums).tolist() == list(range(10))
