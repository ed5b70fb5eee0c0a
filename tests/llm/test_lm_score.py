import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from skein.llm.language_id import crc32_of_id
from skein.llm.lm_score import PRIOR, STEP, LogBloom, op5_lm_score, score


def plain(rows):
    toks = [(d, crc32(str(d).encode()) % 7 == 2 if d is not None else False, [*(t or "").encode().lower().split(), b"\n"]) for d, t in rows]
    c = Counter(w for _, held, ws in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, held, ws in toks]


def same(got, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    want = sorted(plain(rows), key=str)
    assert [g[:5] for g in sorted(got, key=lambda r: str(r[:5]))] == [w[:5] for w in sorted(want, key=lambda r: str(r[:5]))]
    np.testing.assert_allclose(sorted(g[5] for g in got), sorted(w[5] for w in want), rtol=1e-9, atol=1e-9)


def test_filter_keeps_counts_to_a_step():
    rng = np.random.default_rng(0)
    keys = rng.integers(1 << 60, size=5000).astype(np.uint64)
    counts = np.exp(rng.random(5000) * 9)
    held = LogBloom(keys, counts, 2)
    got = held.count(keys)
    inside = (got / counts > 1 / 1.21) & (got / counts < 1.21)
    assert inside[counts >= 2].mean() > 0.98 and (got[counts >= 2] > 0).all()
    alone = np.argmax(counts)  # a key that ends the search by itself counts too
    assert abs(held.count(keys[alone : alone + 1])[0] / counts[alone] - 1) < 0.21
    assert (held.count(rng.integers(1 << 60, size=20_000).astype(np.uint64)) > 0).mean() < 0.02


def test_hard_rows(spark):
    rows = [(i, "the cat sat on the mat " * (i % 5) + f"w{i % 11}") for i in range(200)]
    rows += [(500, None), (501, ""), (501, ""), (None, "The CAT é"), (502, "rare" + "x" * 10_000), (503, "long text " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'h' as h").repartition(4)
    for share in (1_000_000, 20):
        got = score(docs, crc32_of_id() % 7 == 2, share).collect()
        same(got, rows)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert score(docs.where("false"), crc32_of_id() % 7 == 2).count() == 0
    none = score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in none} == {(0, 0, 0.0)}


def test_pairs_raise_the_score_of_what_follows_them(spark):
    rows = [(i, "a b c d e f") for i in range(60)] + [(1000, "a b c d e f"), (1001, "f e d c b a")]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert got[1000].score > got[1000].base_score > got[1001].score


def quantised(n):
    return STEP ** math.floor(math.log(n) / math.log(STEP) + 1e-9) * (1 + STEP) / 2 if n else 0


def plain_scores(rows, held):
    """The model's score of each row, word by word; rows are (id, text), and ``held`` tells those that don't train."""
    toks = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    pairs = Counter(p for i, ws in toks if not held(i) for p in zip([b"\n", *ws], ws))
    size = sum(c.values()) + len(c) + 1
    p = lambda h, w: (quantised(pairs[h, w]) + PRIOR * (quantised(c[w]) + 1) / size) / (quantised(c[h]) + PRIOR)
    return [sum(math.log10(p(h, w)) for h, w in zip([b"\n", *ws], ws)) for _, ws in toks]


def close(got, want):
    """The filter may tell a count a step too high, rarely; all else is exact."""
    off = np.array(got) - np.array(want)
    assert (np.abs(off) < 1e-6).mean() > 0.7 and np.abs(off).max() < 0.5 + 0.002 * np.abs(want).max()


def test_rare_pairs_count_at_any_share(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) if x < 60)) for i in range(80)]
    rows += [(1000 + i, t) for i, t in enumerate(["w1 w2 w3 w2 w1 w7", "new w1 new new w2", "", "w40 w1 w50", "late late late late late"])]
    want = plain_scores(rows, lambda i: i >= 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for share, part, block in ((1_000_000, 1 << 22, 1 << 22), (100, 500, 300), (10, 1 << 22, 1 << 22)):
        got = {r.doc_id: r.score for r in score(docs, F.col("doc_id") >= 1000, share, part, block).collect()}
        close([got[i] for i, _ in rows], want)


def test_repeated_rows_have_equal_scores(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "a b d"), (8, "a b c"), (None, "a b c"), (0, "a b c"), (9, "x a b")]
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 9, 2, 2, 3).collect()
    want = plain_scores(rows, lambda i: i == 9)
    assert len(got) == len(rows)
    close(sorted(r.score for r in got), sorted(want))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op5_lm_score(spark, "/root/testdata/sf0.01").collect()
    same(got, rows)
    held = [r for r in got if r.held_out]
    scores = {r.doc_id: r.score for r in got}
    close([scores[i] for i, _ in rows], plain_scores(rows, lambda i: crc32(str(i).encode()) % 7 == 2))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
