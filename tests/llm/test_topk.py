import numpy as np
from pyspark.sql import functions as F

from skein.llm.topk import LEVELS, op7_topk, quantised, search_block, statistics, top_k


def plain(rows, k=20, every=20):
    vectors = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in vectors if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_bounds_hold_and_get_finer():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    before = np.inf
    for n in (*LEVELS, 64):
        bound = statistics(x, n) @ statistics(y, n).T
        assert (bound >= x @ y.T - 1e-9).all() and (bound <= before + 1e-9).all()
        before = bound
    np.testing.assert_allclose(before, x @ y.T)


def test_large_components_stay_exact():
    big = np.array([[2**31, 1], [2**31, 0], [5, 5]])
    ((ids, scores),) = search_block(np.array([9]), np.array([[2**31 - 1, 1]]), np.array([5, 6, 7]), np.array([1, 2, 3]), big, 2)
    assert ids.tolist() == [1, 2] and [int(s) for s in scores] == [2**31 * (2**31 - 1) + 1, 2**31 * (2**31 - 1)]


def test_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(120)]
    rows += [(i, [0.5] * 8) for i in range(200, 290)] + [(300, None), (301, [None] * 8), (320, [float("nan")] * 8), (340, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (360, [1.0, 2.0]), (361, [1.0, 3.0]), (380, []), (381, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as rank")
    for blocks in ((4096, 16_384), (3, 17)):
        got = top_k(quantised(table), F.col("vec_id") % 20 == 0, 20, *blocks).collect()
        assert {tuple(r) for r in got} == plain(rows) and len(got) == len(plain(rows))
    assert top_k(quantised(table.where("false")), F.col("vec_id") % 20 == 0).count() == 0


def test_any_finite_component(spark):
    rows = [(20, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0]), (3, [1e30, -1e30]), (4, [3e-8, 5.0]), (5, [1e300, 0.0]), (40, [1e-9, -1.7e308]), (6, [0.5, 0.0]), (60, [0.25, 0.0])]
    got = {tuple(r) for r in top_k(quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 20 == 0).collect()}
    whole = lambda x: 64 * int(x) if abs(x) >= 2**53 else int(np.floor(64 * x))
    vectors = {i: [max(-int(1e300), min(int(1e300), whole(x))) for x in v] for i, v in rows}
    want = set()
    for q in (20, 40, 60):
        score = lambda i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], vectors[i]))))  # noqa: B023, E731
        want |= {(q, r + 1, i, score(i)) for r, i in enumerate(sorted((i for i in vectors if i != q), key=lambda i: (-score(i), i)))}  # noqa: B023
    assert got == want


def test_repeated_ids(spark):
    rows = [(20, [3, 0]), (20, [1, 1]), (20, [1, 1]), (5, [2, 2]), (5, [2, 2]), (7, [0, 1])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 20).collect()
    # the query is one row with [1, 1]; its other rows are candidates
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 5, 4), (2, 5, 4), (3, 20, 3), (4, 20, 2), (5, 7, 1)]


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert {tuple(r) for r in op7_topk(spark, "/root/testdata/sf0.01").collect()} == plain(rows)
