"""Operator 7: exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments. With a segment's mean m and deviation s over L
components, the inner product of two segments is at most L (m m' + s s'), by
Cauchy and Schwarz on what is left after the means; as squared distance is
|x|^2 + |y|^2 - 2 x.y, that is the lower bound of the distance. Bounds at few
segments come first, those at more segments only for what survived, and exact
integer products for the rest. A candidate is dropped only if its bound is below
the k-th best exact score so far, so the result is exact, ties included.

Queries and candidates meet in blocks of bounded size: a task holds one block of
each and returns k candidates for each of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import table, written

LEVELS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means and deviations, scaled so that products of rows are the bounds."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1) if x.shape[1] else []
    root = [math.sqrt(p.shape[1]) for p in parts]
    means = [p.mean(1) * r for p, r in zip(parts, root)]
    spread = [p.std(1) * r for p, r in zip(parts, root)]
    return np.stack([*means, *spread], axis=1) if parts else np.zeros((len(x), 1))


def _product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product, as the nearest number that a long can hold."""
    return max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b))))


def _plain_block(own: int, query: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(rows != own)
    got = [_product(vectors[j], query) for j in left]
    best = sorted(range(len(left)), key=lambda j: (-got[j], ids[left[j]]))[:k]
    return ids[left[best]], np.array([got[j] for j in best], np.int64)


def _stacked(vectors: list) -> np.ndarray:
    """Whole numbers, given as long or double, as 64-bit integers if doubles hold them exactly, else as Python's."""
    held = np.stack([np.asarray(v) for v in vectors])
    if held.dtype.kind == "i" or np.abs(held).max(initial=0) < 2.0**53:
        return held.astype(np.int64)
    return np.array([[int(x) for x in v] for v in held], dtype=object)


def search_block(own: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's best k of the block, best first, ties to smaller ids; its own row left out."""
    order = np.argsort(ids, kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    if object in (vectors.dtype, queries.dtype):  # numbers of any size: no bounds, plain integers
        return [_plain_block(own[i], queries[i], rows, ids, vectors, k) for i in range(len(own))]
    exact = vectors.astype(np.float64)  # sums of integer products below 2^53 are exact
    mine = queries.astype(np.float64)
    whole = float(np.abs(exact).max(initial=0)) * float(np.abs(mine).max(initial=0)) * max(1, exact.shape[1]) < 2**53
    held = [(statistics(mine, n), statistics(exact, n)) for n in levels]
    out = []
    for i in range(len(own)):
        score = (lambda rows: exact[rows] @ mine[i]) if whole else (lambda rows: np.array([_product(v, queries[i]) for v in vectors[rows]], dtype=object))
        left = np.flatnonzero(rows != own[i])
        if len(left) > k:
            bound = held[0][1][left] @ held[0][0][i]
            first = left[np.argpartition(-bound, k - 1)[: 4 * k]]
            slack = 1e-9 * (1 + float(np.abs(bound).max()))
            least = np.partition(score(first), -k)[-k] if len(first) >= k else -np.inf
            left = left[bound >= float(least) - slack]
            for q, c in held[1:]:
                bound = c[left] @ q[i]
                left = left[bound >= float(least) - slack]
        got = score(left)
        best = np.lexsort((ids[left], -got))[:k] if whole else np.array(sorted(range(len(left)), key=lambda j: (-got[j], ids[left[j]]))[:k], dtype=int)
        out.append((ids[left][best], got[best]))
    return out


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component, in doubles, which hold it exactly (a product over 1e300 counts
    as 1e300); vectors that are null, empty of a component or hold a non-finite one are left out."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    bounded = lambda c: F.greatest(F.lit(-1e300), F.least(F.lit(1e300), c * factor))
    whole = lambda c: F.when(F.abs(c * factor) < 2.0**53, F.floor(c * factor).cast("double")).otherwise(bounded(c))  # noqa: E731  no fractions from 2^53 on
    return vectors.where(usable).select(F.col("vec_id").cast("long"), F.transform(x, whole).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 20, query_block: int = 4096, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``vectors`` (vec_id, v: whole numbers, in longs or doubles) where ``is_query`` holds.

    The score is the inner product; candidates are all rows but the query's own with the same
    number of components. Repeated rows are candidates each, and a repeated query id is answered
    once, for its least vector. A score that no long can hold counts as the nearest that one can. Rows without id take no part. Other columns, whatever their
    names, are not looked at. An empty table gives no rows. A task holds a block of queries and
    one of candidates; rows are dealt to blocks by number, so equal ids spread.
    """
    held = written(vectors.where("vec_id is not null").select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    least = held.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "row")).alias("least"))
    queries = least.select("vec_id", "least.v", "least.row")
    counts = held.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, q_blocks = max(1, -(-counts.n // block)), max(1, -(-counts.q // query_block))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", "row", dealt(q_blocks).alias("q"), every(n_blocks).alias("c"))
    right = held.select("vec_id", "v", "row", dealt(n_blocks).alias("c"), every(q_blocks).alias("q"))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for size in set(map(len, q["v"])):
            mine, theirs = q[q["v"].map(len) == size], c[c["v"].map(len) == size]
            if not len(theirs):
                continue
            stack = lambda df: _stacked(df["v"].tolist())
            ids = mine["vec_id"].to_numpy()
            for query, (found, scores) in zip(ids, search_block(mine["row"].to_numpy(), stack(mine), theirs["row"].to_numpy(), theirs["vec_id"].to_numpy(), stack(theirs), k)):
                parts.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": scores.astype(np.int64)}))
        return pd.concat(parts) if parts else pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_id", "vec_id", "score")})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every one whose id is divisible by 20."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
