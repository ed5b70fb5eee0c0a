import numpy as np
import xxhash

from skein.llm.simhash import fingerprint, links, masks, near_duplicates
from skein.llm.graph import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    rng, keep = np.random.default_rng(0), masks(4)
    assert len(keep) == 31
    for _ in range(3000):
        flip = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in keep)


def test_hard_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and then some more words follow it " * 4
    texts = [None, "", "  ", "one", "ONE", "two words", base, base.upper(), base + "end", base.replace("lazy", "idle", 1), "ÄÖ é x y z", "ÄÖ é x y z"]
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as fp", "1 as component_id")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], plain_classes([d for d, _ in rows], fps)))
    assert got == want
    assert near_duplicates(docs.where("false")).count() == 0
    null = spark.createDataFrame([(None, "x"), (9, "x"), (None, "y y y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(null).collect()} == {(None, 9), (9, 9), (None, None)}


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    assert fps == [fingerprint((r.text or "").encode()) for r in rows]
    want = dict(zip([r.doc_id for r in rows], plain_classes([r.doc_id for r in rows], fps)))
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want


def test_crowded_buckets_take_the_second_way(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ sum(1 << int(i) for i in rng.choice(62, k, replace=False)) for k in (1, 2, 3, 6, 9) for _ in range(60)}
    fps |= {int(x) for x in rng.integers(1 << 62, size=50)}
    ids = sorted(fps)
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    for limit in (10, 20_000):
        roots = {r.node: r.root for r in components(links(df, 4, limit)).collect()}
        assert [roots.get(x, x) for x in ids] == plain_classes(ids, ids)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (None, 3), (7, 6)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(101)}
