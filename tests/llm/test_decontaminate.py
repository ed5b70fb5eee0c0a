import random
import tracemalloc

from skein.llm.decontaminate import REACH, Index, Passages, Settings, Sparse, block_words, clean, common_subsequence, gram_sums, last_window, leaks, op3_decontamination, picked_sums, sure_passages, windows, words_of

import numpy as np


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b)


def test_every_stretch_of_64_words_lies_in_a_window():
    for n in (1, 64, 128, 129, 191, 192, 193, 500):
        window, hit = windows(np.arange(n), n)
        held = {}
        for w, h in zip(window.tolist(), hit.tolist()):
            held.setdefault(w, set()).add(h)
        assert all(max(v) - min(v) < 128 for v in held.values())
        assert all(any(set(range(i, min(n, i + 64))) <= v for v in held.values()) for i in range(max(1, n - 63)))


def fixture():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ke", "ro", "ti", "shu", "men", "lo"]) for _ in range(rng.choice([1, 2, 3, 4])))
    sentence = lambda n: " ".join([*(word() for _ in range(n)), word() + "."])
    items = [(i, " ".join(sentence(rng.randrange(5, 12)) for _ in range(4)).capitalize()) for i in range(30)]
    items += [(30, " ".join(sentence(10) for _ in range(16)))]
    docs, want = [], set()
    for d in range(300):
        body = [sentence(9) for _ in range(rng.randrange(3, 40))]
        if d % 3 == 0:
            i, text = rng.choice(items)
            words = text.split()
            if d % 2:  # some words out, some others in, the answer kept
                keep = len(words) - len(text.rsplit(". ", 1)[1].split())
                words = [w for k, w in enumerate(words) if k >= keep or rng.random() > 0.15]
                for _ in range(3):
                    words.insert(rng.randrange(len(words)), word())
            body.insert(rng.randrange(len(body)), " ".join(words).upper() if d % 4 == 0 else " ".join(words))
            want.add((d, i))
        docs.append((d, "\n".join(body)))
    return docs, items, want


def test_against_brute_force(spark):
    docs, items, want = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(d, b).collect()}
    assert len(want - set(got)) <= 0.05 * len(want)
    p, brute = Passages.of(items), set()
    for doc, text in docs:
        found = words_of(text)
        for item, words, answer in zip(p.items, p.words, p.answers):
            for i in range(0, len(found), 4):
                part = found[i : i + len(words) * 3 // 2]
                share = plain_lcs(words, part) / len(words) if len(set(words) & set(part)) > 0.3 * len(set(words)) else 0
                if share >= 0.8 or share >= 0.55 and plain_lcs(answer, part) >= 0.8 * len(answer):
                    brute.add((doc, item))
    assert set(got) <= brute and len(set(got) & brute) >= 0.95 * len(brute)
    assert {r.kind for r in got.values()} == {"copy", "paraphrase"}
    left = {r.doc_id for r in clean(d, b).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in got}
    small = {(r.doc_id, r.item_id) for r in leaks(d, b, Settings(block=9)).collect()}
    assert len(small & brute) >= 0.9 * len(brute) and small <= brute


def test_hot_and_short_passages_are_all_found(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]  # all of them common
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([5, 6, 8, 15, 40, 57, 64] * 6)]
    docs = []
    for d in range(400):
        body = [rng.choice(words) for _ in range(rng.randrange(50, 400))]
        if d % 2:
            body.insert(rng.randrange(len(body)), items[d % 3 and rng.randrange(len(items))][1])
        docs.append((d, " ".join(body)))
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 200 and want <= set(got)


def test_answers_of_one_sentence_and_of_a_word(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    one, short = " ".join(words), " ".join(words[:20]) + ". " + " ".join(words[20:39]) + ". Er."
    p = Passages.of([(1, one), (2, short)])
    assert [len(a) for a in p.answers] == [10, 4] and p.answers[0] == words_of(one)[-10:]
    kept = " ".join(w for i, w in enumerate(words) if i >= 30 or i % 2)  # 25 of 40 words, the end among them
    b = spark.createDataFrame([(1, one)], "item_id long, text string")
    got = leaks(spark.createDataFrame([(7, "before it " + kept), (8, "some other text")], "doc_id long, text string"), b).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(7, 1, "paraphrase")]


def test_hard_rows(spark):
    item = "the quick brown fox jumps over a lazy dog. who saw that ? the old grey cat did."
    rows = [(1, None), (2, ""), (3, "... -- !"), (4, item), (4, item), (None, item), (5, "x " * 400_000 + item.upper()), (6, "clean text"), (7, "Ж é " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "'k' as kind")
    bench = spark.createDataFrame([(9, item), (9, item), (10, None), (11, ""), (None, "?"), (None, "wholly other words here")], "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = sorted(((r.doc_id, r.item_id) for r in leaks(docs, bench).collect()), key=str)
    assert got == sorted([(4, 9), (4, 9), (None, 9), (5, 9), (7, 9)], key=str)
    kept = clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert leaks(docs.where("false"), bench).count() == 0 == leaks(docs, bench.where("false")).count()
    assert clean(docs, bench.where("false")).count() == len(rows)


LATENT = {"sure_words": 0, "sure_share": 0.0, "sure_energy": 0.0}  # the index has no entries


def test_recall_of_the_latent_search_alone(spark):
    docs, items, want = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    both = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    alone = {(r.doc_id, r.item_id) for r in leaks(d, b, Settings(**LATENT)).collect()}
    assert alone <= both and len(alone & want) >= 0.9 * len(want)
    sf = "/root/testdata/sf0.01"
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    both = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf).collect()}
    assert {(r.doc_id, r.item_id) for r in leaks(d, b, Settings(**LATENT)).collect()} == both


def test_which_passages_the_latent_search_answers_for():
    """Ten vocabulary words at least, a share of 0.15 of the passage's, and a quarter of its weight."""
    column, row = np.concatenate([np.arange(10), np.arange(9), np.arange(10), np.arange(10)]), np.repeat([0, 1, 2, 3], [10, 9, 10, 10])
    own = Sparse(row, column, np.full(len(row), 2.0), 4)
    latent = np.zeros((4, 5))
    latent[:, 0] = np.sqrt([10.1, 36.0, 40.0, 9.9])
    assert sure_passages(own, latent, np.array([64, 9, 67, 10]), Settings()).tolist() == [True, False, False, False]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf).collect()}
    assert want and got == want


def test_many_items_lose_no_exact_copy(spark):
    """2,000 items, some ten times the rank, in blocks: 300 exact copies and 300 paraphrases with a fifth of the words before the answer left out."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3_000)]
    word = lambda: words[int(3_000 * rng.random() ** 3)]  # noqa: E731  few are frequent
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, " ".join(sentence(rng.randrange(6, 14)) for _ in range(rng.randrange(2, 5)))) for i in range(2_000)]
    docs, exact, changed = [], set(), set()
    for d in range(1_200):
        body = [sentence(10) for _ in range(rng.randrange(5, 30))]
        if d % 4 < 2:
            i, text = rng.choice(items)
            answer = len(next(iter(Passages.of([(i, text)]).answers)))
            own = text.split()
            if d % 4:
                gone = set(rng.sample(range(len(own) - answer), (len(own) - answer) // 5))
                own = [w for k, w in enumerate(own) if k not in gone]
            (changed if d % 4 else exact).add((d, i))
            body.insert(rng.randrange(len(body)), " ".join(own))
        docs.append((d, " ".join(body)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_500, 700):
        got = {(r.doc_id, r.item_id) for r in leaks(d, b, Settings(block=block)).collect()}
        assert exact <= got and len(changed & got) >= 0.99 * len(changed), block
        assert len(got - exact - changed) <= 0.02 * len(got)


def test_sums_of_picked_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 100, (50, 3)).astype(np.float32)
    for sizes in ([1], [1, 1, 1], [7, 1, 31, 32, 33, 2], [1100, 1, 64], rng.integers(1, 90, 40).tolist(), []):
        pick, starts = rng.integers(0, 50, sum(sizes)), np.cumsum([0, *sizes])[:-1].astype(int)
        want = [x[pick[a : a + n]].sum(0) for a, n in zip(starts, sizes)]
        assert picked_sums(x, pick, starts).tolist() == [w.tolist() for w in want]


def rows_of(texts, size):
    """Rows of block_words, and the windows' counts, for (words' places, words, number of words) of each text."""
    rows, counts = [], []
    for at, word, n in texts:
        rows.append(((at // 64).astype("<i4").tobytes(), word.astype("<i4").tobytes(), last_window(n)))
        window, hit = windows(at, n)
        own = np.zeros((last_window(n) + 1, size))
        np.add.at(own, (window, word[hit]), 1)
        counts.append(own)
    return rows, np.concatenate(counts)


def test_gram_by_blocks_is_that_of_the_windows():
    rng, size, texts = np.random.default_rng(6), 40, []
    for n in (1, 5, 63, 64, 65, 127, 128, 129, 192, 193, 900, 5_000, 300_000):
        for share in (1, 0.2, 0.01):
            at = np.flatnonzero(rng.random(n) < share)
            if len(at):
                texts.append((at, rng.integers(0, size, len(at)), n))
    rows, counts = rows_of(texts, size)
    x, out = rng.normal(size=(size, 4)), np.zeros((size, 4))
    gram_sums(iter(rows), x, out)
    assert np.allclose(out, counts.T @ (counts @ x))


def test_gram_holds_few_blocks_at_once():
    """10,800 windows of some 30 vocabulary words each; 10,000 at once, as it was before, took 1,257 MB."""
    rng, size = np.random.default_rng(7), 3_000
    texts = [(np.sort(rng.choice(640, 160, False)), rng.integers(0, size, 160), 640) for _ in range(1_200)]
    rows = rows_of(texts[:1], size)[0] + [((at // 64).astype("<i4").tobytes(), word.astype("<i4").tobytes(), 8) for at, word, _ in texts[1:]]
    x, out = rng.normal(size=(size, 192)).astype(np.float32), np.zeros((size, 192))
    tracemalloc.start()
    gram_sums(iter(rows), x, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_each_word_of_a_text_is_stored_once(spark):
    """Words that lie in two windows were stored, and summed, twice."""
    docs = spark.createDataFrame([("a b c d " * 200,), ("a x " * 30,), ("x",), (None,)], "text string")
    rows = sorted(block_words(docs, {b"a": 0, b"c": 1}).collect(), key=lambda r: r.last)
    assert [r.last for r in rows] == [0, 11]
    assert [(len(r.words) // 4, len(r.blocks) // 4) for r in rows] == [(30, 30), (400, 400)]
    assert np.frombuffer(rows[1].blocks, "<i4").tolist() == [i // 64 for i in range(800) if i % 2 == 0]


def test_verifiable_in_small_parts_is_that_of_each_pair():
    """What fits a core's cache is compared at once: 500 pairs before, which took 14 MB."""
    rng = np.random.default_rng(9)
    passages = [rng.integers(0, 300, n) for n in rng.integers(5, 65, 60)]
    index = Index(passages, [x[-4:] for x in passages], np.full(300, 5), Settings(), np.zeros(60, bool))
    line = rng.integers(-1, 300, 40 * REACH).astype(np.int32)
    for i in range(0, 36, 2):
        line[i * REACH + 40 : i * REACH + 40 + len(passages[i])] = passages[i]
    start, passage = np.repeat(np.arange(38) * REACH, 60), np.tile(np.arange(60), 38)
    tracemalloc.start()
    got = index.verifiable(line, start, passage)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [bool(index.verifiable(line, start[i : i + 1], passage[i : i + 1])[0]) for i in range(len(start))]
    assert all(got[(start == i * REACH) & (passage == i)].all() for i in range(0, 36, 2)) and not got.all()
    assert peak < 4e6, peak
