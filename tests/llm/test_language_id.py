from zlib import crc32

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from skein.llm.language_id import Training, classifier, crc32_of_id, identify, op8_language, train


def test_held_out_accuracy_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = op8_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.96 * len(held)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_hard_rows(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, None, "en"), (4, "", None), (5, "12 -- 7", "de"), (6, "der hund und", None), (None, "the and", "xx"), (7, "the dog and " * 200_000, "en"), (7, "Ж", "ru"), (8, "the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as score", "1 as margin", "2 as lang_pred")
    known = train(docs, F.lit(True))
    assert [k for k, _ in known][0] == "en" and {k for k, _ in known} == {"en", "de", "xx", "ru"}
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in identify(docs, known).collect()]
    assert (3, "und", True) in got and (4, "und", True) in got and (5, "und", True) in got
    assert (6, "de", False) in got and (7, "en", False) in got and len(got) == len(rows)
    kept = identify(docs, known, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "margin", "score", "rejected"]
    assert identify(docs.where("false"), known).count() == 0
    none = train(docs.where("false"), F.lit(True))
    assert none == [] and {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    single = identify(docs, train(docs.where("lang = 'en'"), crc32_of_id() >= 0)).collect()
    assert {r.lang_pred for r in single} == {"en", "und"}


def test_copies_take_one_place_in_the_sample(spark):
    texts = spark.createDataFrame([(f"text {chr(97 + i // 26)}{chr(97 + i % 26)}",) for i in range(60)], "text string")
    least = texts.orderBy(F.xxhash64("text", F.lit(8))).first().text
    rows = texts.unionByName(spark.range(400).select(F.lit(least).alias("text"))).selectExpr("0L as doc_id", "text", "'en' as lang")
    [(_, content)] = train(rows, F.lit(True), Training(rows=50))
    [(_, single)] = train(rows.distinct(), F.lit(True), Training(rows=50))
    assert content == single and content.count(b"text") == 50


def test_sample_takes_whole_texts(spark):
    rows = [(i, c * n, "en") for i, (c, n) in enumerate([("ab ", 50), ("cd ", 60), ("ef ", 70), ("gh ", 9_000), ("ij ", 8_000)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    [(_, content)] = train(docs, F.lit(True), Training(chars=10_000))
    whole = [t for _, t, _ in rows]
    assert all(t.strip().encode() in content for t in whole[:3])  # usual texts first, then the one that reaches the bound
    assert sum(t.strip().encode() in content for t in whole[3:]) == 1
    [(_, content)] = train(docs.where("doc_id >= 3"), F.lit(True), Training(chars=10))
    assert content in {t.strip().encode() for t in whole[3:]}  # a first text enters whole
    with pytest.raises(ValueError):
        train(docs.selectExpr("doc_id", "text", "cast(doc_id as string) as lang"), F.lit(True), Training(languages=4))


def test_same_as_a_plain_loop(spark):
    """The sample and the sizes of every text, one after the other."""
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    learnt = [r for r in rows if r["text"] and r["lang"] and crc32(str(r["doc_id"]).encode()) % 5]
    found = {}
    for lang in sorted({r["lang"] for r in learnt}):
        # xxhash64 of two columns: the first one's hash is the second one's seed
        h = lambda t: xxhash.xxh64_intdigest((8).to_bytes(4, "little"), xxhash.xxh64_intdigest(t.encode(), 42))
        texts = {r["text"] for r in learnt if r["lang"] == lang}
        ordered = sorted(texts, key=lambda t: (len(t) > 5_000, (h(t) + 2**63) % 2**64, t.encode()))
        taken, n = [], 0
        for t in ordered[:200]:
            if n < 200_000:
                taken.append(t)
            n += len(t)
        content = " ".join("".join(c if c.isalpha() else " " for c in "\n".join(taken).lower()).split()).encode()
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=6)
        found[lang] = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
    number = {k: sum(r["lang"] == k for r in learnt) for k in found}
    order = sorted(found, key=lambda k: (-number[k], k))
    differ = 0
    for got in op8_language(spark, sf).collect():
        text = next(r["text"] for r in rows if r["doc_id"] == got.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        w = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        starts = range(0, len(w), max(1, len(w) ** 2 // 2048))
        size = [sum(len(found[k].compress(b" " + w + b" " + w[i:] + b" " + w[:i])) for i in starts) for k in order]
        best = size.index(min(size))
        second = min(s for i, s in enumerate(size) if i != best)
        differ += got.lang_pred != order[best] or abs(got.score - (0.5 + 0.5 * (second - size[best]) / second)) > 1e-12
    assert differ == 0


def test_long_texts_are_read_whole():
    classify = classifier([("a", b"xyzzy plugh " * 50), ("b", b"lorem ipsum dolor " * 50)], block=100)
    assert classify("xyzzy plugh " + "lorem ipsum dolor " * 100)[0] == "b"
