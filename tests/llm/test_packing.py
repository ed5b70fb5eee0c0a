import collections
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm.packing import Limits, op1_packing, pack_documents, pack_pool, powers_of_two
from skein.llm.tokens import Ids

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  two  spaces ", "a\n\nb \n c\n", "it's o'clock '", "¼ of ²x", "\x1c\x85 \xa0x", "日本 語  text", "<|endoftext|> x <|EndOfText|>", "naïve Ünïcode ß µ ª", "été", "tab\t\tx\r\n", "123 4567 a1b2", "ΣΑΣ", "İi"]
one = {BYTE: Ids(BYTE, "byte", "<u4"), WORD: Ids(WORD, "word", "<u4")}
library = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def same(path, text):
    return np.frombuffer(one[path](text), "<u4").tolist() == library[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    assert all(same(path, t) for t in ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60))
def test_ids_of_any_text(text):
    assert same(BYTE, text) and same(WORD, text)


def test_pool_keeps_all_three_limits():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 400)
    loss = (tokens * rng.random(400)).astype(int)
    limits = Limits(1024, 3, 500)
    sequences = pack_pool(tokens, loss, limits)
    got = collections.Counter()
    for s in sequences:
        assert sum(n for _, _, n in s) <= 1024 and len(s) <= 3
        for i, _, n in s:
            got[i] += n
    assert [got[i] for i in range(400)] == tokens.tolist()
    whole = [s for s in sequences if all(n == tokens[i] for i, _, n in s)]
    assert whole and all(sum(loss[i] for i, _, _ in s) <= 500 for s in whole)


def test_powers_of_two():
    assert [sum(n for _, _, n in s) for s in powers_of_two([(0, 0, 300), (1, 5, 7)])] == [256, 32, 16, 2, 1]


def checked(rows, texts):
    ids = [[*library[BYTE].encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts]
    want = collections.Counter((d, len(x)) for (d, _), x in zip(texts, ids))
    spans = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (d, _), x in zip(texts, ids):
        if list(want).count((d, len(x))) == 1 and sum(k[0] == d for k in want.elements()) == 1:
            at = 0
            for start, n, crc, total in sorted(spans[d]):
                assert start == at and total == len(x) and crc == crc32(np.array(x[start : start + n], "<u4").tobytes())
                at += n
            assert at == len(x)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_documents_with_hard_rows(spark):
    texts = list(enumerate([None, *ODD, "word " * 5000, *["some text here"] * 30])) + [(3, "a repeated id"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as sequence_id").repartition(3)
    assert checked(pack_documents(docs, BYTE).collect(), texts) == 0
    assert pack_documents(docs.where("false"), BYTE).count() == 0


def test_small_pools_carry_on(spark):
    texts = [(i, "the cat sat " * (i % 97)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert checked(pack_documents(docs, BYTE, Limits(pool=16)).collect(), texts) == 0


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert checked(op1_packing(spark, "/root/testdata/sf0.001").collect(), texts) == 0


def test_the_loss_limit_binds(spark):
    """Turns of instruction data: the answers bear loss, and few of their tokens fit a sequence."""
    rng = np.random.default_rng(2)
    texts, parts = [], []
    for i in range(200):
        question, answer = "why is it so " * int(rng.integers(1, 30)), "that is how it is. " * int(rng.integers(0, 12))
        texts.append((i, question + answer))
        parts.append(None if i % 50 == 7 else [(len(question), len(question) + len(answer)), (3, None)])
    schema = "doc_id long, text string, answers array<struct<start:int,end:int>>"
    docs = spark.createDataFrame([(*t, p) for t, p in zip(texts, parts)], schema).repartition(2)
    rows = pack_documents(docs, BYTE, Limits(128, 6, 20, 64), loss="answers").collect()
    checked(rows, texts)
    bears = {}
    for (i, t), p in zip(texts, parts):
        encoded = library[BYTE].encode(t, add_special_tokens=False)
        inside = [p is None or any(b is not None and a <= x < b for a, b in p) for x, _ in encoded.offsets]
        bears[i] = [*inside, p is None]
    sums, sizes, segments = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        assert r.loss_tokens == sum(bears[r.doc_id][r.start + 1 : r.start + r.length])
        sums[r.sequence_id] += r.loss_tokens
        sizes[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
    assert max(sums.values()) <= 20 and max(sizes.values()) <= 128 and max(segments.values()) <= 6
    assert sum(n >= 15 and sizes[s] < 128 and segments[s] < 6 for s, n in sums.items()) > 10  # it is what stops some
    assert sum(sizes[s] == 128 for s in sums) > 10  # and tokens stop others


@pytest.mark.parametrize("limits", [{"tokens": 0}, {"segments": 0}, {"loss_tokens": 0}, {"pool": -1}])
def test_limits_below_one_are_an_error(limits):
    with pytest.raises(ValueError, match="1 at least"):
        Limits(**limits)
