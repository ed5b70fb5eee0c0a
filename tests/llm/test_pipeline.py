import corpus_pipeline
from skein.llm.simhash import deduplicate


def test_stages_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held, sizes = docs, [len(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.written(stage(spark, held, sf), name)
        assert held.columns == docs.columns
        sizes.append(held.count())
    left = {r.doc_id: r.text for r in held.collect()}
    assert len(left) == sizes[-1] and sizes[1] >= 0.98 * sizes[0]
    assert sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert len(set(left.values())) == len(left) and not any(i in t for i in items for t in left.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(left)


def test_repeated_rows_leave_one(spark):
    a, b = "one two three four five six " * 9, "seven eight nine ten eleven twelve " * 9
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, a), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' as fingerprint", "0 as component_id")
    got = deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (1, b), (None, a), (None, a), (4, None)]))
    assert deduplicate(docs.where("false")).count() == 0


def test_language_stage_keeps_columns_named_like_its_own(spark):
    rows = [(1, "the cat and the dog " * 30, "en", "mine"), (2, "der hund und die katze " * 30, "de", "yours"), (3, "the dog and the cat " * 30, "en", "ours")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").selectExpr("*", "7 as margin")
    got = corpus_pipeline.language(spark, docs, "").select("doc_id", "score", "margin").collect()
    assert got and all((r.score, r.margin) == ({1: "mine", 2: "yours", 3: "ours"}[r.doc_id], 7) for r in got)


BENCH = "Alle Wege am Fluss sind heute frei. Wir gehen langsam nach Hause und singen dabei ein altes Lied von der See."


def small(spark, tmp_path):
    """A folder with a benchmark, and documents with hard rows and columns named like the operators' own."""
    words = "river stone winter garden letter captain morning window silver forest market island".split()
    text = lambda k, n=60: " ".join(words[(i * (k + 3) + i // (k + 2)) % 12] + str((i * k) % 7) * (i % 5 == 0) for i in range(n))
    rows = [(i, text(i), "en") for i in range(12)] + [(20, text(3), "en"), (20, text(3), "en"), (None, text(5), "en"), (21, None, "en"), (22, "", "de"), (23, "12 -- !", None)]
    rows += [(24, "Der Hund und die Katze laufen am Abend durch den Garten. " * 9, "de"), (25, "Vor dem Haus steht ein Baum, der viele Blätter hat. " * 9 + BENCH, "de")]
    rows += [(26, text(7, 40) + " password = hunter2hunter2x and more " + text(8, 40), "en"), (27, text(11, 60_000), "en")]
    docs = spark.createDataFrame([(*r, f"mine{i}", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, score string, rules int")
    docs = docs.selectExpr("*", "'s' as source", "cast(length(text) as long) as n_chars", "1 as margin", "2 as lang_pred", "'f' as fingerprint", "0 as component_id", "'k' as kind", "7 as item_id", "'i' as ids", "3 as block", "4 as start", "5 as spans")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)


def test_each_stage_on_hard_rows(spark, tmp_path):
    docs, sf = small(spark, tmp_path)
    given = {r.rules: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema["score"].dataType == docs.schema["score"].dataType, name
        rows = out.collect()
        for r in rows:  # all columns but the redacted ones are the row's own
            was = given[r.rules].asDict()
            assert all(r[c] == was[c] for c in docs.columns if name != "secret_scan" or c not in ("text", "n_chars")), name
        left = sorted(r.rules for r in rows)
        assert len(set(left)) == len(left)
        if name == "language_id":
            assert not {15, 16, 17} & set(left)  # null, empty, without a letter
        if name == "simhash_near_dedup":
            assert not {12, 13} & set(left) and 14 in left  # copies of document 3; no doc_id
        if name == "benchmark_decontamination":
            assert left == sorted(set(given) - {19})
        if name == "secret_scan":
            assert left == sorted(given)
            redacted = next(r for r in rows if r.rules == 20)
            assert "hunter2" not in redacted.text and "[SECRET]" in redacted.text and redacted.n_chars == len(redacted.text)
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    pieces = corpus_pipeline.pack(spark, docs, sf)
    assert pieces.count() >= docs.count() and corpus_pipeline.pack(spark, docs.where("false"), sf).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    docs, sf = small(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
    key = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
    whole = corpus_pipeline.run(spark, sf).collect()
    per_document = lambda rows: sorted({(k[0], k[4]) for k in map(key, rows)})
    assert per_document(whole) == per_document(docs.collect()) and whole
    assert {r.doc_id for r in whole} >= {24, 26, 27} and not {r.doc_id for r in whole} & {21, 22, 23, 25}
