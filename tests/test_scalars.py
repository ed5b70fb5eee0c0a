import duckdb
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import histogram, search, selection
from skein.plans.catalog import ORACLES, QUERIES
from skein.sources import fixtures

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_numbers(spark):
    power = [one(spark, x=scalars.next_power_of_two(F.lit(n)))["x"] for n in (1, 2, 3, 10, 1000)]
    assert power == [1, 2, 4, 16, 1024]
    ends = [-(2**63), 2**63 - 1, 0, -1, 1]
    rows = spark.createDataFrame([(x,) for x in ends], "x long").select("x", scalars.zigzag(F.col("x")).alias("z"))
    got = rows.select("x", "z", scalars.unzigzag(F.col("z")).alias("back")).collect()
    assert [r.back for r in got] == ends and [r.z for r in got[2:]] == [0, 1, 2]
    assert one(spark, d=scalars.density(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))))["d"] == 0.5
    assert one(spark, a=scalars.round_to(F.lit(-17), F.lit(5)), b=scalars.round_to(F.lit(3), F.lit(0)), c=scalars.byte_unit(F.lit(1023)), d=scalars.byte_unit(F.lit(1536))) == {"a": 15, "b": 0, "c": "1023 B", "d": "1.50 KB"}


def test_times(spark):
    cases = {"2024-01-02T03:04:05Z": 1704164645000, "2024-01-02T03:04:05.1239Z": 1704164645123, "2024-01-02T04:04:05+01:00": 1704164645000, "2024-01-02": None, "": None, "x": None, "2024-13-02T03:04:05Z": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(scalars.iso_millis(F.col("t")).alias("ms")).collect()
    assert [r.ms for r in rows] == list(cases.values())
    assert one(spark, a=scalars.millis_iso(F.lit(1704164645123)), b=scalars.millis_iso(F.lit(0))) == {"a": "2024-01-02T03:04:05.123Z", "b": "1970-01-01T00:00:00Z"}


def test_words(spark):
    text = 'a="key: value" [x]'
    got = [one(spark, w=scalars.word_at(F.lit(text), F.lit(i)))["w"] for i in (0, 2, 3, 5, 9, 17, 18, 99, -1)]
    assert got == ["a=", None, "key", "key", "value", None, None, None, None]
    assert one(spark, w=scalars.word_at(F.lit("last"), F.lit(4)))["w"] == "last"
    assert one(spark, t=scalars.after_last_colon(F.lit("r:5/a:1")), u=scalars.after_last_colon(F.lit("plain"))) == {"t": "1", "u": "plain"}


def test_grams_lose_nothing(spark):
    lines = search.with_grams(fixtures.log_lines(spark, SF)).persist()
    for q in ("error", "failure code 9", '"user 7" pod-2', "up", "1.0", "svc-CLICK", ""):
        direct = {r.seq for r in search.matches(lines, q, None).collect()}
        assert {r.seq for r in search.matches(search.gram_candidates(lines, q), q, None).collect()} == direct
    every = lines.orderBy("seq").limit(20).collect()
    for r in every:  # a line is found by its own text
        assert r.seq in {x.seq for x in search.matches(search.gram_candidates(lines, f'"{r.message}"'), f'"{r.message}"', None).collect()}
    lines.unpersist()


def test_pages_are_top_k(spark):
    plan = search.search(fixtures.log_lines(spark, SF), "error", offset=10, limit=20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz" in plan


def test_charts_of_few_lines(spark):
    lines = fixtures.log_lines(spark, SF)
    assert histogram.histogram(lines.where("false"), 5).count() == 0 == histogram.dense(lines.where("false"), 5).count()
    single = lines.where("seq = 1")
    assert [tuple(r) for r in histogram.histogram(single, 5).select("bin", "n").collect()] == [(0, 1)]
    assert histogram.header(single).first().seconds == 1 and histogram.dense(single, 0).count() == 1
    assert [histogram.next_scale(*x) for x in ((10, 0), (14, 10), (16, 10), (4, 10), (3, 10))] == [10, 10, 16, 10, 3]


def test_selection_state(spark):
    items = spark.createDataFrame([("aa", True), ("ab", False), ("b", True)], "name string, selected boolean")
    on = {r.name: r.selected for r in selection.toggled_all(items, "A").collect()}
    assert on == {"aa": True, "ab": True, "b": True}
    assert {r.selected for r in selection.cleared(items).collect()} == {False}
    assert {r.name for r in selection.picked(items, "B").collect()} == {"ab", "b"}


def test_grams_are_slices_of_the_squeezed_text(spark):
    texts = ["", "a", "Ab", "a-b c", "Füße, 12 ÄÖ", "x\U0001d400\U0001d401y z\U00010400", "the the the cat", "日本語テキスト", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.grams(F.col("t")).alias("g")).collect()
    for r in rows:
        s = "".join(c for c in (r.t or "").lower() if c.isalpha() or c.isdecimal())
        want = [] if not s else [s] if len(s) < 3 else list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
        assert (r.g or []) == want, r.t


def test_sizes_of_more_than_64_bits(spark, tmp_path):
    keys = [0, 1, 10, 11, 101, 1023, 10_321, 2_097_151, 2_097_152, 8_999_999, 1 << 31, 3_000_000_000]
    rows = [(k, k % 11) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["round_format"](spark, str(tmp_path)).select("o_orderkey", "dotted", "size", "rounded").collect()
    db = duckdb.connect()
    db.sql(f"CREATE TABLE orders AS SELECT * FROM (VALUES {', '.join(f'({k}::HUGEINT, {c})' for k, c in rows)}) t(o_orderkey, o_custkey)")
    want = db.sql(f"SELECT o_orderkey, dotted, size, rounded FROM ({ORACLES['round_format']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and ("71.270.992.081", "663021416.59 TB") in {tuple(r[1:3]) for r in got}
