import pytest

from skein.operators import codec, display, store
from skein.operators.clusters import clusters
from skein.plans import stream_query
from skein.sources import config, fixtures, kafka
from skein.sources.pods import backfill
from skein.sources.tail import tail
from skein.streaming.ingest import Sources, start, start_raw, start_records
from skein.streaming.late import drop_late, fold

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("encoding", codec.ENCODINGS)
def test_numbers_are_stored_small(spark, tmp_path, encoding):
    rows = spark.range(0, 1_000_000, 10).selectExpr("'k' as key", "id as o", "cast(id div 50000 as long) as v").coalesce(1)
    back = codec.stored(rows, "key", "o", "v", encoding, str(tmp_path / encoding))
    assert back.exceptAll(rows.selectExpr("key", "o as position", "v as value")).count() == 0 and back.count() == 100_000
    size = sum(f.stat().st_size for f in (tmp_path / encoding).glob("*.parquet"))
    assert size < 8 * 100_000 / 2  # two columns of 8 bytes, a quarter of them or less
    assert codec.stored(rows.where("false"), "key", "o", "v", encoding, str(tmp_path / "none")).count() == 0


def test_stored_parts_replace_themselves(spark, tmp_path):
    lines, path = fixtures.log_lines(spark, SF), str(tmp_path / "lines")
    for part in ("a-0", "a-1", "a-1"):
        store.write_lines(lines.where("seq < 100" if part == "a-0" else "seq >= 100"), path, part)
    back = store.read_lines(spark, path)
    assert back.count() == lines.count() and "part" not in back.columns


def test_ranges_change_nothing(spark):
    lines = fixtures.late_arrivals(fixtures.record_times(spark, SF))
    want = {r.seq for r in store.late_dropped(lines, ["topic", "partition"], ["arrival", "seq"]).collect()}
    for shard in (1, 7, 64):
        assert {r.seq for r in store.late_dropped(lines, ["topic", "partition"], ["arrival", "seq"], shard).collect()} == want
    whole = sorted(map(tuple, store.block_numbers(lines, 16).collect()))
    assert whole == sorted(map(tuple, store.block_numbers(lines, 16, 5).collect())) and len(want) < lines.count()


def test_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "lines")
    store.write_lines(fixtures.log_lines(spark, SF), path)
    found = store.read_lines(spark, path).where("level = 'ERROR' and index_identifier = 'pod-1' and seq <= 500")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "PushedFilters: [IsNotNull(seq), LessThanOrEqual(seq,500)]" in plan
    assert found.count() == fixtures.log_lines(spark, SF).where("level = 'ERROR' and index_identifier = 'pod-1' and seq <= 500").count()


def test_late_fold(spark):
    assert fold([5, 4, 5, 6, 1], 0, 0, 3) == ([True, False, True, True, True], 1, 1)
    lines = fixtures.late_arrivals(fixtures.kafka_lines(spark, SF)).select("seq", "timestamp_ms", "index_identifier", "level", "arrival")
    rows = sorted(lines.collect(), key=lambda r: (r.index_identifier, r.arrival, r.seq))
    want = set()
    for name in {r.index_identifier for r in rows}:
        own = [r for r in rows if r.index_identifier == name]
        want |= {r.seq for r, ok in zip(own, fold([r.timestamp_ms for r in own], 0, 0, 16)[0]) if ok}
    assert {r.seq for r in drop_late(lines, ["arrival", "seq"], 16).collect()} == want and len(want) < len(rows)


def test_stream_equals_batch(spark):
    batch = store.late_dropped(fixtures.late_arrivals(fixtures.kafka_lines(spark, SF)), ["topic", "partition"], ["arrival", "seq"])
    assert {r.seq for r in stream_query.stream_late_drop(spark, SF).collect()} == {r.seq for r in batch.collect()}


def test_ingest_stream(spark, tmp_path):
    schema = fixtures.log_lines(spark, SF).schema
    fixtures.log_lines(spark, SF).write.parquet(str(tmp_path / "in"))
    seen, sources = [], Sources(spark)
    begin = lambda: start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "pods", once=True, then=lambda b, n: seen.append(b.count()))
    sources.start("pods", begin)
    sources._running["pods"].awaitTermination()
    assert sum(seen) == 1000 == store.read_lines(spark, str(tmp_path / "out")).count()
    sources.select({})
    assert sources.names() == []


def test_pod_stream_from_files_to_stored_lines(spark, tmp_path):
    logs, out, bad, cp = (str(tmp_path / n) for n in ("logs", "out", "bad", "cp"))
    good = lambda pod, i: f'2024-01-01T00:00:0{i}Z {{"@timestamp": "2024-01-01T00:00:0{i}Z", "log.level": "WARN", "process.thread.name": "t", "service.name": "s", "log.logger": "l", "message": "{pod} {i}"}}'
    write = lambda pod, name, lines: ((tmp_path / "logs" / pod).mkdir(parents=True, exist_ok=True), (tmp_path / "logs" / pod / name).write_text("\n".join(lines) + "\n"))
    write("a", "0.log", [good("a", 0), "no time here", good("a", 1)])
    begin = lambda: start_raw(tail(spark, logs, str(tmp_path / "progress")), out, bad, cp, "pods", once=True)
    begin().awaitTermination()  # what is there comes first
    write("b", "0.log", [good("b", 2), "2024-01-01T00:00:09Z plain text"])
    write("a", "1.log", [good("a", 3)])
    begin().awaitTermination()  # then what has come since, new pods too, and nothing twice
    got = sorted((r.index_identifier, r.level, r.message) for r in store.read_lines(spark, out).collect())
    assert got == [("a", "WARN", "a 0"), ("a", "WARN", "a 1"), ("a", "WARN", "a 3"), ("b", "UNKNOWN", "plain text"), ("b", "WARN", "b 2")]
    assert [(r.value, r.reason) for r in spark.read.parquet(bad).collect()] == [("no time here", "no time before the text")]


def test_record_stream_to_stored_lines(spark, tmp_path):
    records = fixtures.kafka_records(spark, SF)
    records.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    start_records(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "records", once=True, block=None).awaitTermination()
    held = store.read_lines(spark, str(tmp_path / "out"))
    assert held.count() == records.count() == held.select("seq").distinct().count()
    assert {(r.composite_event_id, r.message) for r in held.collect()} == {(r.composite_event_id, r.message) for r in fixtures.kafka_lines(spark, SF).collect()}


def test_failed_sources_begin_again(spark, tmp_path):
    fixtures.log_lines(spark, SF).write.parquet(str(tmp_path / "in"))
    schema, calls, sources = fixtures.log_lines(spark, SF).schema, [], Sources(spark)

    def then(batch, number):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("once")

    sources.start("x", lambda: start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "x", once=True, then=then))
    with pytest.raises(Exception, match="once"):
        sources._running["x"].awaitTermination()
    assert sources.revive(0) == ["x"]
    sources._running["x"].awaitTermination()
    assert store.read_lines(spark, str(tmp_path / "out")).count() == 1000  # the repeated batch replaced itself
    assert sources.revive(0) == []


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.seq for r in stream_query.stream_late_drop(spark, str(tmp_path)).collect()}
    assert got == {r.seq for r in stream_query.stream_late_drop(spark, SF).collect()}


def test_settings(tmp_path):
    path = tmp_path / "conf"
    path.write_text("a=1\nno line\nb=x=y\na=2\n")
    assert config.load(path) == {"a": "2", "b": "x=y"}
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none")


def test_settings_table(spark):
    lines = spark.createDataFrame([(1, "a=1"), (2, "no"), (3, "b=x=y"), (4, "a=2")], "n long, value string")
    assert {tuple(r) for r in config.settings_table(lines, "n").collect()} == {("a", "2"), ("b", "x=y")}


def test_kafka_options():
    o = kafka.stream_options("h:1", ["b", "a", "b"], 5_000)
    assert o["subscribe"] == "a,b" and o["startingTimestamp"] == "5000" and o["startingOffsetsByTimestampStrategy"] == "latest" and "kafka.security.protocol" not in o
    assert kafka.security("u", 'p"')["kafka.sasl.jaas.config"].endswith('password="p\\"";') and kafka.security("  ", "p") == {}
    assert kafka.point_options("h", "t", 2, 7)["endingOffsets"] == '{"t": {"2": 8}}'
    assert kafka.registry("http://r", " ") == {"schema.registry.url": "http://r"} and kafka.registry("http://r", "u", "p")["basic.auth.user.info"] == "u:p"
    assert kafka.start_of(1_000_000_999, 1) == 913_600_000 and kafka.start_of(5_999, -4) == 5_000
    with pytest.raises(ValueError):
        kafka.stream_options("h", [], None)


def test_pod_logs(spark, tmp_path):
    for pod in ("a", "b"):
        (tmp_path / pod).mkdir()
        (tmp_path / pod / "0.log").write_text(f"2024-01-01T00:00:00Z hello {pod}\n")
    assert {tuple(r) for r in backfill(spark, str(tmp_path)).collect()} == {("2024-01-01T00:00:00Z hello a", "a"), ("2024-01-01T00:00:00Z hello b", "b")}


def test_pretty_json():
    assert display.pretty('{"b":1.50,"a":[1,{"c":null}]}') == '{\n    "b": 1.50,\n    "a": [\n        1,\n        {\n            "c": null\n        }\n    ]\n}'
    assert display.pretty("not json") == "not json" and display.pretty(None) is None


def test_clusters(spark):
    rows = [(1, "Error in module A"), (2, "Error in module B"), (3, "User 123 logged in"), (4, "User 456 logged in"), (5, "id 123e4567-e89b-12d3-a456-426614174000 at 0xFF")]
    got = {r.message_pattern: r.n for r in clusters(spark.createDataFrame(rows, "seq long, message string")).collect()}
    assert got["User <num> logged in"] == 2 and got["id <uuid> at <hex>"] == 1 and len(got) == 4


def test_json_parts(spark):
    text = '{"a\\"b": ["x", -1.5e3, true],\n "c": {"d": nul}} "open'
    got = [(r.token, r.kind) for r in display.json_tokens(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("position").collect()]
    assert "".join(t for t, _ in got) == text
    kinds = dict(got)
    assert kinds['"a\\"b"'] == kinds['"c"'] == kinds['"d"'] == "key" and kinds["-1.5e3"] == "number" and kinds["true"] == "literal" and kinds["u"] == "other"
