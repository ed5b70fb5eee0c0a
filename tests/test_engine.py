import json
import threading
import time

from skein.operators import lag
from skein.operators.store import read_lines
from skein.plans.engine import Engine, History, Superseded
from skein.sources import fixtures
from skein.sources.pods import inventory
from skein.sources.tail import tail
from skein.streaming.ingest import Sources, start_raw

SF = "/root/testdata/sf0.001"


def test_history():
    h = History()
    for q in ("a", "b", "b", "c"):
        h.enter(q)
    assert h.entries == ["a", "b", "c"] and h.back() == "b" and h.back() == "a" and h.back() is None and h.forward() == "b"
    h.enter("d")
    assert h.entries == ["a", "b", "d"] and h.forward() is None


def test_session(spark):
    lines = fixtures.log_lines(spark, SF).unionByName(fixtures.kafka_lines(spark, SF), allowMissingColumns=True)
    e = Engine(lines, lag.lag_rows(fixtures.committed_offsets(spark, SF), fixtures.end_offsets(spark, SF)), inventory(fixtures.pods(spark, SF)))
    e.enter("error")
    first = e.page(30).collect()
    assert len(first) == 30 and e.page(30) is e.page(30)
    assert [r.timestamp_ms for r in first] == sorted((r.timestamp_ms for r in first), reverse=True)
    shown = e.visible(5).collect()
    assert [r.timestamp_ms for r in shown] == sorted(r.timestamp_ms for r in shown)
    e.move(10)
    assert e.offset == 10 and e.as_of is not None
    held = e.as_of
    e.rewind(500)
    assert e.as_of == held - 500 and all(r.seq <= held - 500 for r in e.page(30).collect())
    e.move(-50)
    assert e.offset == 0 and e.as_of is None
    before = e.page(10_000).count()
    for level in ("INFO", "WARN", "DEBUG", "KAFKA"):
        e.toggle_level(level)
    assert {r.level for r in e.page(10_000).collect()} == {"ERROR"} and e.page(10_000).count() <= before
    e.all_levels()
    e.clear("pod-0")
    e.clear_topic("click")
    sources = {r.index_identifier for r in e.lines.select("index_identifier").distinct().collect()}
    assert "pod-0" not in sources and not any(s.startswith("click#") for s in sources) and "pod-1" in sources
    bins = e.chart(8, whole=True).collect()
    assert sum(r.n for r in bins) == e.page(1_000_000).count()
    assert e.drill_down(8).orderBy("bin").first().offset == e.page().count()


def test_requests(spark):
    e = Engine(fixtures.kafka_lines(spark, SF), lag.lag_rows(fixtures.committed_offsets(spark, SF), fixtures.end_offsets(spark, SF)), inventory(fixtures.pods(spark, SF)))
    ask = lambda **r: json.loads(e.request(json.dumps(r)))
    logs = ask(action="search", query="null", length=7)["logs"]
    assert len(logs) == 7 and all("null" in x["search_text"] for x in logs)
    assert ask(action="listTopics")["topics"] == ["click", "error", "purchase", "signup", "view"]
    assert ask(action="listPods", filter="POD-1")["pods"][0]["name"] == "pod-1"
    assert all(x["lag"] > 0 for x in ask(action="listLag", hideZero=True)["lag"])
    assert ask(action="setKafkaDays", days=-3)["kafkaDays"] == 0 and ask(action="ping")["type"] == "welcome"
    assert len(ask(action="listLag", length=3)["lag"]) == 3 and len(ask(action="listPods", length=2, offset=1)["pods"]) == 2
    assert ask(action="refreshLogGroups")["clusters"][0]["n"] > 0 and ask(action="unlistenPod", pod="click#0")["lines"] < 1000


def test_the_newest_search_wins(spark):
    slow = fixtures.log_lines(spark, SF).where("coalesce(reflect('java.lang.Thread', 'sleep', 100L), '') <> 'x'")  # 100 s
    e, ends = Engine(slow), {}

    def look():
        try:
            e.page(5)
        except Superseded:
            ends["slow"] = time.monotonic()

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    time.sleep(3)
    assert thread.is_alive()
    e.lines, e.query = fixtures.log_lines(spark, SF), "error"
    began = time.monotonic()
    rows = e.page(5).collect()
    thread.join(30)
    assert ends["slow"] - began < 1 and len(rows) == 5 and all("error" in r.search_text for r in rows) and e.page(5).collect() == rows


def test_requests_with_odd_lengths(spark):
    e = Engine(fixtures.log_lines(spark, SF))
    e.all_levels()
    ask = lambda **r: json.loads(e.request(json.dumps(r)))["logs"]
    assert ask(action="search", length=-5) == [] and len(ask(action="search")) == 100 and len(ask(action="search", length=10**9)) == 1000


def test_pods_can_be_listened_to(spark, tmp_path):
    (tmp_path / "logs" / "pod-x").mkdir(parents=True)
    (tmp_path / "logs" / "pod-x" / "0.log").write_text("2024-01-01T00:00:00Z hello\n")
    paths = [str(tmp_path / n) for n in ("out", "bad", "cp")]
    e = Engine(fixtures.log_lines(spark, SF), sources=Sources(spark), begin=lambda pod: start_raw(tail(spark, str(tmp_path / "logs"), str(tmp_path / "progress")), *paths, pod))
    ask = lambda **r: json.loads(e.request(json.dumps(r)))
    assert ask(action="listenPod", pod="pod-x")["listened"] == ["pod-x"]
    e.sources._running["pod-x"].processAllAvailable()
    e.replace_lines(read_lines(spark, paths[0]))
    assert [x["message"] for x in ask(action="search", query="hello")["logs"]] == []  # text lines are of an unknown level
    e.all_levels()
    assert e.lines.where("message = 'hello'").count() == 1
    assert ask(action="unlistenPod", pod="pod-x") == {"type": "stats", "lines": 0, "listened": []}
