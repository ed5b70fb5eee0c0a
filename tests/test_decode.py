import json

from skein.sources.decode import decode_lines, decode_records

FLAT = {"@timestamp": "2024-01-02T03:04:05.678Z", "log.level": "INFO", "process.thread.name": "main", "service.name": "s", "log.logger": "l", "message": "m"}
NESTED = {"@timestamp": "2024-01-02T03:04:05Z", "log": {"level": "WARN", "logger": "l"}, "process": {"pid": 3, "thread": {"name": "t"}}, "service": {"name": "s", "version": "2", "node": {"x": "y"}}, "message": "n", "error": {"message": "e", "stack_trace": "st"}}
T = "2024-01-01T00:00:00.123456789Z"


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


def test_lines(spark):
    raw = [
        f"{T} {json.dumps(FLAT)}", f"{T} {json.dumps(NESTED)}", f"{T} {json.dumps(FLAT | {'other': 1, 'service.version': '9', 'request.id': 'r'})}",
        f"{T} {json.dumps(without(FLAT, 'log.logger'))}", f"{T} {json.dumps(FLAT | {'log.level': 'TRACE'})}", f"{T} {json.dumps(FLAT | {'log.level': 'info'})}", f"{T} {json.dumps(FLAT | {'message': None})}",
        f"{T} plain text", "notatime plain text", T, "", "2024-01-01 bare date", f"{T} {json.dumps(without(NESTED, 'message'))}", f"{T} {{broken",
    ]
    lines = spark.createDataFrame(list(enumerate(raw)), "seq long, value string")
    got = {r.seq: r for r in decode_lines(lines).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 13]
    assert got[0].level == "INFO" and got[0].timestamp_ms == 1704164645678 and got[0].service_version == "" and got[0].correlation_id is None
    assert got[1].level == "WARN" and got[1].timestamp_ms == 1704164645000 and got[1].stacktrace == "st" and got[1].thread_name == "t"
    assert got[2].service_version == "9" and got[2].request_id == "r"
    for k in (3, 4, 5, 6, 7, 12, 13):
        assert got[k].level == "UNKNOWN" and got[k].timestamp_ms == 1704067200123 and got[k].thread_name == "" and got[k].message == raw[k].split(" ", 1)[1]
    assert got[9].message == ""


def test_records(spark):
    h = lambda *pairs: [(k, v.encode() if v is not None else None) for k, v in pairs]
    rows = [(b"k", b"v", "t", 1, 5, h(("X-Correlation-Id", "a"), ("x", None), ("X-Correlation-Id", "b"))), (None, b"{}", "t", 0, 6, None)]
    schema = "key binary, value binary, topic string, partition int, offset long, headers array<struct<key:string,value:binary>>"
    records = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_millis(7) as timestamp")
    a, b = decode_records(records).orderBy("offset").collect()
    assert (a.headers, a.correlation_id, a.request_id, a.composite_event_id, a.index_identifier) == ("X-Correlation-Id : a | x : null | X-Correlation-Id : b", "b", None, "t#1#5", "t#1")
    assert (b.key, b.message, b.headers, b.timestamp_ms, b.level) == (None, "{}", "", 7, "KAFKA")
