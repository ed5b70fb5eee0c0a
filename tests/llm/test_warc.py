import gzip
import hashlib

import pytest

from skein.llm.common import fresh_path
from skein.llm.warc import make_record, op9_warc, read, read_records, round_trip, write


def plain(rows):
    owner = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and p is not None:
            owner[data] = max(p, owner.get(data, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        o = owner.get(data)
        again = o is not None and o != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", o if again else None))
    return sorted(map(str, out))


def test_hard_rows(spark):
    big = "é" * 500
    rows = [(1, "http://a/ü x\r\ny", big), (2, None, big), (9, "", big), (9, "", big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (None, "u", big), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (7, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as bytes", "'q' as digest", "2 as owner").repartition(3)
    assert sorted(str(tuple(r)) for r in round_trip(pages).collect()) == plain(rows)
    assert round_trip(pages.where("false")).count() == 0
    path = fresh_path(spark, "warc")
    write(pages, path)
    stored = {r.page_id: r for r in read(spark, path, payloads=True).collect()}
    assert bytes(stored[9].payload).decode() == big and bytes(stored[1].payload) == b"" and bytes(stored[7].payload) == rows[-1][2].encode()
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.content]
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == len(rows)  # any gzip reader takes them


def test_damage_is_noticed():
    html = b"<p>x</p>" * 300
    good = make_record(1, "u", html, len(html), hashlib.sha1(html).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert len(list(read_records(good + b"\x00" + good))) == 2
    wrong = make_record(1, "u", html, len(html), hashlib.sha1(b"").hexdigest(), None, "2024-01-01T00:00:00Z")
    for bad in (good[:-20], wrong, gzip.compress(gzip.decompress(good)[:-4]), gzip.compress(b"WARC/1.1\r\n")):
        with pytest.raises(ValueError):
            list(read_records(bad))


def test_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert sorted(str(tuple(r)) for r in op9_warc(spark, "/root/testdata/sf0.01").collect()) == plain(rows)
