import re

from skein.llm.url_filter import RULES, DigestArray, UrlRule, judge, op6_url_filter, save


def plain(url, rules=RULES, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


URLS = [None, "", "net/", "http://net", "http://net/", "x://A.Example.NET/en/1", "x://example.net/en", "x://badexample.com/de/", "x://example.com/de/#a/b?c", "x://a.org/fr/x?y", "x://org?/fr/", "://org/fr/", "http://é.NET/\nq", "http://u:p@b.net:80/", "a://b://c.net/x", "x://.net/", "x://net./", "http://" + "a." * 5000 + "net/" + "p" * 100_000]


def test_hard_rows(spark):
    rows = list(enumerate(URLS)) + [(3, "http://net"), (None, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    assert sorted(map(str, (tuple(r) for r in judge(pages).collect()))) == sorted(str((p, *plain(u))) for p, u in rows)
    assert judge(pages.where("false")).count() == 0
    assert {r.verdict for r in judge(pages, [], "block").collect()} == {"block"}


def test_other_rules(spark):
    rules = [UrlRule("block", f"h{i}.com", f"/p{i}") for i in range(500)] + [UrlRule("allow", "h7.com", "/p7/ok"), UrlRule("allow", "h7.com", "/p7")]
    urls = [f"http://w.h{i}.com/p{i}{s}" for i in range(0, 600, 7) for s in ("", "/ok", "x")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    last = {(r.host, r.path): r for r in rules}
    assert sorted(tuple(r)[1:] for r in judge(pages, rules).select("page_id", "host", "path", "verdict").collect()) == sorted((plain(u, last.values())[i] for i in (0, 1, 3)) and (plain(u, last.values())[0], plain(u, last.values())[1], plain(u, last.values())[3]) for u in urls)


def test_colliding_digests(tmp_path):
    clash = lambda s: len(s)
    save([UrlRule("block", "ab", "/"), UrlRule("allow", "cd", "/"), UrlRule("block", "x", "/")], str(tmp_path / "f"), clash)
    held = DigestArray(str(tmp_path / "f"), clash)
    found = held.find([b"cd/", b"ab/", b"zz/", b"x/", b"longer"])
    assert found[2] == found[4] == -1 and [int(held.blocks[i]) for i in found[[0, 1, 3]]] == [0, 1, 1]


def test_whole_table(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert sorted(tuple(r) for r in op6_url_filter(spark, "/root/testdata/sf0.01").collect() if r.rule) == sorted((p, *plain(u)) for p, u in rows if plain(u)[2])
