"""Operator 6: URL filters in a sorted, memory-mapped digest array.

A rule is a host and a path prefix. The list is one file: its strings' xxhash64
keys in order, their offsets, verdicts and the strings. Spark ships the file to
each executor, where workers map it instead of loading it. A url is looked up
under each of its host suffixes and path prefixes that have a length some rule
has; a block of urls is one vectorised binary search, and what it finds is
compared with the stored string, so colliding digests do no harm.
"""

from __future__ import annotations

import os
import string
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str  # from its slash on


# The rules of the query.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def save(rules: Sequence[UrlRule], path: str, digest=xxhash.xxh64_intdigest) -> None:
    """Write the digest array. Of rules for the same host and path the last holds."""
    held = {(r.host + r.path).encode(): r.verdict for r in rules}
    keys = sorted((digest(k), k) for k in held)
    texts = [k for _, k in keys]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<u8") if texts else np.zeros(1, "<u8")
    with open(path, "wb") as f:
        f.write(np.array([len(keys)], "<u8").tobytes())
        f.write(np.array([h for h, _ in keys], "<u8").tobytes())
        f.write(offsets.tobytes())
        f.write(np.array([held[t] == "block" for t in texts], "u1").tobytes())
        f.write(b"".join(texts))


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        self.keys = data[8 : 8 + 8 * n].view("<u8")
        self.offsets = data[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.blocks = data[16 + 16 * n : 16 + 17 * n]
        self.texts = data[16 + 17 * n :]
        self.digest = digest

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The entry of each string, or -1."""
        if not wanted or not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        keys = np.fromiter(map(self.digest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(wanted), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes() == wanted[i]:
                    out[i] = k
                    break
                k += 1
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first "://", up to a slash, question mark, hash or the end; then up to the latter two."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    A rule fits its host and that host's subdomains, if the url's path starts with the
    rule's. The longest rule wins, of two equally long ones that with the longer host.
    Where none fits, the rule is null and the verdict ``default``. A null url, or one
    without "://", has an empty host and path. Repeated rows, and rows without page_id, are
    judged each; very long urls are taken whole. Other columns, whatever their names, are not
    looked at. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="skein-urls-")
    name = f"urls-{uuid.uuid4().hex}.bin"
    save(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    labels = sorted({r.host.count(".") + 1 for r in rules})
    prefixes = sorted({len(r.path) for r in rules})
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            wanted, row = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                parts = host.split(".")
                for n in labels:
                    if n <= len(parts):
                        suffix = ".".join(parts[-n:])
                        for m in prefixes:
                            if m <= len(path):
                                wanted.append((suffix + path[:m]).encode())
                                row.append(i)
            found = held.find(wanted)
            best: dict[int, tuple[int, int, int]] = {}
            for j in np.flatnonzero(found >= 0):
                key = wanted[j]
                best[row[j]] = max(best.get(row[j], (-1, -1, -1)), (len(key), (key + b"/").index(b"/"), int(j)))
            rule = [wanted[best[i][2]].decode() if i in best else None for i in range(len(hosts))]
            verdict = [("block" if held.blocks[found[best[i][2]]] else "allow") if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names)

    host, path = split_url(F.col("url").cast("string"))
    ready = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    return ready.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged."""
    return judge(table(spark, sf_dir, "pages"))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
