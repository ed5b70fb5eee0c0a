"""Record files of message-queue partitions, as a streaming source with start, seek and bounded steps.

The files are Parquet, in folders ``topic=T/partition=P``, with offset, timestamp_ms, key, value and headers;
offsets ascend within a file and from file to file, and files are only ever added. What the footers say
about offsets and times decides which files a step reads.

A partition begins at the first record not older than ``since_ms``, or, where there is none, at its end;
without ``since_ms`` at 0. One that appears later begins at its first record. ``seek`` moves partitions to
offsets, once for each different value. A step takes at most ``max_records``, shared among the partitions. An
offset says, for each partition, where the range began that was last sought, and how far it has been read, so
that a batch that is repeated reads what it read before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skein.sources.progress import Progress, files, opened, shares

FORMAT = "skein_records"
SCHEMA = "topic string, partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>"
_HEADERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))
_OWN = {"offset": pa.int64(), "timestamp_ms": pa.int64(), "key": pa.binary(), "value": pa.binary(), "headers": _HEADERS}


class Range(InputPartition):
    """Records of a file with offsets in [start, end)."""

    def __init__(self, name: str, path: str, start: int, end: int):
        super().__init__(name)
        self.name, self.path, self.start, self.end = name, path, start, end


def _place(path: str) -> tuple[str, str, int] | None:
    """(name, topic, partition) of a file's folder."""
    parts = dict(p.split("=", 1) for p in path.split("/")[:-1] if "=" in p)
    if not {"topic", "partition"} <= parts.keys():
        return None
    topic = unquote(parts["topic"])
    return f"{topic}#{int(parts['partition'])}", topic, int(parts["partition"])


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self._fs, self._root = opened(options["path"].rstrip("/"))
        self._progress, self._most = Progress(options["progress"]), int(options["max_records"])
        self._since = int(options["since_ms"]) if options.get("since_ms") else None
        self._seek: dict[str, int] = json.loads(options["seek"])
        self._last: dict | None = None
        self._known: dict[str, tuple] = {}  # path: ((size, time), first offset, last, newest time)

    def initialOffset(self) -> dict:
        return {"parts": {}, "sought": ""}

    def _spans(self) -> dict[str, list[tuple[int, int, int, str]]]:
        """Of each partition its files in order of offsets: (first, last, newest time, path)."""
        out: dict[str, list[tuple[int, int, int, str]]] = {}
        for path, info in files(self._fs, self._root).items():
            place = _place(path)
            if place is None or not path.endswith(".parquet"):
                continue
            seen = self._known.get(path)
            if seen is None or seen[0] != (info.size, info.mtime_ns):
                seen = self._known[path] = ((info.size, info.mtime_ns), *self._footer(path))
            if seen[1] is not None:
                out.setdefault(place[0], []).append((*seen[1:], path))
        return {name: sorted(spans) for name, spans in out.items()}

    def _footer(self, path: str) -> tuple[int | None, int | None, int | None]:
        with pq.ParquetFile(f"{self._root}/{path}", filesystem=self._fs) as f:
            meta, names = f.metadata, f.schema_arrow.names
            low, high, newest = [], [], []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                offset, time = (group.column(_leaf(group, n)).statistics for n in ("offset", "timestamp_ms"))
                if group.num_rows and not (offset and offset.has_min_max):
                    raise ValueError(f"{path} has no statistics of its offsets ({names})")
                if group.num_rows:
                    low.append(offset.min)
                    high.append(offset.max)
                    newest.append(time.max if time and time.has_min_max else None)
            if not low:
                return None, None, None
            return min(low), max(high), None if None in newest else max(newest)

    def _start(self, spans: list[tuple[int, int, int, str]], first_time: bool) -> int:
        if self._since is None or not first_time:
            return 0
        for first, last, newest, path in spans:
            if newest is None or newest >= self._since:
                table = pq.read_table(f"{self._root}/{path}", columns=["offset", "timestamp_ms"], filesystem=self._fs, partitioning=None)
                late = pc.greater_equal(table["timestamp_ms"], self._since)
                found = pc.min(table["offset"].filter(late)).as_py()
                if found is not None:
                    return found
        return spans[-1][1] + 1

    def latestOffset(self) -> dict:
        if self._last is None:
            self._last = self._progress.load() or self.initialOffset()
        now = self._advanced(self._last)
        if now != self._last:
            self._progress.save(now)
            self._last = now
        return self._last

    def _advanced(self, offset: dict) -> dict:
        spans, parts = self._spans(), dict(offset["parts"])
        for name in sorted(spans.keys() - parts.keys()):
            at = self._start(spans[name], not offset["parts"])
            parts[name] = {"from": at, "at": at, "turn": 0}
        sought = json.dumps(self._seek, sort_keys=True) if self._seek else offset["sought"]
        if sought != offset["sought"]:
            for name, at in self._seek.items():
                turn = parts[name]["turn"] + 1 if name in parts else 0
                parts[name] = {"from": at, "at": at, "turn": turn}
        wants = {n: max(0, s[-1][1] + 1 - parts[n]["at"]) for n, s in spans.items()}
        for name, n in shares(wants, self._most).items():
            if n:
                parts[name] = parts[name] | {"at": parts[name]["at"] + n}
        return {"parts": parts, "sought": sought}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        spans, out = None, []
        for name, e in sorted(end["parts"].items()):
            s = start["parts"].get(name)
            low = s["at"] if s and s["turn"] == e["turn"] else e["from"]
            if low < e["at"]:
                spans = self._spans() if spans is None else spans
                out += [Range(name, path, max(low, first), min(e["at"], last + 1)) for first, last, _, path in spans.get(name, []) if first < e["at"] and last >= low]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        _, topic, number = _place(p.path)
        with pq.ParquetFile(f"{self._root}/{p.path}", filesystem=self._fs) as f:
            groups = []
            for g in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(g)
                s = group.column(_leaf(group, "offset")).statistics
                if group.num_rows and s.min < p.end and s.max >= p.start:
                    groups.append(g)
            names = [n for n in _OWN if n in f.schema_arrow.names]
            for batch in f.iter_batches(5_000, groups, names) if groups else ():
                batch = batch.filter(pc.and_(pc.greater_equal(batch["offset"], p.start), pc.less(batch["offset"], p.end)))
                n = batch.num_rows
                own = {c: batch[c].cast(t) if c in names else pa.nulls(n, t) for c, t in _OWN.items()}
                own["timestamp_ms"] = own["timestamp_ms"].cast(pa.timestamp("ms")).cast(pa.timestamp("us", "UTC"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([topic] * n, pa.string()), pa.array([number] * n, pa.int32()), *own.values()], ["topic", "partition", "offset", "timestamp", "key", "value", "headers"])


def _leaf(group, name: str) -> int:
    return next(i for i in range(group.num_columns) if group.column(i).path_in_schema == name)


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def record_stream(spark: SparkSession, folder: str, progress: str, since_ms: int | None = None, seek: Mapping[str, int] | None = None, max_records: int = 1_000_000) -> DataFrame:
    """A stream of rows like the Kafka source's from the record files below ``folder``. ``progress`` is a folder for this query
    alone; a new checkpoint goes with a new one. ``seek`` maps "topic#partition" to offsets. Gaps in offsets are
    passed over. Files without a folder for topic and partition aren't read, nor are empty ones."""
    spark.dataSource.register(RecordLog)
    options = {"path": folder, "progress": progress, "seek": json.dumps(dict(seek or {})), "max_records": str(max_records), "since_ms": "" if since_ms is None else str(since_ms)}
    return spark.readStream.format(FORMAT).options(**options).load()


def write_records(records: DataFrame, folder: str) -> None:
    """Add ``records``, rows like the Kafka source's, to the record files below ``folder``: each partition's in order, in one
    file or several by ranges of offsets."""
    ordered = records.repartitionByRange("topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset")
    ordered.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp_ms"), "key", "value", "headers").write.mode("append").partitionBy("topic", "partition").parquet(folder)
