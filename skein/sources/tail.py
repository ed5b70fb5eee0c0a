"""Log files that grow, as a streaming source.

A file is known by what it begins with, not only by its name, and read by bytes: an offset holds,
for each file, how far it has been read and a hash of its first bytes. So appended lines come once;
a file that was cut off or created anew begins again at 0; one that was renamed (rotated) goes on
where it was. Lines count once their line end is there.

Each step takes at most ``max_bytes``, shared among the folders (a folder a pod) that have
something new, so none waits for a busy one; of a folder, files come in the order in which they
were found. Large files are read in parts of ``split_bytes``, each by its own task, in order.

What was offered last is kept in ``progress``, a folder of the query's own (see ``progress.Progress``).

Files are opened through pyarrow, by driver and executors: a path of one machine, or a URI of a
store that all machines share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skein.sources.progress import Progress, files, opened, shares

FORMAT = "skein_log_tail"
HEAD = 256
CHUNK = 1 << 20
SCHEMA = "value string, index_identifier string, file string, position long, part int, line long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pod_of(path: str) -> str:
    """The folder's name; of a partition's folder (key=value) the value."""
    return path.rsplit("/", 2)[-2].rpartition("=")[2] if "/" in path else ""


class Part(InputPartition):
    """Lines of a file that begin in [start, end), a part of what is to be read, [first, last)."""

    def __init__(self, number: int, path: str, first: int, start: int, end: int, last: int, head: str, n: int):
        super().__init__(number)
        self.number, self.path, self.first, self.start, self.end, self.last, self.head, self.n = number, path, first, start, end, last, head, n


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self._progress = Progress(options["progress"])
        self._most, self._split = int(options["max_bytes"]), int(options["split_bytes"])
        self._lenient = options["fail_on_loss"] == "false"
        self._fs, self._root = opened(options["path"].rstrip("/"))
        self._last: dict | None = None
        self._seen: dict[str, tuple] = {}  # files with nothing new, by size and time

    # --- offsets ---

    def initialOffset(self) -> dict:
        return {"files": {}, "next": 0}

    def latestOffset(self) -> dict:
        if self._last is None:
            self._last = self._progress.load() or self.initialOffset()
        now = self._advanced(self._last)
        if now != self._last:
            self._progress.save(now)
            self._last = now
        return self._last

    def _bytes(self, path: str, start: int, end: int) -> bytes:
        with self._fs.open_input_file(f"{self._root}/{path}") as f:
            return f.read_at(max(0, end - start), start)

    def _head(self, path: str, n: int) -> str:
        return md5(self._bytes(path, 0, n)).hexdigest() if n else ""

    def _advanced(self, offset: dict) -> dict:
        found, known, following = {p: f for p, f in files(self._fs, self._root).items() if not p.endswith(".gz")}, {}, offset["next"]
        lost = []
        for number, e in offset["files"].items():
            info = found.get(e["path"])
            stays = info is not None and info.size >= e["at"] and (self._seen.get(e["path"]) == (info.size, info.mtime_ns) or self._head(e["path"], e["n"]) == e["head"])
            if stays:
                known[number] = e
            else:
                lost.append((number, e))
                self._seen.pop(e["path"], None)
        taken = {e["path"] for e in known.values()}
        for path in found:
            if path in taken:
                continue
            moved = next(((k, e) for k, e in lost if e["n"] and found[path].size >= e["at"] and self._head(path, e["n"]) == e["head"]), None)
            if moved:  # a rotated file
                lost.remove(moved)
                known[moved[0]] = moved[1] | {"path": path}
            else:
                known[str(following)] = {"path": path, "at": 0, "head": "", "n": 0}
                following += 1
        news = {k: found[e["path"]].size - e["at"] for k, e in known.items() if self._seen.get(e["path"]) != (found[e["path"]].size, found[e["path"]].mtime_ns)}
        wants: dict[str, int] = {}
        for k, n in news.items():
            pod = pod_of("/" + known[k]["path"])
            wants[pod] = wants.get(pod, 0) + n
        left = shares(wants, self._most)
        for k in sorted(news, key=int):
            e, info = known[k], found[known[k]["path"]]
            pod = pod_of("/" + e["path"])
            if news[k] and left[pod] <= 0:
                continue
            limit = min(info.size, e["at"] + left[pod])
            end = self._line_end(e["path"], e["at"], limit, info.size)
            if limit == info.size:
                self._seen[e["path"]] = (info.size, info.mtime_ns)
            if end > e["at"]:
                n = max(e["n"], min(HEAD, end))
                known[k] = {"path": e["path"], "at": end, "head": e["head"] if n == e["n"] else self._head(e["path"], n), "n": n}
                # the rest of a file that the share cuts off comes before the folder's next files
                left[pod] = 0 if limit < info.size else left[pod] - (end - e["at"])
        return {"files": known, "next": following}

    def _line_end(self, path: str, start: int, limit: int, size: int) -> int:
        """Behind the last line end before ``limit``; where a line is longer, behind its own; ``start`` where there is none."""
        with self._fs.open_input_file(f"{self._root}/{path}") as f:
            at = limit
            while at > start:
                low = max(start, at - CHUNK)
                k = f.read_at(at - low, low).rfind(b"\n")
                if k >= 0:
                    return low + k + 1
                at = low
            at = limit
            while at < size:
                k = f.read_at(min(CHUNK, size - at), at).find(b"\n")
                if k >= 0:
                    return at + k + 1
                at += CHUNK
        return start

    # --- reading ---

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts: list[Part] = []
        order = sorted(end["files"].items(), key=lambda x: (pod_of("/" + x[1]["path"]), int(x[0])))
        for number, e in order:
            first, last = start["files"].get(number, {"at": 0})["at"], e["at"]
            for at in range(first, last, self._split):
                parts.append(Part(len(parts), e["path"], first, at, min(last, at + self._split), last, e["head"], e["n"]))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        p, pod = partition, pod_of("/" + partition.path)
        try:
            f = self._fs.open_input_file(f"{self._root}/{p.path}")
        except FileNotFoundError:
            f = None
        if f is None or f.size() < p.last or md5(f.read_at(p.n, 0)).hexdigest() != p.head:
            if self._lenient:
                return
            raise ValueError(f"bytes {p.first} to {p.last} of {p.path} are gone; fail_on_loss=False goes on without them")
        with f:
            at = p.start if p.start == p.first else self._next_line(f, p.start - 1, p.last)
            parts: list[bytes] = []
            read_to, line = at, 0
            while at < p.end:
                chunk = f.read_at(min(CHUNK, p.last - read_to), read_to)
                read_to += len(chunk)
                cut = chunk.rfind(b"\n") + 1
                if not cut:
                    if not chunk:
                        raise ValueError(f"{p.path} ends within a line")
                    parts.append(chunk)
                    continue
                lines = (b"".join(parts) + chunk[:cut]).split(b"\n")[:-1]
                parts = [chunk[cut:]]
                places = []
                for text in lines:
                    if at >= p.end:
                        break
                    places.append(at)
                    at += len(text) + 1
                n = len(places)
                texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:n]]
                columns = [pa.array(texts, pa.string()), *(pa.array([x] * n, pa.string()) for x in (pod, p.path)), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p.number] * n, pa.int32()), pa.array(range(line, line + n), pa.int64())], _NAMES)
                line += n

    @staticmethod
    def _next_line(f, at: int, last: int) -> int:
        while at < last:
            chunk = f.read_at(min(CHUNK, last - at), at)
            k = chunk.find(b"\n")
            if k >= 0:
                return at + k + 1
            at += len(chunk)
        return last


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def tail(spark: SparkSession, folder: str, progress: str, max_bytes: int = 1 << 30, split_bytes: int = 64 << 20, fail_on_loss: bool = True) -> DataFrame:
    """A stream of (value, index_identifier, file, position, part, line): the lines of the files below ``folder``, a folder a pod, as
    they are appended; new pods and files are found as they come, packed ones (.gz) are not read.

    Within a batch, ``part`` and ``line`` number the parts read and the lines of each, in order; they are
    the same where a batch is repeated. ``progress`` is a folder for this query alone; with a new checkpoint goes a new one, else all that
    was read before comes in one batch. Bytes that were planned and are gone when they are read are an error, unless ``fail_on_loss`` is False.
    A line without an end waits for it. Bytes that aren't UTF-8 become U+FFFD. A file that is created anew with
    the same first 256 bytes, and no shorter, can't be told from one that has grown.
    """
    spark.dataSource.register(LogTail)
    options = {"path": folder, "progress": progress, "max_bytes": str(max_bytes), "split_bytes": str(split_bytes), "fail_on_loss": str(fail_on_loss).lower()}
    return spark.readStream.format(FORMAT).options(**options).load()
