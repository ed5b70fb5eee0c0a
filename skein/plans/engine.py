"""One object for a session at the console: search state, history, and JSON requests."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.levels import DEFAULT_LEVELS, LEVELS, toggled
from skein.operators import clusters, histogram, lag, search, selection, store
from skein.streaming.follow import Followed
from skein.streaming.ingest import Sources

T = TypeVar("T")


@dataclass
class History:
    """Queries entered before. A new one replaces what was ahead of the place we are at."""

    entries: list[str] = field(default_factory=list)
    at: int = -1

    def enter(self, text: str) -> None:
        self.entries = self.entries[: self.at + 1]
        if not self.entries or self.entries[-1] != text:
            self.entries.append(text)
        self.at = len(self.entries) - 1

    def back(self) -> str | None:
        if self.at <= 0:
            return None
        self.at -= 1
        return self.entries[self.at]

    def forward(self) -> str | None:
        if self.at >= len(self.entries) - 1:
            return None
        self.at += 1
        return self.entries[self.at]


class Superseded(Exception):
    """A newer search has taken this one's place."""


class Newest:
    """Runs one piece of work at a time: whoever comes later cancels the jobs of who is at it."""

    def __init__(self, spark: SparkSession):
        self._context, self._name = spark.sparkContext, f"skein-{uuid.uuid4().hex}"
        self._lock, self._turn = threading.Lock(), 0

    def run(self, work: Callable[[], T]) -> T:
        with self._lock:
            before, self._turn = self._turn, self._turn + 1
            turn = self._turn
        self._context.cancelJobsWithTag(f"{self._name}-{before}")
        tag = f"{self._name}-{turn}"
        self._context.addJobTag(tag)
        self._context.setInterruptOnCancel(True)
        try:
            result = work()
        except Exception as e:
            if turn != self._turn:
                raise Superseded from e
            raise
        finally:
            self._context.removeJobTag(tag)
        if turn != self._turn:
            raise Superseded
        return result


class Engine:
    """Lines (and, where given, lag rows and pods) with the state of a search over them. With ``sources``
    and ``begin``, which starts the stream of a pod, pods can be listened to. With ``store_path``, where
    the lines are stored, searches open only files that can hold a match, and clearing deletes files.

    Paging away from the newest lines fixes a snapshot: later lines don't shift the pages.
    Going back to offset 0 releases it. A page is kept until anything it depends on changes.
    """

    def __init__(self, lines: DataFrame, lag_rows: DataFrame | None = None, pods: DataFrame | None = None, sources: Sources | None = None, begin: Callable[[str], StreamingQuery] | None = None, followed: Followed | None = None, store_path: str | None = None):
        self.lines, self.lag_rows, self.pods = lines, lag_rows, pods
        self.sources, self.begin = sources, begin
        self.followed, self.store_path = followed, store_path
        self.levels: tuple[str, ...] = DEFAULT_LEVELS
        self.history = History()
        self.query, self.offset, self.as_of = "", 0, None
        self.kafka_days = 1
        self.seconds = 0.0
        self._page: tuple[tuple, DataFrame] | None = None
        self._newest = Newest(lines.sparkSession)

    def replace_lines(self, lines: DataFrame) -> None:
        """Lines have come or gone."""
        self.lines = lines
        self._forget()

    def _forget(self) -> None:
        if self._page is not None:
            self._page[1].unpersist()
        self._page = None

    def toggle_level(self, level: str) -> None:
        self.levels = toggled(self.levels, level)

    def all_levels(self) -> None:
        self.levels = LEVELS

    def clear(self, source: str) -> None:
        if self.store_path is None:
            self.replace_lines(store.clear_source(self.lines, source))
        else:
            store.clear_stored(self.lines.sparkSession, self.store_path, source)
            self.replace_lines(store.read_lines(self.lines.sparkSession, self.store_path))

    def clear_topic(self, topic: str) -> None:
        if self.store_path is None:
            self.replace_lines(store.clear_topic(self.lines, topic))
        else:
            store.clear_stored_topic(self.lines.sparkSession, self.store_path, topic)
            self.replace_lines(store.read_lines(self.lines.sparkSession, self.store_path))

    def enter(self, text: str) -> None:
        self.history.enter(text)
        self.query = text

    def move(self, step: int) -> None:
        """Scroll by ``step`` lines; the first step away from 0 fixes the snapshot."""
        self.offset = search.follow_offset(self.offset, step)
        if self.offset == 0:
            self.as_of = None
        elif self.as_of is None:
            top = self.lines.agg(F.max("seq")).first()[0]
            self.as_of = -1 if top is None else int(top)

    def rewind(self, lines_back: int) -> None:
        """Move the snapshot back (or forward again) by so many lines."""
        top = self.lines.agg(F.max("seq")).first()[0]
        if top is not None:
            self.as_of = max(0, min(int(top), (int(top) if self.as_of is None else self.as_of) - lines_back))

    def page(self, limit: int = search.PAGE) -> DataFrame:
        """The lines at the current place, newest first. Where the search is followed, its newest lines are at hand.
        Of searches from several threads the newest wins: one that is at work is cancelled, and raises Superseded."""
        f = self.followed
        if f is not None and self.offset == 0 and (f.query, f.levels) == (self.query, self.levels) and limit <= f.limit and f.started():
            return f.page().limit(limit)
        key = (self.query, self.levels, self.offset, self.as_of, limit)
        if self._page is None or self._page[0] != key:
            began = time.perf_counter()
            if self.store_path is None:
                fits = search.matches(self.lines, self.query, self.levels, self.as_of)
            else:
                fits = search.stored_matches(self.lines.sparkSession, self.store_path, self.query, self.levels, self.as_of)
            found = search.paged(fits, self.offset, limit).persist()
            try:
                self._newest.run(found.count)
            except Superseded:
                found.unpersist()
                raise
            self._forget()
            self.seconds = time.perf_counter() - began
            self._page = key, found
        return self._page[1]

    def visible(self, length: int) -> DataFrame:
        return search.visible(self.page(), length)

    def chart(self, bins: int, whole: bool = False) -> DataFrame:
        """The histogram of the page, or of all matches."""
        lines = search.matches(self.lines, self.query, self.levels, self.as_of) if whole else self.page()
        return histogram.histogram(lines, bins)

    def drill_down(self, bins: int) -> DataFrame:
        return histogram.drill_down(self.page(), bins, self.offset)

    def request(self, text: str) -> str:
        """The answer, as JSON, to a request in JSON: {"action": ..., ...}."""
        r = json.loads(text)
        action = r.get("action")
        offset, length = max(0, int(r.get("offset", 0))), min(max(0, int(r.get("length", search.PAGE))), search.PAGE)
        page = lambda df: df.offset(offset).limit(length)
        as_json = lambda df: [json.loads(x.j) for x in df.select(F.to_json(F.struct("*")).alias("j")).collect()]  # noqa: E731  a page at most
        if action == "search":
            levels = r.get("levels")
            found = search.search(self.lines, r.get("query", ""), self.levels if levels is None else levels, offset=offset, limit=length if "length" in r else 100)
            return json.dumps({"type": "logs", "logs": as_json(found.orderBy(*search.NEWEST))})
        if action == "listPods" and self.pods is not None:
            shown = selection.picked(self.pods, r.get("filter", "")).orderBy("name")
            return json.dumps({"type": "pods", "pods": as_json(page(shown))})
        if action == "listTopics" and "topic" in self.lines.columns:
            shown = self.lines.where("topic is not null").select("topic").distinct().orderBy("topic")
            return json.dumps({"type": "topics", "topics": [x["topic"] for x in as_json(page(shown))]})
        if action == "listLag" and self.lag_rows is not None:
            shown = lag.lagging(self.lag_rows) if r.get("hideZero") else self.lag_rows
            return json.dumps({"type": "lagInfo", "lag": as_json(page(shown.orderBy("group_id", "topic", "partition")))})
        if action == "refreshLogGroups":
            return json.dumps({"type": "logClusters", "clusters": as_json(page(clusters.clusters(self.lines)))})
        if action == "setKafkaDays":
            self.kafka_days = max(0, int(r.get("days", 1)))
            return json.dumps({"type": "stats", "kafkaDays": self.kafka_days})
        if action in ("listenPod", "unlistenPod"):
            pod = r["pod"]
            if action == "listenPod" and self.sources is not None and self.begin is not None:
                self.sources.start(pod, lambda: self.begin(pod))
            if action == "unlistenPod":
                if self.sources is not None:
                    self.sources.stop(pod)
                self.clear(pod)
            listened = self.sources.names() if self.sources is not None else []
            return json.dumps({"type": "stats", "lines": self.lines.count(), "listened": listened})
        if action == "ping":
            return json.dumps({"type": "welcome"})
        raise ValueError(f"no action {action!r}")
