"""The log tail: growing, cut off, renamed and recreated files, restarts, bounded batches."""

import os

import pytest

from skein.operators.store import read_lines
from skein.sources.progress import shares
from skein.sources.tail import Reader, tail
from skein.streaming.ingest import LATE, drained, start_raw
from skein.streaming.late import fold


class Follow:
    """A stored tail below a folder, stopped and started over."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.root, self.how = spark, tmp_path, how
        self.out, self.bad = str(tmp_path / "out"), str(tmp_path / "bad")

    def put(self, name, text, mode="a"):
        path = self.root / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, mode, newline="") as f:
            f.write(text)

    def take(self, block=None, then=None):
        lines = tail(self.spark, str(self.root / "logs"), str(self.root / "progress"), **self.how)
        drained(start_raw(lines, self.out, self.bad, str(self.root / "cp"), "tail", block=block, then=then, every="0 seconds"))

    def lines(self):
        rows = read_lines(self.spark, self.out).orderBy("seq").collect()
        assert len({r.seq for r in rows}) == len(rows)
        return [(r.index_identifier, r.message) for r in rows]


def line(second, text):
    return f"2024-01-01T00:{second // 60:02}:{second % 60:02}Z {text}\n"


def test_lines_come_once_whatever_becomes_of_the_files(spark, tmp_path):
    f = Follow(spark, tmp_path)
    f.put("a/0.log", line(1, "one") + line(2, "two") + "2024-01-01T00:00:03Z three, not")
    f.put("b/0.log", line(1, "x\r"))
    f.take()
    assert f.lines() == [("a", "one"), ("a", "two"), ("b", "x")]
    f.put("a/0.log", " yet\n" + line(4, "four"))  # appended
    f.put("a/1.log", line(5, "five"))  # a new file
    f.put("c/0.log", line(1, ""))  # a new pod
    f.take()
    got = f.lines()
    assert sorted(got[3:]) == [("a", "five"), ("a", "four"), ("a", "three, not yet"), ("c", "")] and got.index(("a", "three, not yet")) < got.index(("a", "four")) < got.index(("a", "five"))
    f.put("b/0.log", line(9, "y"), "w")  # created anew
    f.put("a/1.log", line(5, "5"), "w")  # cut off
    os.rename(tmp_path / "logs/a/0.log", tmp_path / "logs/a/0.log.old")  # rotated
    f.put("a/0.log.old", line(6, "last of the old"))
    f.put("a/0.log", line(7, "first of the new"))
    f.take()
    assert sorted(f.lines()[7:]) == [("a", "5"), ("a", "first of the new"), ("a", "last of the old"), ("b", "y")]
    f.take()
    assert len(f.lines()) == 11 and spark.read.parquet(f.bad).count() == 0


def test_a_repeated_batch_gets_its_numbers_again(spark, tmp_path):
    f = Follow(spark, tmp_path, max_bytes=400)
    f.put("a/0.log", "".join(line(i, f"line {i}") for i in range(30)))
    seen = []

    def fail(batch, number):
        seen.append(sorted((r.seq, r.message) for r in batch.collect()))
        if len(seen) == 2:
            raise ValueError("stopped")

    with pytest.raises(Exception, match="stopped"):
        f.take(then=fail)
    f.put("a/0.log", line(30, "line 30"))
    f.take(then=fail)
    assert seen[1] == seen[2] and len(seen) == 4
    assert f.lines() == [("a", f"line {i}") for i in range(31)]
    assert [r.seq for r in read_lines(spark, f.out).orderBy("seq").collect()] == list(range(31))


def test_late_lines_are_dropped_over_batches_and_restarts(spark, tmp_path):
    f = Follow(spark, tmp_path, max_bytes=3000)
    times = [(i * 37) % 97 + i // 3 for i in range(400)]
    want = [f"n{i}" for i, ok in enumerate(fold([t * 1000 for t in times], 0, 0, 64)[0]) if ok]
    f.put("a/0.log", "".join(line(t, f"n{i}") for i, t in enumerate(times[:250])))
    f.take(block=64)
    f.put("a/0.log", "no time\n" + "".join(line(t, f"n{250 + i}") for i, t in enumerate(times[250:])))
    f.take(block=64)
    assert [m for _, m in f.lines()] == want
    bad = spark.read.parquet(f.bad).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in bad} == {LATE: 400 - len(want), "no time before the text": 1}


def test_numbers_are_unique_over_many_parts(spark, tmp_path):
    f = Follow(spark, tmp_path, split_bytes=100)
    for b in range(2):
        f.put("a/0.log", "".join(line(i, f"{b} {i} {'x' * (i % 90)}") for i in range(300)))
        f.take()
    assert f.lines() == [("a", f"{b} {i} {'x' * (i % 90)}") for b in range(2) for i in range(300)]


def test_lost_bytes_are_an_error_or_left_out(spark, tmp_path):
    f = Follow(spark, tmp_path)
    f.put("a/0.log", line(1, "one"))
    reader = lambda strict: Reader({"path": str(tmp_path / "logs"), "progress": str(tmp_path / "p"), "max_bytes": "1000", "split_bytes": "1000", "fail_on_loss": strict})
    first = reader("true")
    end = first.latestOffset()
    (part,) = first.partitions(first.initialOffset(), end)
    f.put("a/0.log", line(2, "another"), "w")
    with pytest.raises(ValueError, match="are gone"):
        list(first.read(part))
    assert list(reader("false").read(part)) == []


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_parts_share_lines_out(tmp_path, split):
    texts = ["", "a", "bb" * 40, "ü" * 9, "", "end" * 100]
    (tmp_path / "logs" / "k=a").mkdir(parents=True)
    (tmp_path / "logs" / "k=a" / "0.log").write_text("\n".join(texts) + "\nrest")
    reader = Reader({"path": str(tmp_path / "logs"), "progress": str(tmp_path / "p"), "max_bytes": "100000", "split_bytes": str(split), "fail_on_loss": "true"})
    rows = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in rows] == texts and {r["index_identifier"] for r in rows} == {"a"}
    assert sorted((r["part"], r["line"]) for r in rows) == [(r["part"], r["line"]) for r in rows] and len({(r["part"], r["line"]) for r in rows}) == len(rows)


def test_a_step_is_shared_among_pods(tmp_path):
    assert shares({"a": 1000, "b": 10, "c": 500}, 300) == {"b": 10, "c": 145, "a": 145}
    for pod, n in (("a", 100), ("b", 1)):
        (tmp_path / "logs" / pod).mkdir(parents=True)
        (tmp_path / "logs" / pod / "0.log").write_text("0123456789\n" * n + "x" * 200 + "\n")
    reader = Reader({"path": str(tmp_path / "logs"), "progress": str(tmp_path / "p"), "max_bytes": "100", "split_bytes": "1000", "fail_on_loss": "true"})
    steps = [{f["path"]: f["at"] for f in reader.latestOffset()["files"].values()} for _ in range(3)]
    assert steps[0] == {"a/0.log": 44, "b/0.log": 11}
    assert steps[1]["b/0.log"] == 11 + 201 and steps[2]["b/0.log"] == 212 and steps[2]["a/0.log"] > steps[1]["a/0.log"]  # a long line comes whole


def test_files_of_a_pod_follow_each_other_over_steps(spark, tmp_path):
    f = Follow(spark, tmp_path, max_bytes=100)
    want = [f"file {k} line {i} {'x' * 30}" for k in range(3) for i in range(3)]
    for k in range(3):  # of each file a step takes one line; the rest of the step is too small for another file's line
        f.put(f"a/{k}.log", "".join(line(3 * k + i, want[3 * k + i]) for i in range(3)))
    f.take(block=64)
    assert [m for _, m in f.lines()] == want and spark.read.parquet(f.bad).count() == 0


def test_a_line_without_an_end_holds_no_other_file_up(tmp_path):
    (tmp_path / "logs" / "a").mkdir(parents=True)
    (tmp_path / "logs" / "a" / "0.log").write_text("first\n" + "x" * 300)
    (tmp_path / "logs" / "a" / "1.log").write_text("second\n")
    reader = Reader({"path": str(tmp_path / "logs"), "progress": str(tmp_path / "p"), "max_bytes": "100", "split_bytes": "1000", "fail_on_loss": "true"})
    steps = [{f["path"]: f["at"] for f in reader.latestOffset()["files"].values()} for _ in range(3)]
    assert steps == [{"a/0.log": 6, "a/1.log": 0}, {"a/0.log": 6, "a/1.log": 7}, {"a/0.log": 6, "a/1.log": 7}]
