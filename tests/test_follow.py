"""A followed search after each batch, against the search over all that is stored."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.operators import histogram, search
from skein.operators.store import read_lines
from skein.plans.engine import Engine
from skein.sources import fixtures
from skein.streaming.follow import Followed
from skein.streaming.ingest import start

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "levels", "limit", "bins"), [("", None, 30, 16), ("error !worker-1", ("ERROR",), 1000, 3), ("nothing like it", None, 5, 5)])
def test_each_batch_equals_a_full_run(spark, tmp_path, query, levels, limit, bins):
    lines = fixtures.log_lines(spark, SF).persist()
    followed, after = Followed(spark, str(tmp_path / "follow"), query, levels, limit, bins), []

    def then(batch, number):
        if number == 3 and len(after) == 3:
            followed.take(batch.limit(7), 3)  # a try that was stopped
        followed.take(batch, number)
        page, held = followed.page(), followed.bins()
        assert not any("/out/" in f for f in page.inputFiles() + held.inputFiles())
        after.append((page.select("seq").collect(), held.collect()))
        stored = read_lines(spark, str(tmp_path / "out"))
        found = search.search(stored, query, levels, limit=limit)
        assert [r.seq for r in page.collect()] == [r.seq for r in found.collect()]
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, histogram.aligned(search.matches(stored, query, levels), bins).collect()))

    for i in range(5):  # a time range that grows both ways
        lines.where(f"abs(seq - 500) between {i * 101} and {i * 101 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "followed", once=True, then=then).awaitTermination()
    assert len(after) == 5 and (query == "nothing like it" or after[-1][0])
    engine = Engine(lines, followed=followed)
    engine.levels, engine.query = levels, query
    assert [r.seq for r in engine.page(5).collect()] == [r.seq for r in search.search(lines, query, levels, limit=5).collect()]
    if query:
        engine.move(3)
        assert engine.page(5).count() == min(5, max(0, search.matches(lines, query, levels).count() - 3))


@given(st.integers(-(10**13), 10**13), st.integers(0, 10**13), st.integers(-3, 500))
def test_widths(start_ms, span, bins):
    width = histogram.width_for(start_ms, start_ms + span, bins)
    count = lambda w: (start_ms + span) // w - start_ms // w + 1
    assert width & (width - 1) == 0 and count(width) <= max(1, bins, 2 if start_ms < 0 <= start_ms + span else 1)
    assert width == 1 or count(width // 2) > max(1, bins)
