"""The registered queries of the log engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.functions.levels import level_of_name, level_of_ordinal
from skein.operators import clusters, codec, display, histogram, lag, search, selection, skipping, store, templates
from skein.plans import stream_query
from skein.sources import decode, dumps, fixtures, kafka
from skein.sources.pods import inventory
from skein.streaming.late import drop_late

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The adapters in SQL.
_BASE = """base AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, props, json_extract_string(props, '$.k') AS k FROM events)"""
_LOG = (
    _BASE
    + """,
log0 AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' WHEN 'purchase' THEN 'INFO' ELSE 'UNKNOWN' END AS level,
 ms AS timestamp_ms, 'user ' || user_id || ' ' || event_type || ' value ' || CAST(value AS VARCHAR) AS message, 'pod-' || (user_id % 5) AS index_identifier,
 'worker-' || (event_id % 4) AS thread_name, 'svc-' || event_type AS service_name, '1.0' AS service_version, 'app.events' AS logger, k AS correlation_id,
 CASE WHEN event_id % 3 <> 0 THEN 'req-' || event_id END AS request_id, CASE WHEN event_type = 'error' THEN 'failure code ' || k END AS error_message,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'java.lang.IllegalStateException: failure code ' || k || chr(10) || chr(9) || 'at a.B.run(B.java:7)' END AS stacktrace FROM base),
logs AS (SELECT *, lower(concat_ws(' ', seq, level, timestamp_ms, message, index_identifier, thread_name, service_name, service_version, logger, correlation_id, request_id, error_message, stacktrace)) AS search_text FROM log0)"""
)
_KAFKA = """kaf0 AS (SELECT event_id AS seq, 'KAFKA' AS level, ms AS timestamp_ms, props AS message, event_type || '#' || (user_id % 4) AS index_identifier, event_type AS topic,
 CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS key, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS "offset", CAST(user_id % 4 AS INTEGER) AS "partition",
 'X-Correlation-Id : ' || k AS headers, k AS correlation_id, CASE WHEN event_id % 3 <> 0 THEN 'rq-' || event_id END AS request_id FROM base),
kafs AS (SELECT *, lower(concat_ws(' ', seq, level, timestamp_ms, message, index_identifier, topic, coalesce(key, 'null'), "offset", "partition", headers, correlation_id, coalesce(request_id, 'null'), composite_event_id)) AS search_text
 FROM (SELECT *, topic || '#' || "partition" || '#' || "offset" AS composite_event_id FROM kaf0))"""
_LAG = (
    _BASE
    + """,
ends AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", count(*) AS end_offset FROM base GROUP BY ALL),
committed AS (SELECT g AS group_id, topic, "partition", greatest(0, end_offset - (ascii(substr(g, 1, 1)) * 7 + "partition" * 31) % 150) AS current_offset FROM (SELECT DISTINCT o_orderpriority AS g FROM orders), ends),
lag0 AS (SELECT group_id, topic, "partition", current_offset, end_offset, end_offset - current_offset AS lag FROM committed JOIN ends USING (topic, "partition"))"""
)
_DEFAULT = "level <> 'UNKNOWN'"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL where there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.log_lines(spark, sf_dir)


# --- search ---------------------------------------------------------------


def _search(name: str, condition: str, text: str = "", source: str = "logs", limit: int = 50, offset: int = 0, **options) -> None:
    made = fixtures.log_lines if source == "logs" else fixtures.kafka_lines
    with_ = _LOG if source == "logs" else f"{_BASE}, {_KAFKA}"
    sql = f"WITH {with_} SELECT seq, level, timestamp_ms, message FROM {source} WHERE {condition} ORDER BY timestamp_ms DESC, seq DESC LIMIT {limit} OFFSET {offset}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = options | ({"where": options["where"]()} if "where" in options else {})
        return search.search(made(spark, sf_dir), text, limit=limit, offset=offset, **given).select("seq", "level", "timestamp_ms", "message")


_has = lambda t: f"contains(search_text, '{t}')"
_search("search_all_levels", "true", levels=None, limit=10_000)
_search("search_default_levels", _DEFAULT, limit=10_000)
_search("search_one_level", "level = 'WARN'", levels=["WARN"], limit=10_000)
_search("search_term", f"{_DEFAULT} AND {_has('error')}", "ERROR", limit=10_000)
_search("search_and", f"{_DEFAULT} AND {_has('error')} AND {_has('value 1')} AND {_has('pod-3')}", 'error "value 1" pod-3', limit=10_000)
_search("search_phrase", f"{_DEFAULT} AND {_has('failure code 9')}", '"failure  code 9"', limit=10_000)
_search("search_legacy_not", f"{_DEFAULT} AND {_has('error')}", "error !failure", legacy=True, limit=10_000)
_search("search_not", f"{_DEFAULT} AND {_has('error')} AND NOT {_has('worker-1')}", "error !worker-1", limit=10_000)
_search("search_only_not", f"{_DEFAULT} AND NOT {_has('error')}", "!error", limit=10_000)
_search("search_phrase_not", f"{_DEFAULT} AND {_has('user 7')} AND NOT {_has('click')}", '"user 7" !click', limit=10_000)
_search("search_punctuation", f"{_DEFAULT} AND {_has('-')} AND {_has('.')}", "- .", limit=10_000)
_search("search_short_term", f"{_DEFAULT} AND {_has('up')}", "up", limit=10_000)
_search("search_kafka_null", _has("null"), "null", source="kafs", limit=10_000)
_search("search_where", f"{_DEFAULT} AND {_has('error')} AND timestamp_ms % 2 = 0", "error", where=lambda: F.col("timestamp_ms") % 2 == 0, limit=10_000)
_search("page_offset", f"{_DEFAULT} AND {_has('user')}", "user", offset=510, limit=50)
_search("page_first", f"{_DEFAULT} AND {_has('purchase')}", "purchase", limit=10_000)


@query("search_as_of", f"WITH {_LOG} SELECT seq, level, timestamp_ms, message FROM logs WHERE {_DEFAULT} AND {_has('user')} AND seq <= (SELECT max(event_id) // 2 FROM events) ORDER BY timestamp_ms DESC, seq DESC LIMIT 10000")
def _search_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    newest = lines.agg(F.max("seq")).first()[0] or 0
    return search.search(lines, "user", as_of_seq=newest // 2).select("seq", "level", "timestamp_ms", "message")


@query("page_by_time", f"WITH {_LOG} SELECT seq, level, timestamp_ms, message FROM logs WHERE {_DEFAULT} AND {_has('purchase')} ORDER BY timestamp_ms DESC, seq DESC LIMIT 500 OFFSET 100")
def _page_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_time(_lines(spark, sf_dir), "purchase", offset=100, limit=500).select("seq", "level", "timestamp_ms", "message")


@query("page_visible_reversed", f"WITH {_LOG} SELECT row_number() OVER (ORDER BY timestamp_ms, seq) AS row_no, seq FROM (SELECT * FROM logs WHERE {_DEFAULT} ORDER BY timestamp_ms DESC, seq DESC LIMIT 40)")
def _page_visible_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.visible(search.search(_lines(spark, sf_dir)), 40)
    return rows.select(F.row_number().over(Window.orderBy(*search.NEWEST)).cast("long").alias("row_no"), "seq")


@query("search_nonascii", "SELECT doc_id FROM documents WHERE contains(lower(text), 'für') AND NOT contains(lower(text), 'straß')")
def _search_nonascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("search_text"))
    return search.matches(docs, "FÜR !STRAß", levels=None).select("doc_id")


@query("union_sources_merge", f"WITH {_LOG}, {_KAFKA}, u AS (SELECT seq, level, timestamp_ms, index_identifier FROM logs WHERE {_DEFAULT} AND {_has('7')} UNION ALL SELECT seq, level, timestamp_ms, index_identifier FROM kafs WHERE {_has('7')}) SELECT * FROM u ORDER BY timestamp_ms DESC, seq DESC, level LIMIT 500")
def _union_sources_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = search.merged(_lines(spark, sf_dir), fixtures.kafka_lines(spark, sf_dir))
    return search.matches(both, "7").orderBy(*search.newest_first(), "level").limit(500).select("seq", "level", "timestamp_ms", "index_identifier")


@query("gram_df", r"SELECT g AS gram, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, length(s) - 1)), lambda i: substr(s, i, 3))) AS g FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS s FROM documents) WHERE length(s) > 0) GROUP BY g")
def _gram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return skipping.gram_counts(docs, F.col("text"))


@query("gram_prefilter", f"WITH {_LOG} SELECT seq FROM logs WHERE {_has('failure')} AND {_has('pod-2')}")
def _gram_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stored_matches(spark, stream_query.stored_lines(spark, sf_dir), "failure pod-2", levels=None).select("seq")


@query("gram_column", f"WITH {_LOG} SELECT seq FROM logs WHERE {_has('failure')} AND {_has('pod-2')}")
def _gram_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = search.gram_candidates(search.with_grams(_lines(spark, sf_dir)), "failure pod-2")
    return search.matches(lines, "failure pod-2", levels=None).select("seq")


@query("follow_page", f"WITH {_LOG} SELECT seq, timestamp_ms, level FROM logs WHERE {_has('user 1')} ORDER BY timestamp_ms DESC, seq DESC LIMIT 200")
def _follow_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_query.followed_search(spark, sf_dir, '"user 1"', 200, 50).page().select("seq", "timestamp_ms", "level")


_ALIGNED = """e AS (SELECT min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM m),
w AS (SELECT min(w) AS w FROM (SELECT CAST(1 AS BIGINT) << unnest(range(0, 50)) AS w), e WHERE b // w - a // w + 1 <= 50)
SELECT timestamp_ms // w * w AS time_ms, w AS width_ms, level, count(*) AS n FROM m, w GROUP BY ALL"""


@query("follow_histogram", f"WITH {_LOG}, m AS (SELECT * FROM logs WHERE {_has('user 1')}), {_ALIGNED}")
def _follow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_query.followed_search(spark, sf_dir, '"user 1"', 200, 50).bins()


@query("histogram_aligned", f"WITH {_LOG}, m AS (SELECT * FROM logs), {_ALIGNED}")
def _histogram_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.aligned(_lines(spark, sf_dir), 50)


# --- stored lines -----------------------------------------------------------


@query("clear_source", f"WITH {_LOG} SELECT index_identifier, count(*) AS n FROM logs WHERE index_identifier <> 'pod-3' GROUP BY 1")
def _clear_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.line_counts(store.clear_source(_lines(spark, sf_dir), "pod-3"))


@query("clear_topic_prefix", f"WITH {_BASE}, {_KAFKA} SELECT index_identifier, count(*) AS n FROM kafs WHERE NOT starts_with(index_identifier, 'click#') GROUP BY 1")
def _clear_topic_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.line_counts(store.clear_topic(fixtures.kafka_lines(spark, sf_dir), "click"))


@query("indexed_counts", f"WITH {_LOG}, {_KAFKA} SELECT index_identifier, count(*) AS n FROM (SELECT index_identifier FROM logs UNION ALL SELECT index_identifier FROM kafs) GROUP BY 1")
def _indexed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.line_counts(search.merged(_lines(spark, sf_dir), fixtures.kafka_lines(spark, sf_dir)))


@query("stored_search", f"WITH {_LOG} SELECT seq FROM logs WHERE level = 'ERROR' AND index_identifier = 'pod-1' AND {_has('failure code 3')}")
def _stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stream_query.stored_lines(spark, sf_dir)
    held = store.read_lines(spark, path).where("index_identifier = 'pod-1'")
    return search.matches(held, '"failure code 3"', ["ERROR"]).select("seq")


_LATE = "late AS (SELECT *, max(timestamp_ms) OVER (PARTITION BY topic, \"partition\" ORDER BY seq + (seq * 7919) % 50, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM kafs)"


@query("late_drop", f"WITH {_BASE}, {_KAFKA}, {_LATE} SELECT seq, timestamp_ms FROM late WHERE newest IS NULL OR timestamp_ms >= newest")
def _late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.late_arrivals(fixtures.record_times(spark, sf_dir))
    return store.late_dropped(lines, ["topic", "partition"], ["arrival", "seq"]).select("seq", "timestamp_ms")


@query("late_drop_fold", f"WITH {_BASE}, {_KAFKA}, {_LATE} SELECT seq, timestamp_ms FROM late WHERE newest IS NULL OR timestamp_ms >= newest")
def _late_drop_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.late_arrivals(fixtures.record_times(spark, sf_dir))
    return drop_late(lines, ["arrival", "seq"], block=1 << 40).select("seq", "timestamp_ms")


@query("late_drop_blocks", f"""WITH RECURSIVE {_BASE}, {_KAFKA},
o AS (SELECT seq, timestamp_ms, index_identifier, row_number() OVER (PARTITION BY index_identifier ORDER BY seq + (seq * 7919) % 50, seq) AS n FROM kafs),
f AS (SELECT index_identifier, n, seq, timestamp_ms, true AS ok, timestamp_ms AS newest, 1 AS held FROM o WHERE n = 1
 UNION ALL SELECT o.index_identifier, o.n, o.seq, o.timestamp_ms, f.held >= 64 OR o.timestamp_ms >= f.newest,
  CASE WHEN f.held >= 64 OR o.timestamp_ms >= f.newest THEN o.timestamp_ms ELSE f.newest END,
  CASE WHEN f.held >= 64 THEN 1 WHEN o.timestamp_ms >= f.newest THEN f.held + 1 ELSE f.held END
 FROM f JOIN o ON o.index_identifier = f.index_identifier AND o.n = f.n + 1)
SELECT seq, timestamp_ms FROM f WHERE ok""")
def _late_drop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.late_arrivals(fixtures.record_times(spark, sf_dir))
    return drop_late(lines, ["arrival", "seq"], block=64).select("seq", "timestamp_ms")


QUERIES["stream_late_drop"] = stream_query.stream_late_drop
ORACLES["stream_late_drop"] = ORACLES["late_drop"]


_FOLD = """n AS (SELECT *, row_number() OVER (PARTITION BY index_identifier, level ORDER BY arrival, seq) AS n FROM o),
f AS (SELECT *, true AS ok, timestamp_ms AS newest, 1 AS held FROM n WHERE n = 1
 UNION ALL SELECT n.*, f.held >= 4096 OR n.timestamp_ms >= f.newest, CASE WHEN f.held >= 4096 OR n.timestamp_ms >= f.newest THEN n.timestamp_ms ELSE f.newest END,
  CASE WHEN f.held >= 4096 THEN 1 WHEN n.timestamp_ms >= f.newest THEN f.held + 1 ELSE f.held END
 FROM f JOIN n ON n.index_identifier = f.index_identifier AND n.level = f.level AND n.n = f.n + 1)"""

QUERIES["ingest_raw_lines"] = stream_query.ingest_raw_lines
ORACLES["ingest_raw_lines"] = f"""WITH RECURSIVE {_LOG},
o AS (SELECT index_identifier, CASE seq % 4 WHEN 2 THEN 'UNKNOWN' ELSE level END AS level, timestamp_ms, message, seq, seq + (seq * 7919) % 50 AS arrival FROM logs WHERE seq % 4 < 3),
{_FOLD} SELECT index_identifier, level, timestamp_ms, message FROM f WHERE ok"""


QUERIES["ingest_records"] = stream_query.ingest_records
ORACLES["ingest_records"] = f"""WITH RECURSIVE {_BASE}, {_KAFKA},
e AS (SELECT (max("offset") + 1) // 3 AS third, (min(timestamp_ms) + max(timestamp_ms)) // 2 AS since FROM kafs),
b AS (SELECT index_identifier, coalesce(min("offset") FILTER (timestamp_ms >= since), max("offset") + 1) AS begins FROM kafs, e WHERE "offset" < third GROUP BY 1),
o AS (SELECT k.index_identifier, level, timestamp_ms, composite_event_id, message, seq, "offset" AS arrival FROM kafs k LEFT JOIN b ON b.index_identifier = k.index_identifier WHERE "offset" >= coalesce(begins, 0)),
{_FOLD} SELECT composite_event_id, timestamp_ms, message FROM f WHERE ok"""


@query("block_numbers", f"WITH {_LOG}, b AS (SELECT *, (row_number() OVER (PARTITION BY index_identifier, level ORDER BY seq) - 1) // 4096 AS block FROM logs) SELECT index_identifier, level, block, count(*) AS n, min(seq) AS min_seq, max(seq) AS max_seq, max(timestamp_ms) AS max_timestamp FROM b GROUP BY ALL")
def _block_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.block_numbers(_lines(spark, sf_dir))


@query("kv_latest", "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id % 5 = 0 AS deleted, event_id AS version FROM events) SELECT key, arg_max(value, version) AS value FROM l GROUP BY key HAVING NOT arg_max(deleted, version)")
def _kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    return store.latest(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), (F.col("event_id") % 5 == 0).alias("deleted"), F.col("event_id").alias("version")))


@query("point_fetch", f"WITH {_BASE}, {_KAFKA} SELECT seq, composite_event_id, message FROM kafs WHERE topic = 'error' AND \"partition\" = 2 AND \"offset\" = 11")
def _point_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.point(fixtures.kafka_lines(spark, sf_dir), "error", 2, 11).select("seq", "composite_event_id", "message")


# --- histograms -------------------------------------------------------------

_BINS = 64
_CHART = f"""{_LOG}, m AS (SELECT * FROM logs WHERE {_DEFAULT}),
r AS (SELECT min(timestamp_ms) AS a, max(timestamp_ms) AS b, greatest(1, greatest(1, max(timestamp_ms) - min(timestamp_ms)) // {_BINS}) AS w FROM m),
h AS (SELECT CAST(greatest(0, least({_BINS - 1}, (timestamp_ms - a) // w)) AS INTEGER) AS bin, level, count(*) AS n FROM m, r GROUP BY ALL),
d AS (SELECT CAST(i AS INTEGER) AS bin, a + w * i AS time_ms, CAST(coalesce((SELECT sum(n) FROM h WHERE h.bin = i), 0) AS BIGINT) AS total FROM range({_BINS}) t(i), r)"""


def _chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(_lines(spark, sf_dir))


@query("histogram", f"WITH {_CHART} SELECT bin, level, n FROM h")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(_chart_lines(spark, sf_dir), _BINS)


@query("histogram_dense", f"WITH {_CHART} SELECT bin, time_ms, total FROM d")
def _histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.dense(_chart_lines(spark, sf_dir), _BINS)


@query("histogram_header", f"WITH {_LOG} SELECT count(*) AS total, greatest(1, (max(timestamp_ms) - min(timestamp_ms)) // 1000) AS seconds, count(*) / greatest(1, (max(timestamp_ms) - min(timestamp_ms)) // 1000) AS per_second FROM logs WHERE {_DEFAULT}")
def _histogram_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.header(_chart_lines(spark, sf_dir))


@query("histogram_highest", f"WITH {_CHART} SELECT max(total) AS highest FROM d")
def _histogram_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.highest(_chart_lines(spark, sf_dir), _BINS)


@query("histogram_share", f"WITH {_CHART} SELECT bin, level, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY bin) AS percent FROM h")
def _histogram_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.shares(_chart_lines(spark, sf_dir), _BINS)


@query("histogram_page", f"WITH {_LOG}, m AS (SELECT * FROM logs WHERE {_has('click')} AND {_DEFAULT} ORDER BY timestamp_ms DESC, seq DESC LIMIT 500), r AS (SELECT min(timestamp_ms) AS a, greatest(1, greatest(1, max(timestamp_ms) - min(timestamp_ms)) // 7) AS w FROM m) SELECT CAST(greatest(0, least(6, (timestamp_ms - a) // w)) AS INTEGER) AS bin, level, count(*) AS n FROM m, r GROUP BY ALL")
def _histogram_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(search.search(_lines(spark, sf_dir), "click", limit=500), 7)


@query("drilldown_offset", f'WITH {_CHART} SELECT bin, CAST(100 + sum(total) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS "offset" FROM d')
def _drilldown_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.drill_down(_chart_lines(spark, sf_dir), _BINS, 100)


@query("date_markers", f"WITH {_CHART}, x AS (SELECT bin, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d') AS date FROM d), y AS (SELECT *, lag(date) OVER (ORDER BY bin) AS before FROM x) SELECT bin, date FROM y WHERE before IS NULL OR before <> date")
def _date_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.date_markers(_chart_lines(spark, sf_dir), _BINS)


# --- consumer lag -----------------------------------------------------------


def _lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.lag_rows(fixtures.committed_offsets(spark, sf_dir), fixtures.end_offsets(spark, sf_dir))


@query("lag_rows", f"WITH {_LAG} SELECT * FROM lag0")
def _lag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lag(spark, sf_dir)


@query("lag_rows_dumped", f"WITH {_LAG} SELECT * FROM lag0")
def _lag_rows_dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = stream_query.dumped(fixtures.committed_offsets(spark, sf_dir), "group_id")
    ends = stream_query.dumped(fixtures.end_offsets(spark, sf_dir), "topic")
    return lag.lag_rows(dumps.committed(spark, committed), dumps.ends(spark, ends))


@query("lag_nonzero", f"WITH {_LAG} SELECT group_id, topic, \"partition\", lag FROM lag0 WHERE lag > 0")
def _lag_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.lagging(_lag(spark, sf_dir)).select("group_id", "topic", "partition", "lag")


@query("lag_unmatched", f"WITH {_LAG} SELECT group_id, topic, \"partition\", current_offset FROM committed WHERE topic = 'click'")
def _lag_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixtures.end_offsets(spark, sf_dir).where("topic <> 'click'")
    return lag.unmatched(fixtures.committed_offsets(spark, sf_dir), known).select("group_id", "topic", "partition", "current_offset")


@query("lag_severity", f"""WITH {_LAG}, s AS (SELECT CASE WHEN lag >= 100 THEN 'High' WHEN lag >= 10 THEN 'Medium' ELSE 'Low' END AS severity, lag, topic FROM lag0 WHERE lag > 0),
g AS (SELECT severity, CAST(sum(lag) AS BIGINT) AS lag, count(DISTINCT topic) AS topics, list_sort(list(DISTINCT topic)) AS names FROM s GROUP BY 1)
SELECT severity, lag, topics, lag * 100.0::DOUBLE / sum(lag) OVER () AS percent, array_to_string(names[1:3], ', ') || CASE WHEN topics > 3 THEN ', ...' ELSE '' END AS tip FROM g""")
def _lag_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.by_severity(_lag(spark, sf_dir))


@query("lag_total", f"WITH {_LAG} SELECT CAST(sum(lag) AS BIGINT) AS total_lag FROM lag0")
def _lag_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.total_lag(_lag(spark, sf_dir))


@query("lag_by_topic", f"""WITH {_LAG} SELECT topic, CAST(sum(lag) OVER (PARTITION BY topic) AS BIGINT) AS topic_lag, group_id, "partition", lag, CAST(row_number() OVER (PARTITION BY topic ORDER BY lag DESC, group_id, "partition") AS INTEGER) AS rank FROM lag0""")
def _lag_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.by_topic(_lag(spark, sf_dir))


@query("column_widths", f"""WITH {_LAG}, w AS (SELECT 0 AS "position", 'group_id' AS "column", max(length(group_id)) AS width FROM lag0 UNION ALL SELECT 1, 'topic', max(length(topic)) FROM lag0 UNION ALL SELECT 2, 'lag', max(length(CAST(lag AS VARCHAR))) FROM lag0)
SELECT "position", "column", width, CAST(coalesce(sum(width) OVER (ORDER BY "position" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM w""")
def _column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.column_widths(_lag(spark, sf_dir).select("group_id", "topic", "lag"))


@query("start_offsets", f"""WITH {_LAG}, {_KAFKA}, t AS (SELECT topic, "partition", min("offset") AS o FROM kafs WHERE timestamp_ms >= (SELECT max(ms) - 3600000 FROM base) GROUP BY ALL),
e AS (SELECT * FROM ends WHERE topic <> 'view') SELECT a.topic, a."partition", CAST(coalesce(t.o, e.end_offset, 0) AS BIGINT) AS start_offset FROM ends a LEFT JOIN t USING (topic, "partition") LEFT JOIN e USING (topic, "partition")""")
def _start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = fixtures.end_offsets(spark, sf_dir)
    newest = fixtures.record_times(spark, sf_dir).agg(F.max("timestamp_ms")).first()[0] or 0
    by_time = lag.offsets_since(fixtures.kafka_lines(spark, sf_dir), F.lit(newest - 3_600_000))
    return lag.start_offsets(ends.select("topic", "partition"), by_time, ends.where("topic <> 'view'"))


@query("topic_list", "SELECT DISTINCT event_type AS topic FROM events")
def _topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kafka.topics(fixtures.end_offsets(spark, sf_dir))


# --- selections -------------------------------------------------------------


def _names(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(condition).select(F.col("c_name").alias("name"))


@query("selection_carry", "SELECT c_name AS name, c_nationkey < 8 AS selected FROM customer WHERE c_acctbal > 0")
def _selection_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.carried_over(_names(spark, sf_dir, "c_acctbal > 0"), _names(spark, sf_dir, "c_nationkey < 8"))


@query("selection_diff", "SELECT c_name AS name, CASE WHEN c_acctbal > 0 THEN 'stop' ELSE 'start' END AS action FROM customer WHERE (c_acctbal > 0) <> (c_nationkey < 8)")
def _selection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.changes(_names(spark, sf_dir, "c_acctbal > 0"), _names(spark, sf_dir, "c_nationkey < 8"))


@query("topic_subset", f"WITH {_LAG} SELECT topic, \"partition\" FROM ends WHERE topic IN ('click', 'view')")
def _topic_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.of_topics(fixtures.end_offsets(spark, sf_dir), ["click", "view"]).select("topic", "partition")


@query("unassign", f"WITH {_LAG} SELECT topic, \"partition\" FROM ends WHERE topic NOT IN ('click', 'error')")
def _unassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = fixtures.end_offsets(spark, sf_dir)
    return selection.without(ends.select("topic", "partition"), ends.where("topic in ('click', 'error')").select("topic").distinct())


@query("picker_filter", "SELECT c_name AS name FROM customer WHERE contains(lower(c_name), '#00000001')")
def _picker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.picked(_names(spark, sf_dir, "true"), "#00000001")


@query("selection_toggle", "WITH i AS (SELECT c_name AS name, c_custkey % 3 = 0 AS selected FROM customer), o AS (SELECT bool_and(selected) AS v FROM i WHERE contains(name, '1')) SELECT name, CASE WHEN contains(name, '1') THEN NOT v ELSE selected END AS selected FROM i, o")
def _selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 3 == 0).alias("selected"))
    return selection.toggled_all(items, "1")


@query("selection_summary", "WITH i AS (SELECT c_name AS name, c_custkey % 3 = 0 AS selected FROM customer), f AS (SELECT string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT name FROM i WHERE selected ORDER BY name LIMIT 5)) SELECT count(*) FILTER (selected) AS selected, count(*) AS total, any_value(names) || CASE WHEN count(*) FILTER (selected) > 5 THEN ' + ' || (count(*) FILTER (selected) - 5) || ' more' ELSE '' END AS names FROM i, f")
def _selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 3 == 0).alias("selected"))
    return selection.summary(items)


@query("pod_version", "SELECT 'pod-' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'registry/plain' ELSE CAST(s_nationkey AS VARCHAR) END AS version, 'app-' || s_suppkey AS container FROM supplier")
def _pod_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(fixtures.pods(spark, sf_dir))


@query("pod_version_dumped", ORACLES["pod_version"])
def _pod_version_dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespaced = fixtures.pods(spark, sf_dir).withColumn("namespace", F.concat(F.lit("ns/"), F.substring_index("image", ":", -1)))
    return inventory(dumps.pods(spark, stream_query.dumped(namespaced, "namespace")))


# --- text -------------------------------------------------------------------

_ISO = "strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp_ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(timestamp_ms % 1000 AS VARCHAR), 3, '0') END || 'Z'"


@query("display_log", f"WITH {_LOG} SELECT seq, concat_ws(' ', {_ISO}, level, service_name, correlation_id, substr(message, 1, 1000), error_message, stacktrace) AS line FROM logs")
def _display_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("seq", display.log_row().alias("line"))


@query("display_kafka", f"WITH {_BASE}, {_KAFKA} SELECT seq, concat_ws(' ', {_ISO}, level, composite_event_id, topic, correlation_id, request_id, message) AS line FROM kafs")
def _display_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.kafka_lines(spark, sf_dir).select("seq", display.kafka_row().alias("line"))


@query("detail_fields", f"""WITH {_LOG}, f AS (SELECT seq, unnest([{{'position': 0, 'label': 'Timestamp', 'value': {_ISO}}}, {{'position': 1, 'label': 'Correlation ID', 'value': correlation_id}}, {{'position': 2, 'label': 'Request ID', 'value': request_id}}, {{'position': 3, 'label': 'Level', 'value': level}},
 {{'position': 4, 'label': 'Service', 'value': service_name || ':' || service_version}}, {{'position': 5, 'label': 'Logger', 'value': logger}}, {{'position': 6, 'label': 'Thread', 'value': thread_name}}, {{'position': 7, 'label': 'Error Message', 'value': error_message}}], recursive := true) FROM logs) SELECT seq, "position", label, value FROM f WHERE value IS NOT NULL""")
def _detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.log_fields(_lines(spark, sf_dir))


@query("detail_fields_kafka", f"""WITH {_BASE}, {_KAFKA}, f AS (SELECT seq, unnest([{{'position': 0, 'label': 'Timestamp', 'value': {_ISO}}}, {{'position': 1, 'label': 'Correlation ID', 'value': correlation_id}}, {{'position': 2, 'label': 'Request ID', 'value': request_id}}, {{'position': 3, 'label': 'Topic', 'value': topic}},
 {{'position': 4, 'label': 'Partition', 'value': CAST("partition" AS VARCHAR)}}, {{'position': 5, 'label': 'Offset', 'value': CAST("offset" AS VARCHAR)}}, {{'position': 6, 'label': 'Key', 'value': coalesce(key, 'null')}}, {{'position': 7, 'label': 'Composite Event ID', 'value': composite_event_id}}, {{'position': 8, 'label': 'Headers', 'value': headers}}], recursive := true) FROM kafs) SELECT seq, "position", label, value FROM f WHERE value IS NOT NULL""")
def _detail_fields_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.kafka_fields(fixtures.kafka_lines(spark, sf_dir))


@query("detail_body", f"WITH {_LOG} SELECT seq, message || coalesce(chr(10) || chr(10) || 'Error: ' || error_message, '') || coalesce(chr(10) || chr(10) || 'Stack Trace:' || chr(10) || stacktrace, '') AS body, CASE WHEN stacktrace IS NOT NULL THEN 'trace' ELSE 'plain' END AS kind FROM logs")
def _detail_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("seq", display.log_body().alias("body"), display.content_kind(F.col("message"), F.col("stacktrace")).alias("kind"))


@query("detail_body_kafka", f"WITH {_BASE}, {_KAFKA} SELECT seq, '{{' || chr(10) || '    \"k\": ' || correlation_id || chr(10) || '}}' AS body FROM kafs")
def _detail_body_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.kafka_lines(spark, sf_dir).select("seq", display.pretty_json("message").alias("body"))


@query("web_rows", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def _web_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.html_escape(F.col("html")).alias("escaped"))


@query("web_lines", f"WITH {_BASE}, {_KAFKA} SELECT seq, '[' || strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S') || '] [' || level || '] ' || replace(message, '\"', '&quot;') AS line FROM kafs")
def _web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.kafka_lines(spark, sf_dir).select("seq", display.web_row().alias("line"))


@query("stacktrace_classes", f"""WITH {_LOG}, s AS (SELECT seq, unnest(string_split(stacktrace, chr(10))) AS line, generate_subscripts(string_split(stacktrace, chr(10)), 1) - 1 AS line_no FROM logs WHERE stacktrace IS NOT NULL)
SELECT seq, CAST(line_no AS INTEGER) AS line_no, line, CASE WHEN starts_with(line, 'at ') THEN 'frame' WHEN contains(line, 'Exception') OR contains(line, 'Error') THEN 'error' WHEN starts_with(line, chr(9) || 'at ') THEN 'indented frame' ELSE 'other' END AS kind FROM s""")
def _stacktrace_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.trace_lines(_lines(spark, sf_dir).where("stacktrace is not null"), "seq", "stacktrace")


@query("json_tokens", r"""WITH t AS (SELECT event_id, regexp_extract_all(props, '"[^"\\]*(?:\\[\s\S][^"\\]*)*"?|[{}\[\],:]|[-0-9][0-9.eE+-]*|true|false|null|[ \t\n\r]+|[\s\S]') AS p FROM events),
u AS (SELECT event_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS n FROM t),
w AS (SELECT *, last_value(CASE WHEN token IN ('{', '[', ',', ':') THEN token END IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY n) AS l FROM u)
SELECT event_id, CAST(n AS INTEGER) AS "position", token, CASE WHEN token IN ('{', '}', '[', ']', ',', ':') THEN 'structure' WHEN starts_with(token, '"') THEN CASE WHEN l = ':' THEN 'string' ELSE 'key' END
 WHEN regexp_matches(token, '^[-0-9]') THEN 'number' WHEN token IN ('true', 'false', 'null') THEN 'literal' WHEN regexp_matches(token, '^[ \t\n\r]') THEN 'space' ELSE 'other' END AS kind FROM w""")
def _json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.json_tokens(fixtures.events(spark, sf_dir), "event_id", "props")


@query("word_tokens", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \x22'':,{}\[\]()]')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def _word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.explode(scalars.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("word_at_place", r"""WITH t AS (SELECT conv_id, turn, text, conv_id % 40 AS i FROM conversations), u AS (SELECT *, CASE WHEN i = length(text) THEN i - 1 ELSE i END AS place FROM t),
v AS (SELECT *, regexp_extract(substr(text, 1, place + 1), '[^ \x22'':,{}\[\]()]*$') AS l, regexp_extract(substr(text, place + 2), '^[^ \x22'':,{}\[\]()]*') AS r FROM u) SELECT conv_id, turn, CASE WHEN i <= length(text) AND l <> '' THEN l || r END AS word FROM v""")
def _word_at_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", scalars.word_at(F.col("text"), (F.col("conv_id") % 40).cast("int")).alias("word"))


@query("round_format", """SELECT o_orderkey, replace(format('{:,}', o_orderkey * 7919), ',', '.') AS dotted,
 CASE WHEN b < 1024 THEN b || ' B' ELSE (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' ' || CASE p WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' ELSE 'TB' END END AS size, CAST(m AS BIGINT) AS rounded FROM
 (SELECT *, CAST(floor(b / pow(1024.0, p) * 100 + 0.5) AS BIGINT) AS h, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE (o_custkey % 9) * floor(abs(o_orderkey / (o_custkey % 9)) + 0.5) END AS m FROM
 (SELECT *, CASE WHEN b >= pow(1024, 4) THEN 4 WHEN b >= pow(1024, 3) THEN 3 WHEN b >= pow(1024, 2) THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS p FROM (SELECT *, o_orderkey * o_orderkey * o_orderkey AS b FROM orders)))""")
def _round_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    wide = key.cast("decimal(38,0)")  # the cube of a key over 2,097,151 doesn't fit into 64 bits
    return o.select("o_orderkey", scalars.thousands(wide * 7919).alias("dotted"), scalars.byte_unit(wide * wide * wide).alias("size"), scalars.round_to(key, F.col("o_custkey") % 9).alias("rounded"))


@query("time_format", f"WITH {_BASE} SELECT event_id, strftime(make_timestamp(ms * 1000), '%H:%M:%S') AS clock, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day, (ms // 1000 - event_id % 31 * 86400) * 1000 AS since FROM base")
def _time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    return e.select("event_id", scalars.clock(F.col("ms")).alias("clock"), scalars.day(F.col("ms")).alias("day"), scalars.days_before(F.col("ms"), F.col("event_id") % 31).alias("since"))


@query("hashes", "SELECT event_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(event_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS fnv, CAST(pow(2, ceil(log2(greatest(user_id, 1)))) AS BIGINT) AS power, bit_count(event_id) AS bits FROM events")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    return e.select("event_id", scalars.fnv1a(F.col("event_type")).alias("fnv"), scalars.next_power_of_two(F.col("user_id")).alias("power"), F.bit_count("event_id").alias("bits"))


@query("log_colours", f"WITH {_LOG}, n AS (SELECT DISTINCT index_identifier FROM logs), h AS (SELECT index_identifier, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(index_identifier, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM n) SELECT index_identifier, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 40 AS INTEGER) AS colour FROM h")
def _log_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("index_identifier", scalars.colour_index(F.col("index_identifier")).alias("colour")).distinct()


@query("level_of", "SELECT event_id, CASE WHEN upper(event_type) = 'ERROR' THEN 'ERROR' ELSE 'UNKNOWN' END AS by_name, coalesce(CASE WHEN event_id % 9 < 6 THEN ['INFO', 'WARN', 'DEBUG', 'ERROR', 'UNKNOWN', 'KAFKA'][event_id % 9 + 1] END, 'UNKNOWN') AS by_ordinal FROM events")
def _level_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    return e.select("event_id", level_of_name(F.col("event_type")).alias("by_name"), level_of_ordinal((F.col("event_id") % 9).cast("int")).alias("by_ordinal"))


@query("log_clusters", f"WITH {_LOG} " + r"""SELECT message_pattern, len(string_split(message_pattern, ' ')) AS words, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, regexp_replace(regexp_replace(regexp_replace(message, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}', '<uuid>', 'g'), '\b0[xX][0-9a-fA-F]+\b', '<hex>', 'g'), '[0-9]+(\.[0-9]+)?', '<num>', 'g') AS message_pattern FROM logs) GROUP BY 1""")
def _log_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(_lines(spark, sf_dir))


def _templates_sql(start: str, lines: str) -> str:
    """The templates of ``lines`` (seq, message): messages join one after the other, then the shares' templates do."""
    alike = "list_transform(t, lambda x: len(list_filter(range(1, len(w) + 1), lambda j: x[j] = w[j])))"
    joined = "CASE WHEN list_max(alike) >= 0.5 * len(w) THEN list_position(alike, list_max(alike)) ELSE len(t) + 1 END"
    grown = """CASE WHEN k > len(t) THEN list_append(t, w) ELSE list_transform(range(1, len(t) + 1), lambda q: CASE WHEN q = k THEN
  list_transform(range(1, len(w) + 1), lambda j: CASE WHEN t[q][j] = w[j] THEN w[j] ELSE '<*>' END) ELSE t[q] END) END"""

    def fold(name: str, rows: str, keys: str) -> str:
        same = " AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))
        return f"""{name} AS (SELECT *, [w] AS t, CAST(1 AS BIGINT) AS k FROM {rows} WHERE i = 1 UNION ALL
 SELECT * EXCLUDE (t, k, alike), {grown} AS t, k FROM (SELECT *, CAST({joined} AS BIGINT) AS k FROM (SELECT *, {alike} AS alike FROM (SELECT o.*, f.t FROM {name} f JOIN {rows} o ON {same} AND o.i = f.i + 1))))"""

    return f"""WITH RECURSIVE {start},
masked AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(coalesce(message, ''), '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}', '<uuid>', 'g'), '\\b0[xX][0-9a-fA-F]+\\b', '<hex>', 'g'), '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS m FROM {lines}),
d AS (SELECT m, string_split(m, ' ') AS w, substr(md5(m), 1, 1) AS share, count(*) AS n, min(seq) AS first_seq FROM masked GROUP BY m),
o1 AS (SELECT *, len(w) || ' ' || w[1] AS leaf, row_number() OVER (PARTITION BY len(w), w[1], share ORDER BY m) AS i FROM d),
{fold("f1", "o1", "leaf, share")},
s AS (SELECT leaf, share, unnest(t) AS w, generate_subscripts(t, 1) AS number FROM (SELECT leaf, share, arg_max(t, i) AS t FROM f1 GROUP BY leaf, share)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY share, number) AS i FROM s),
{fold("f2", "o2", "leaf")},
p AS (SELECT leaf, arg_max(t, i) AS t FROM f2 GROUP BY leaf)
SELECT array_to_string(p.t[f2.k], ' ') AS message_pattern, len(any_value(p.t[f2.k])) AS words, CAST(sum(n) AS BIGINT) AS n, min(first_seq) AS first_seq
FROM f1 JOIN f2 ON f1.leaf = f2.leaf AND f1.share = f2.share AND f1.k = f2.number JOIN p ON p.leaf = f1.leaf GROUP BY f1.leaf, f2.k, p.t[f2.k]""".replace("\\\\", "\\")


@query("log_templates", _templates_sql(_LOG, "logs"))
def _log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.templates(_lines(spark, sf_dir))


@query("text_templates", _templates_sql("l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)", "(SELECT doc_id * 1000000 + generate_subscripts(x, 1) - 1 AS seq, unnest(x) AS message FROM l)"))
def _text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n"))).select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"), F.col("col").alias("message"))
    return templates.templates(lines)


# --- numbers ----------------------------------------------------------------


@query("zigzag_delta", f"WITH {_BASE}, d AS (SELECT user_id, event_id, value, ms - lag(ms, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS x, ms FROM base) SELECT user_id, event_id, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS delta, ms AS restored FROM d")
def _zigzag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codec.deltas(fixtures.events(spark, sf_dir), ["user_id"], "event_id", "ms").select("user_id", "event_id", "delta")
    return codec.restored(rows, ["user_id"], "event_id", "restored")


def _codec(name: str) -> None:
    @query(f"codec_{name}", "SELECT event_type AS key, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n, max(event_id) AS most FROM events GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = stream_query.fresh_path(spark, name)
        held = codec.stored(fixtures.events(spark, sf_dir), "event_type", "event_id", "event_id", name, path)
        return held.groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.max("value").alias("most"))


_codec("varint")
_codec("bit_planes")


# --- decoding ---------------------------------------------------------------


@query("kafka_decode", f"""WITH {_BASE}, {_KAFKA} SELECT seq, level, timestamp_ms, message, index_identifier, topic, key, "offset", "partition", headers || CASE WHEN request_id IS NOT NULL THEN ' | X-Request-Id : ' || request_id ELSE '' END AS headers, correlation_id, request_id, composite_event_id FROM kafs""")
def _kafka_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_records(fixtures.kafka_records(spark, sf_dir))


@query("ecs_rejected", f"WITH {_LOG} SELECT seq, 'no time before the text' AS reason FROM logs WHERE seq % 4 = 3")
def _ecs_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.undecodable(stream_query.raw_lines(_lines(spark, sf_dir))).select("seq", "reason")


@query("ecs_decode", f"""WITH {_LOG} SELECT seq, CASE seq % 4 WHEN 2 THEN 'UNKNOWN' ELSE level END AS level, timestamp_ms, message, CASE seq % 4 WHEN 2 THEN '' ELSE thread_name END AS thread_name, CASE seq % 4 WHEN 2 THEN '' ELSE service_name END AS service_name,
 CASE seq % 4 WHEN 2 THEN '' ELSE service_version END AS service_version, CASE seq % 4 WHEN 2 THEN '' ELSE logger END AS logger, CASE seq % 4 WHEN 2 THEN NULL ELSE correlation_id END AS correlation_id, CASE seq % 4 WHEN 2 THEN NULL ELSE request_id END AS request_id,
 CASE seq % 4 WHEN 2 THEN NULL ELSE error_message END AS error_message, CASE seq % 4 WHEN 2 THEN NULL ELSE stacktrace END AS stacktrace FROM logs WHERE seq % 4 < 3""")
def _ecs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_lines(stream_query.raw_lines(_lines(spark, sf_dir)))


@query("numbered_lines", f"WITH {_LOG} SELECT user_id AS user_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM base")
def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.numbered(fixtures.events(spark, sf_dir), F.col("event_id"), 1000).select("user_id", "seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of ``entry``: the newest errors, without a phrase."""
    return search.search(_lines(spark, sf_dir), "error !worker-1", limit=50)
