"""One query per operator on timelines, each with the SQL that states it."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.data_types import SOURCES, source_of
from chronoforge.functions.schema import EVENT_COLUMNS, EXPORT_COLUMNS, FREQUENCY_COLUMNS, SEARCH_COLUMNS
from chronoforge.functions.text import MACB_JSON, MACB_OTHER, highlight, macb
from chronoforge.functions.times import bucket_bounds, drop_offset, filetime_text, iso_to_utc, l2t_date, l2t_time
from chronoforge.operators import aggregates, edits, pages, predicates, saved
from chronoforge.operators.predicates import Request, predicate
from chronoforge.plans.timeline_view import NOTES_SQL, TIMELINE_SQL, notes, timeline
from chronoforge.sources import dynamic, files, imports, jsonl, l2t, store, tln
from chronoforge.streaming.imports import live_histogram as stream_histogram
from chronoforge.streaming.imports import write_histogram

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
COLUMNS = ", ".join(["id", *(f'"{c}"' for c in EVENT_COLUMNS)])
DAY = ("2024-01-05", "2024-01-12")
IN_DAYS = "datetime >= '2024-01-05 00:00:00' AND datetime <= '2024-01-12 23:59:59'"
REAL = "datetime > '1970-01-01' AND datetime < '2100-01-01'"


def query(sql: str, timeline_sql: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = TIMELINE_SQL + sql if timeline_sql else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _found(spark: SparkSession, sf: str, request: Request) -> DataFrame:
    return pages.found(timeline(spark, sf), request)


def _folder(spark: SparkSession) -> str:
    """A folder of its own for what a query writes; it goes when the session's Python ends, as results are read from it until then."""
    path = f"{files.shared_dir(spark)}/timelines-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear, spark)
    _made.append(path)
    return path


_made: list[str] = []


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        for path in _made:
            files.delete(spark, path)


def _stored(spark: SparkSession, sf: str) -> str:
    path = f"{_folder(spark)}/store"
    store.append(timeline(spark, sf), path)
    return path


# -- filters


@query(f"SELECT {COLUMNS} FROM tl WHERE source = 'WEBHIST' AND host != 'HOST3' AND {IN_DAYS}")
def filter_eq_and(spark, sf):
    return _found(spark, sf, Request([("source", "=", "WEBHIST"), ("host", "!=", "HOST3")], date_from=DAY[0], date_to=DAY[1]))


@query(f"SELECT {COLUMNS} FROM tl WHERE source = 'REG' OR \"user\" = 'user7' OR bookmark = 1")
def filter_or(spark, sf):
    return _found(spark, sf, Request([("source", "=", "REG"), ("user", "=", "user7"), ("nosuch", "=", "x")], "OR", bookmarked=True))


@query(f"SELECT {COLUMNS} FROM tl WHERE (source = 'REG' OR \"user\" = 'user7') AND bookmark = 1")
def filter_or_within_scopes(spark, sf):
    return _found(spark, sf, Request([("source", "=", "REG"), ("user", "=", "user7")], "OR", bookmarked=True, and_scopes=True))


@query(f"SELECT {COLUMNS} FROM tl WHERE filename ILIKE '%c:\\users\\USER1%' AND tag NOT ILIKE '%malware%'")
def filter_like_backslash(spark, sf):
    return _found(spark, sf, Request([("filename", "LIKE", "c:\\users\\USER1"), ("tag", "NOT LIKE", "malware")]))


@query(f"SELECT {COLUMNS} FROM tl WHERE datetime >= '2024-01-01 00:00:00' AND datetime <= '2024-01-31 23:59:59'")
def date_range_partial(spark, sf):
    return _found(spark, sf, Request([("datetime", ">=", "2024"), ("datetime", "<=", "2024-01")]))


@query(f"SELECT {COLUMNS} FROM tl WHERE datetime BETWEEN '2024-01-10 00:00:00' AND '2024-01-10 11:59:59'")
def date_between(spark, sf):
    return pages.matching(timeline(spark, sf), predicates.between("2024-01-10 00:00:00", "2024-01-10 11:59:59"))


@query(f"SELECT {COLUMNS} FROM tl WHERE " + " OR ".join(f"\"{c}\" ILIKE '%site/4%'" for c in SEARCH_COLUMNS))
def keyword_search(spark, sf):
    return _found(spark, sf, Request(search="SITE/4"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text ILIKE '%tion the%'", timeline_sql=False)
def keyword_large_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.filter(predicates.like(F.col("text"), "Tion THE")).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT {COLUMNS} FROM tl WHERE bookmark = 1")
def bookmark_only(spark, sf):
    return _found(spark, sf, Request(bookmarked=True))


@query(f"SELECT {COLUMNS} FROM tl WHERE (\"desc\" ILIKE 'view%' AND filename ILIKE '%C:\\users%' AND \"offset\" = 0) OR \"user\" IN ('user3', 'it''s')")
def raw_where(spark, sf):
    where = "(desc LIKE 'view%' AND filename like '%C:\\users%' AND \"offset\" = 0) OR user IN ('user3', 'it''s')"
    return pages.matching(timeline(spark, sf), predicates.raw_where(where))


@query(f"SELECT {COLUMNS} FROM tl WHERE {REAL}")
def junk_dates_excluded(spark, sf):
    return pages.matching(timeline(spark, sf), predicates.real_dates())


@query("SELECT id, regexp_replace(\"desc\", '(?i)(value)', '<mark>\\1</mark>', 'g') AS marked FROM tl WHERE \"desc\" ILIKE '%value 1%'")
def keyword_highlight(spark, sf):
    rows = _found(spark, sf, Request([("desc", "LIKE", "VALUE 1")]))
    return rows.select("id", highlight(F.col("desc"), "VALUE").alias("marked"))


# -- pages


@query(f"SELECT {COLUMNS} FROM tl WHERE source = 'WEBHIST' ORDER BY datetime, id LIMIT 100 OFFSET 100")
def page_2(spark, sf):
    return pages.query(timeline(spark, sf), Request([("source", "=", "WEBHIST")], page=2, page_size=100))


@query(f"SELECT {COLUMNS} FROM tl WHERE datetime > '2024-01-15 00:00:00' OR (datetime = '2024-01-15 00:00:00' AND id > 7) ORDER BY datetime, id LIMIT 50")
def page_after_key(spark, sf):
    return pages.page_after(timeline(spark, sf), "2024-01-15 00:00:00", 7, 50)


@query(f"SELECT {COLUMNS} FROM (SELECT * FROM tl WHERE source = 'LOG' UNION ALL {NOTES_SQL}) ORDER BY datetime, id LIMIT 200")
def notes_union_page(spark, sf):
    return pages.query(timeline(spark, sf), Request([("source", "=", "LOG")], page_size=200), notes(spark, sf), "all")


@query(f"SELECT {COLUMNS} FROM (SELECT * FROM tl UNION ALL {NOTES_SQL}) WHERE \"desc\" ILIKE '%purchase%'")
def notes_filtered(spark, sf):
    return pages.matching(timeline(spark, sf), predicate(Request([("desc", "LIKE", "purchase")])), notes(spark, sf))


@query(f"SELECT {COLUMNS} FROM ({NOTES_SQL})")
def notes_as_events(spark, sf):
    return pages.ordered(pages.notes_as_events(notes(spark, sf)))


@query("SELECT n AS total, greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) AS pages FROM (SELECT (SELECT count(*) FROM tl WHERE source = 'REG') + (SELECT count(*) FROM nt) AS n)")
def count_total_with_notes(spark, sf):
    return pages.total(timeline(spark, sf), Request([("source", "=", "REG")], page_size=100), notes(spark, sf), "all")


@query("SELECT count(id) AS total FROM tl WHERE source = 'EVT'")
def count_events(spark, sf):
    return aggregates.count(timeline(spark, sf), F.col("source") == "EVT")


@query(f"SELECT {COLUMNS} FROM tl ORDER BY datetime, id LIMIT 50 OFFSET 700")
def page_by_number(spark, sf):
    return pages.page(timeline(spark, sf), 15, 50, deep=100)


@query(f"SELECT {COLUMNS} FROM tl ORDER BY host, id LIMIT 50 OFFSET 700")
def page_by_number_of_ties(spark, sf):
    return pages.page(timeline(spark, sf), 15, 50, "host", deep=100)


@query(f"SELECT * REPLACE (repeat('SOFTWARE', 20) || \"desc\" AS \"desc\") FROM tl ORDER BY \"desc\", id LIMIT 50 OFFSET (SELECT count(*) // 100 * 50 FROM tl)")
def page_by_number_of_text(spark, sf):
    """The middle page by texts that begin alike."""
    rows = timeline(spark, sf).withColumn("desc", F.concat(F.repeat(F.lit("SOFTWARE"), F.lit(20)), "desc"))
    return pages.page(rows, rows.count() // 100 + 1, 50, "desc", deep=100)


@query(f"SELECT {COLUMNS} FROM tl ORDER BY datetime, id LIMIT 64 OFFSET (SELECT (count(*) - 1) // 64 * 64 FROM tl)")
def last_page(spark, sf):
    return pages.last_page(timeline(spark, sf), 64, deep=100)


@query(f"SELECT {COLUMNS} FROM (SELECT * FROM tl WHERE \"desc\" ILIKE 'view%' AND bookmark = 1 UNION ALL {NOTES_SQL}) ORDER BY datetime, id LIMIT 100 OFFSET 100")
def raw_search_page(spark, sf):
    return pages.raw_query(timeline(spark, sf), "desc LIKE 'view%'", notes(spark, sf), 2, 100, bookmarked=True)


@query("SELECT (SELECT count(*) FROM tl WHERE source = 'REG') AS total, greatest(1, CAST(ceil((SELECT count(*) FROM tl WHERE source = 'REG') / 100.0) AS BIGINT)) AS pages")
def raw_search_total(spark, sf):
    return pages.raw_total(timeline(spark, sf), "source = 'REG'", notes(spark, sf), 100)


@query(f"SELECT {COLUMNS} FROM (SELECT * FROM tl UNION ALL {NOTES_SQL}) WHERE host = 'HOST1' OR tag ILIKE '%reviewed%' ORDER BY datetime, id LIMIT 30 OFFSET 30")
def saved_query_page(spark, sf):
    text = '{"filters": [{"field": "host", "operator": "=", "value": "HOST1"}, {"field": "tag", "operator": "LIKE", "value": "reviewed"}], "logic": "OR"}'
    return pages.saved_query(timeline(spark, sf), text, notes(spark, sf), 2, 30)


# -- aggregates


@query("SELECT value, count(*) AS frequency FROM (SELECT source AS value FROM tl UNION ALL SELECT 'EXAMINER' FROM nt) WHERE value != '' GROUP BY value")
def distinct_source_with_notes(spark, sf):
    return aggregates.distinct_values(timeline(spark, sf), "source", notes(spark, sf))


@query("SELECT value, count(*) AS frequency FROM (SELECT tag AS value FROM tl UNION ALL SELECT tag FROM nt) WHERE value != '' GROUP BY value")
def distinct_tag_lists(spark, sf):
    return aggregates.distinct_values(timeline(spark, sf), "tag", notes(spark, sf))


@query("SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(string_split(tag, ',')) AS t FROM tl) WHERE trim(t) != ''")
def distinct_tags(spark, sf):
    return aggregates.distinct_tags(timeline(spark, sf))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, \"{c}\" AS value, count(*) AS frequency FROM tl WHERE \"{c}\" != '' GROUP BY \"{c}\"" for c in FREQUENCY_COLUMNS))
def metadata_frequencies(spark, sf):
    return aggregates.frequencies(timeline(spark, sf))


@query(f"SELECT coalesce(min(datetime), '') AS min_date, coalesce(max(datetime), '') AS max_date FROM tl WHERE {REAL}")
def min_max_date(spark, sf):
    return aggregates.min_max_date(timeline(spark, sf))


@query(f"SELECT count(id) AS events, min(datetime) FILTER ({REAL}) AS min_date, max(datetime) FILTER ({REAL}) AS max_date FROM tl")
def db_info(spark, sf):
    return aggregates.summary(timeline(spark, sf))


@query(f"SELECT datetime[:13] || ':00:00' AS bucket, count(*) AS cnt FROM tl WHERE {REAL} AND datetime[:10] = '2024-01-10' GROUP BY 1")
def histogram_hour(spark, sf):
    return aggregates.histogram(timeline(spark, sf), Request([("datetime", ">=", "2024-01-10"), ("datetime", "<=", "2024-01-10")]))


@query(f"SELECT datetime[:10] AS bucket, count(*) AS cnt FROM tl WHERE {REAL} AND source = 'WEBHIST' GROUP BY 1")
def histogram_day(spark, sf):
    return aggregates.histogram(timeline(spark, sf), Request([("source", "=", "WEBHIST")]))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS cnt FROM orders GROUP BY 1", timeline_sql=False)
def histogram_month(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return aggregates.histogram(orders.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("datetime")))


@query(
    "SELECT DISTINCT b AS bucket, b || CASE length(b) WHEN 7 THEN '-01 00:00:00' WHEN 10 THEN ' 00:00:00' ELSE '' END AS first,"
    " CASE length(b) WHEN 7 THEN strftime(last_day(CAST(b || '-01' AS DATE)), '%Y-%m-%d') || ' 23:59:59' WHEN 10 THEN b || ' 23:59:59' ELSE b[:13] || ':59:59' END AS last"
    " FROM (SELECT unnest([strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d 07:00:00')]) AS b FROM orders)",
    timeline_sql=False,
)
def bucket_ranges(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    buckets = spark.read.parquet(f"{sf}/orders.parquet").select(F.explode(F.array(F.substring(day, 1, 7), day, F.concat(day, F.lit(" 07:00:00")))).alias("bucket")).distinct()
    first, last = bucket_bounds(F.col("bucket"))
    return buckets.select("bucket", first.alias("first"), last.alias("last"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS cnt FROM events GROUP BY 1", timeline_sql=False)
def live_histogram(spark, sf):
    path, name = f"{sf}/events.parquet", f"live_{uuid.uuid4().hex}"
    glob = f"{sf}/events.parque[t]"  # a stream takes a folder or a pattern, not a file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"))
    running = stream_histogram(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{_folder(spark)}/live").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "cnt")


@query(
    "WITH e AS (SELECT date_trunc('second', ts) AS t, date_trunc('hour', ts) AS h, ts < TIMESTAMP '2024-01-20' AND event_id % 5 != 0 AS early FROM events),"
    " m AS (SELECT max(t) FILTER (early) - INTERVAL 1 HOUR AS first, max(t) - INTERVAL 1 HOUR AS last FROM e)"
    " SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS cnt FROM e, m WHERE (early OR h + INTERVAL 1 HOUR > first) AND h + INTERVAL 1 HOUR <= last GROUP BY h",
    timeline_sql=False,
)
def live_histogram_late(spark, sf):
    """Events come in two lots, the second after a restart. It holds events of closed hours, which are dropped; each hour is written once."""
    rows, path = spark.read.parquet(f"{sf}/events.parquet"), _folder(spark)
    early = (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))) & (F.col("event_id") % 5 != 0)
    for lot in (early, ~early):
        rows.filter(lot).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime")).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("datetime string").parquet(f"{path}/in")
        write_histogram(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("bucket string, cnt long").parquet(f"{path}/out")


@query(
    "SELECT 'reg' AS name, CAST(count_if(source = 'REG') AS BIGINT) AS events FROM tl UNION ALL SELECT 'either', CAST(count_if(host = 'HOST1' OR tag ILIKE '%malware%') AS BIGINT) FROM tl"
    " UNION ALL SELECT 'raw', CAST(count_if(\"desc\" ILIKE 'click%') AS BIGINT) FROM tl UNION ALL SELECT 'all', count(*) FROM tl"
)
def saved_query_counts(spark, sf):
    texts = {
        "reg": '{"filters": [{"field": "source", "operator": "=", "value": "REG"}], "logic": "AND"}',
        "either": '{"filters": [{"field": "host", "operator": "=", "value": "HOST1"}, {"field": "tag", "operator": "LIKE", "value": "MALWARE"}], "logic": "OR"}',
        "raw": '{"advanced": true, "whereClause": "desc LIKE \'click%\'"}',
        "all": '{"filters": [], "logic": "AND"}',
    }
    return aggregates.saved_query_counts(timeline(spark, sf), {n: predicates.saved(t) for n, t in texts.items()})


@query(
    "SELECT 'host ' || h.range || ' site ' || s.range AS name, (SELECT count(*) FROM tl WHERE host = 'HOST' || h.range AND \"URL\" ILIKE '%site/' || s.range || '%') AS events FROM range(7) AS h, range(50) AS s"
    " UNION ALL SELECT 'raw ' || h.range, (SELECT count(*) FROM tl WHERE host = 'HOST' || h.range OR bookmark = 1) FROM range(7) AS h"
)
def saved_queries_many(spark, sf):
    """350 queries of a panel and seven raw ones, all in one scan."""
    panel = {f"host {h} site {k}": Request([("host", "=", f"HOST{h}"), ("URL", "LIKE", f"SITE/{k}")]) for h in range(7) for k in range(50)}
    raw = {f"raw {h}": predicates.raw_where(f"host = 'HOST{h}' OR bookmark = 1") for h in range(7)}
    return saved.counts(timeline(spark, sf), panel | raw)


# -- edits: every seventh event and every second note are named


def _ids(spark, sf):
    events = timeline(spark, sf).filter("id % 7 = 0").select("id")
    return events.unionByName(notes(spark, sf).filter("id % 2 = 0").select((-F.col("id")).alias("id")))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'GREEN' ELSE color END AS color FROM tl UNION ALL SELECT -id, CASE WHEN id % 2 = 0 THEN 'GREEN' ELSE color END FROM nt")
def bulk_color(spark, sf):
    e, n = edits.set_color(timeline(spark, sf), notes(spark, sf), _ids(spark, sf), "GREEN")
    return e.select("id", "color").unionByName(n.select((-F.col("id")).alias("id"), "color"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE bookmark END AS bookmark FROM tl UNION ALL SELECT -id, CASE WHEN id % 2 = 0 THEN 1 ELSE bookmark END FROM nt")
def bulk_bookmark(spark, sf):
    e, n = edits.set_bookmark(timeline(spark, sf), notes(spark, sf), _ids(spark, sf), True)
    return e.select("id", "bookmark").unionByName(n.select((-F.col("id")).alias("id"), "bookmark"))


@query("SELECT id, CASE WHEN id % 7 != 0 THEN tag WHEN tag = '' THEN 'MALWARE' WHEN lower(tag) = 'malware' THEN tag ELSE tag || ',MALWARE' END AS tag FROM tl")
def bulk_add_tag(spark, sf):
    return edits.add_tag(timeline(spark, sf), _ids(spark, sf), "MALWARE").select("id", "tag")


@query("SELECT id, CASE WHEN id % 7 != 0 THEN bookmark WHEN bookmark = 1 THEN 0 ELSE 1 END AS bookmark FROM tl")
def toggle_bookmark(spark, sf):
    return edits.toggle_bookmark(timeline(spark, sf), timeline(spark, sf).filter("id % 7 = 0").select("id")).select("id", "bookmark")


@query("SELECT id, CASE WHEN id % 7 != 0 THEN bookmark WHEN bookmark = 1 THEN 0 ELSE 1 END AS bookmark FROM tl UNION ALL SELECT -id, CASE WHEN id % 2 != 0 THEN bookmark WHEN bookmark = 1 THEN 0 ELSE 1 END FROM nt")
def toggle_bookmarks(spark, sf):
    e, n = edits.toggle_bookmarks(timeline(spark, sf), notes(spark, sf), _ids(spark, sf))
    return e.select("id", "bookmark").unionByName(n.select((-F.col("id")).alias("id"), "bookmark"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'note ' || id ELSE notes END AS notes, CASE WHEN id % 5 = 0 THEN 'LATER' ELSE color END AS color, \"desc\" FROM tl")
def update_fields(spark, sf):
    named = timeline(spark, sf).filter("id % 5 = 0").select("id")
    rows = [named.select("id", F.lit("color").alias("field"), F.lit(v).alias("value"), F.lit(k).alias("seq")) for k, v in enumerate(("FIRST", "LATER"))]
    rows.append(named.select("id", F.lit("notes").alias("field"), F.concat(F.lit("note "), F.col("id")).alias("value"), F.lit(9).alias("seq")))
    return edits.update_fields(timeline(spark, sf), rows[0].unionByName(rows[1]).unionByName(rows[2])).select("id", "notes", "color", "desc")


@query("SELECT id, CASE host WHEN 'HOST1' THEN 'HOT' WHEN 'HOST2' THEN 'COLD' ELSE color END AS color FROM tl")
def color_template(spark, sf):
    template = timeline(spark, sf).filter("host IN ('HOST1', 'HOST2')").select(F.lit("host").alias("field"), F.col("host").alias("key"), F.when(F.col("host") == "HOST1", "HOT").otherwise("COLD").alias("color")).distinct()
    return edits.apply_color_template(timeline(spark, sf), template, "host").select("id", "color")


@query("SELECT id, description FROM nt WHERE id % 2 != 0")
def delete_notes(spark, sf):
    return edits.delete_notes(notes(spark, sf), _ids(spark, sf)).select("id", "description")


@query("SELECT * EXCLUDE n FROM (SELECT description, tag, color, bookmark, CAST(1 AS BIGINT) AS n FROM nt UNION ALL SELECT 'from ' || id, '', '', 0, 1 FROM tl WHERE id % 1000 = 0)")
def add_notes(spark, sf):
    new = timeline(spark, sf).filter("id % 1000 = 0").select(F.lit("2024-02-01 00:00:00").alias("datetime"), F.concat(F.lit("from "), F.col("id")).alias("description"))
    return edits.add_notes(notes(spark, sf), new).select("description", "tag", "color", "bookmark")


# -- sinks


@query("SELECT " + ", ".join(f'"{c}"' for c in EXPORT_COLUMNS) + f" FROM tl WHERE source = 'LOG' AND {IN_DAYS}")
def export_rows(spark, sf):
    return store.export_rows(_found(spark, sf, Request([("source", "=", "LOG")], date_from=DAY[0], date_to=DAY[1])))


@query("SELECT id, TRY_CAST(CASE WHEN datetime LIKE '0000%' THEN NULL ELSE datetime END AS TIMESTAMP) AS datetime, \"desc\" FROM tl")
def push_sanitised(spark, sf):
    rows = timeline(spark, sf).withColumn("desc", F.concat("desc", F.lit("\0")))
    return store.sanitised(rows).select("id", "datetime", "desc")


# -- stores: the timeline is appended to a store, which numbers its rows anew; record_number tells them


EVENT_SQL = ", ".join(f'"{c}"' for c in EVENT_COLUMNS)


@query(f"SELECT {EVENT_SQL} FROM tl WHERE source = 'WEBHIST' AND {IN_DAYS}")
def stored_date_range(spark, sf):
    request = Request([("source", "=", "WEBHIST")], date_from=DAY[0], date_to=DAY[1])
    return pages.found(store.open_parquet(spark, _stored(spark, sf)), request).select(*EVENT_COLUMNS)


@query(f"SELECT datetime[:10] AS bucket, count(*) AS cnt FROM tl WHERE {REAL} AND {IN_DAYS} GROUP BY 1")
def stored_histogram(spark, sf):
    return aggregates.histogram(store.open_parquet(spark, _stored(spark, sf)), Request(date_from=DAY[0], date_to=DAY[1]))


@query(f"SELECT {EVENT_SQL} FROM tl WHERE " + " OR ".join(f"\"{c}\" ILIKE '%SITE/4%'" for c in SEARCH_COLUMNS))
def stored_keyword_search(spark, sf):
    """A keyword in a store whose texts are indexed: only files that may hold it are read."""
    path, request = _stored(spark, sf), Request(search="SITE/4")
    store.index_texts(spark, path)
    return pages.found(store.open_for(spark, path, request), request).select(*EVENT_COLUMNS)


_EDITED = "SELECT record_number, CASE WHEN id % 50 = 3 THEN 'EDITED' ELSE color END AS color, CASE WHEN id % 100 = 3 THEN '2024-03-03 00:00:00' ELSE datetime END AS datetime, \"desc\" FROM tl"


def _store_changes(spark: SparkSession, path: str) -> DataFrame:
    """Colors and days of some events."""
    named = store.open_parquet(spark, path).withColumn("n", F.col("record_number").cast("long") + 1)
    colors = named.filter("n % 50 = 3").select("id", F.lit("color").alias("field"), F.lit("EDITED").alias("value"), F.lit(1).alias("seq"))
    times = named.filter("n % 100 = 3").select("id", F.lit("datetime").alias("field"), F.lit("2024-03-03 00:00:00").alias("value"), F.lit(1).alias("seq"))
    return colors.unionByName(times)


@query(_EDITED)
def stored_edits(spark, sf):
    path = _stored(spark, sf)
    store.apply_edits(spark, path, _store_changes(spark, path))
    return store.open_parquet(spark, path).select("record_number", "color", "datetime", "desc")


@query(_EDITED)
def stored_edits_rerun(spark, sf):
    """Edits whose job ends right after their commit, and the same edits once more."""
    path = _stored(spark, sf)
    store.prepare_edits(spark, path, _store_changes(spark, path))
    store.apply_edits(spark, path, _store_changes(spark, path))
    return store.open_parquet(spark, path).select("record_number", "color", "datetime", "desc")


def _edited(column: str) -> str:
    return "CASE WHEN id % 50 = 3 THEN 'EDITED' ELSE color END" if column == "color" else f'"{column}"'


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {_edited(c)} AS value, count(*) AS frequency FROM tl WHERE {_edited(c)} != '' GROUP BY {_edited(c)}" for c in FREQUENCY_COLUMNS))
def stored_counts(spark, sf):
    """Counts of values as a store's changes keep them, without a full count."""
    path = _stored(spark, sf)
    store.apply_edits(spark, path, _store_changes(spark, path))
    return store.metadata(spark, path)[0]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, \"{c}\" AS value, 2 * count(*) AS frequency FROM tl WHERE \"{c}\" != '' GROUP BY \"{c}\"" for c in FREQUENCY_COLUMNS))
def stored_metadata(spark, sf):
    path = _stored(spark, sf)
    store.append(timeline(spark, sf), path)
    store.refresh_metadata(spark, path)
    return store.metadata(spark, path)[0]


def _rendered(spark, sf) -> str:
    """The timeline as files: a third each as TLN, JSON lines and CSV with line breaks in it."""
    rows, path = _with_epoch(spark, sf).withColumn("iso", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")), _folder(spark)
    line = F.concat_ws("|", F.when(F.col("id") % 13 == 0, F.lit("abc")).otherwise(F.col("epoch").cast("string")), "source", "host", "user", "desc")
    rows.filter("id % 3 = 0").select(line.alias("value")).write.text(f"{path}/tln")
    rows.filter("id % 3 = 1").select(F.col("iso").alias("datetime"), F.col("source").alias("source_short"), F.col("host").alias("hostname"), F.col("desc").alias("message")).write.json(f"{path}/jsonl")
    broken = F.concat("desc", F.when(F.col("id") % 2 == 0, F.lit('\n"second", line')).otherwise(""))
    rows.filter("id % 3 = 2").select(F.col("iso").alias("datetime"), "source", "host", broken.alias("message")).write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    return path


_WHEN = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime"


_IMPORTED = (
    f"SELECT {_WHEN}, source, host, \"desc\" || CASE WHEN id % 6 = 2 THEN chr(10) || '\"second\", line' ELSE '' END AS \"desc\" FROM (SELECT tl.*, ts FROM tl JOIN events ON id = event_id + 1)"
    " WHERE NOT (id % 3 = 0 AND id % 13 = 0)"
)


@query(_IMPORTED)
def import_files(spark, sf):
    path = _rendered(spark, sf)
    store.import_files(spark, [f"{path}/{kind}" for kind in ("tln", "jsonl", "csv")], f"{path}/store")
    return store.open_parquet(spark, f"{path}/store").select("datetime", "source", "host", "desc")


@query(_IMPORTED)
def import_files_again(spark, sf):
    """An import of two kinds of files, then one of all of them: nothing stands twice."""
    path = _rendered(spark, sf)
    store.import_files(spark, [f"{path}/{kind}" for kind in ("tln", "csv")], f"{path}/store")
    store.import_files(spark, [f"{path}/{kind}" for kind in ("tln", "jsonl", "csv")], f"{path}/store")
    return store.open_parquet(spark, f"{path}/store").select("datetime", "source", "host", "desc")


@query(
    "SELECT CASE id % 3 WHEN 0 THEN 'tln' WHEN 1 THEN 'jsonl' ELSE 'dynamic' END AS import_format, CAST(count_if(NOT (id % 3 = 0 AND id % 13 = 0)) AS BIGINT) AS events,"
    " CAST(count_if(id % 3 = 0 AND id % 13 = 0) AS BIGINT) AS excluded FROM tl GROUP BY 1"
)
def detect_formats(spark, sf):
    path = _rendered(spark, sf)
    found = imports.summary(imports.read_all(spark, [f"{path}/{kind}" for kind in ("tln", "jsonl", "csv")]))
    return found.groupBy("import_format").agg(F.sum("events").alias("events"), F.sum("excluded").alias("excluded"))


@query("SELECT id, CASE WHEN host = 'HOST1' THEN 'WHITE' ELSE 'OF ' || host END AS color FROM tl")
def color_template_csv(spark, sf):
    path = f"{_folder(spark)}/colors"
    hosts = timeline(spark, sf).select("host").distinct()
    hosts.select("host", F.when(F.col("host") != "HOST1", F.concat(F.lit("OF "), F.col("host"))).alias("colorcode")).write.option("header", True).csv(path)
    return edits.apply_color_template(timeline(spark, sf), store.read_color_template(spark, path), "host").select("id", "color")


@query("SELECT s.source AS name, (SELECT count(*) FROM tl WHERE tl.source = s.source OR bookmark = 1) AS events FROM (SELECT DISTINCT source FROM tl) AS s")
def saved_queries_csv(spark, sf):
    path = f"{_folder(spark)}/queries"
    sources = timeline(spark, sf).select(F.col("source").alias("Name")).distinct()
    sql = F.concat(F.lit("source = '"), F.col("Name"), F.lit("'\nOR bookmark = 1"))
    sources.select("Name", sql.alias("SQL"), *[F.lit("").alias(c) for c in store.SAVED_COLUMNS[2:]]).coalesce(1).write.option("header", True).csv(path)
    named = {r.Name: predicates.raw_where(r.SQL) for r in store.read_saved_queries(spark, path).collect()}  # a row a saved query
    return aggregates.saved_query_counts(timeline(spark, sf), named)


# -- sources: lines are rendered from the timeline, then parsed; the SQL never parses


_M2 = "CASE id % 5 WHEN 1 THEN 'M...' WHEN 2 THEN '.A..' WHEN 3 THEN '..C.' WHEN 4 THEN '...B' ELSE '....' END"
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _with_epoch(spark, sf):
    return timeline(spark, sf, ("epoch",))


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """Rendered lines, dealt to all tasks as large files would be. Conditions on lines stay behind the explode, so each line is rendered once."""
    dealt = rows.select(F.array(line).alias("lines")).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.select(F.explode_outer("lines").alias("value"))


@query(f"SELECT strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS datetime, source, host, \"user\", type, {_M2} AS \"MACB\", \"desc\" || ' | ' || id AS \"desc\", 'UTC' AS timezone FROM (SELECT tl.*, {_SECONDS} AS e FROM tl JOIN events ON id = event_id + 1) WHERE id % 13 != 0")
def read_tln(spark, sf):
    bad = F.when(F.col("id") % 13 == 0, F.lit("abc")).otherwise(F.col("epoch").cast("string"))
    line = F.concat_ws("|", bad, "source", "host", "user", F.concat_ws("; ", "datetime", "type", F.concat("desc", F.lit(" | "), F.col("id"))))
    out = tln.lines_to_events(_lines(_with_epoch(spark, sf), line), 5)
    return out.filter("ok").select("datetime", "source", "host", "user", "type", "MACB", "desc", "timezone")


@query("SELECT CASE WHEN id % 2 = 0 THEN 'UTC' ELSE 'America/New_York' END AS timezone, CASE WHEN id % 3 = 0 THEN '' ELSE 'File: ' || filename || CASE WHEN id % 3 = 1 THEN ' inode: ' || id ELSE '' END END AS notes, CASE WHEN id % 3 = 0 THEN '' ELSE filename END AS filename, CASE WHEN id % 3 = 1 THEN CAST(id AS VARCHAR) ELSE '' END AS inode, \"desc\", 'Not a time' AS datetime FROM tl")
def read_l2ttln(spark, sf):
    n = F.col("id")
    note = F.when(n % 3 == 0, F.lit("-")).otherwise(F.concat(F.lit("File: "), F.col("filename"), F.when(n % 3 == 1, F.concat(F.lit(" inode: "), n)).otherwise("")))
    line = F.concat_ws("|", F.lit("0"), "source", "host", "user", "desc", F.when(n % 2 == 0, "-").otherwise("America/New_York"), note)
    out = tln.lines_to_events(_lines(timeline(spark, sf), line), 7)
    return out.select("timezone", "notes", "filename", "inode", "desc", "datetime")


@query("SELECT CASE WHEN datetime LIKE '2%' THEN datetime ELSE '0000-00-00 00:00:00' END AS datetime, source, \"user\", \"desc\", filename, CAST(-1 AS BIGINT) AS store_number, extra FROM tl")
def read_l2t_csv(spark, sf):
    day = F.substring("datetime", 1, 10)
    real = F.col("datetime").startswith("2")
    us = F.when(real, F.concat_ws("/", F.substring("datetime", 6, 2), F.substring("datetime", 9, 2), F.substring("datetime", 1, 4))).otherwise("garbage")
    cells = timeline(spark, sf).select(
        F.when(F.col("id") % 2 == 0, us).otherwise(day).alias("date"), F.when(real, F.substring("datetime", 12, 8)).otherwise("x").alias("time"), "timezone", "MACB", "source", "sourcetype", "type",
        F.concat("user", F.lit("\0")).alias("user"), "host", F.lit("short").alias("short"), "desc", F.lit("2").alias("version"), "filename", F.lit(None).cast("string").alias("inode"), "notes", "format", "extra",
    )
    return l2t.cells_to_events(cells).select("datetime", "source", "user", "desc", "filename", "store_number", "extra")


@query("SELECT datetime, source, \"desc\" FROM tl WHERE datetime[:10] > '2024-01-05' AND datetime[:10] < '2024-01-09'")
def l2t_window(spark, sf):
    return l2t.in_window(timeline(spark, sf), "2024-01-05", "2024-01-09").select("datetime", "source", "desc")


@query("SELECT host AS file, CAST(count_if(datetime[:10] > '2024-01-05' AND datetime[:10] < '2024-01-09') AS BIGINT) AS events, CAST(count_if(NOT (datetime[:10] > '2024-01-05' AND datetime[:10] < '2024-01-09')) AS BIGINT) AS excluded FROM tl GROUP BY host")
def l2t_window_summary(spark, sf):
    marked = l2t.mark_window(timeline(spark, sf), "2024-01-05", "2024-01-09")
    return imports.summary(marked.withColumn("file", F.col("host")).withColumn("import_format", F.lit("l2t"))).drop("import_format")


@query(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, 'UTC' AS timezone, CASE WHEN id % 2 = 0 THEN 'FILE' ELSE 'CUSTOM' END AS source, CASE WHEN id % 2 = 0 THEN 'NTFS File stat' ELSE 'custom:thing:x' END AS sourcetype,"
    " type, CASE id % 5 WHEN 1 THEN 'M...' WHEN 2 THEN '.A..' WHEN 3 THEN '..C.' WHEN 4 THEN '...B' ELSE '' END AS \"MACB\", \"user\", filename, 'a, b' AS tag, 'alpha: ' || id || '; zeta: true' AS extra, id AS store_number, CAST(id AS VARCHAR) AS event_identifier FROM (SELECT tl.*, ts FROM tl JOIN events ON id = event_id + 1)"
)
def read_jsonl_raw(spark, sf):
    n = F.col("id")
    micros = F.col("epoch") * 1_000_000
    line = F.to_json(
        F.struct(
            F.when(n % 2 == 0, "fs:stat:ntfs").otherwise("custom:thing:x").alias("data_type"),
            F.struct(F.when(n % 4 < 2, "Filetime").otherwise("PosixTimeInMicroseconds").alias("__class_name__"), F.when(n % 4 < 2, micros * 10 + 116444736000000000).otherwise(micros).alias("timestamp")).alias("date_time"),
            F.col("type").alias("timestamp_desc"), F.col("user").alias("username"), F.col("filename").alias("display_name"), F.expr("array('a', 'b')").alias("tag_list"),
            F.lit(True).alias("zeta"), n.alias("alpha"), F.struct(n.alias("x")).alias("nested"), n.cast("string").alias("store_number"), n.alias("event_identifier"), F.lit("T").alias("__type__"),
        )
    )
    out = jsonl.lines_to_events(_lines(_with_epoch(spark, sf), line))
    return out.select("datetime", "timezone", "source", "sourcetype", "type", "MACB", "user", "filename", "tag", "extra", "store_number", "event_identifier")


@query("SELECT strftime(CASE WHEN id % 3 = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS datetime, source, sourcetype, \"desc\", host, tag, CASE WHEN id % 11 = 0 THEN 0 ELSE id END AS \"offset\", \"URL\" FROM (SELECT tl.*, ts FROM tl JOIN events ON id = event_id + 1) WHERE id % 17 != 0")
def read_jsonl_psort(spark, sf):
    n = F.col("id")
    iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    line = F.to_json(
        F.struct(
            F.when(n % 3 == 0, F.concat(iso, F.lit("Z"))).when(n % 3 == 1, F.concat(iso, F.lit("+02:00"))).alias("datetime"), (F.col("epoch") * 1_000_000).alias("timestamp"),
            F.when(n % 2 == 0, F.col("source")).alias("source_short"), F.when(n % 2 == 1, F.col("source")).alias("source"), F.col("sourcetype").alias("source_long"),
            F.col("desc").alias("message"), F.col("host").alias("computer_name"), "tag", F.when(n % 11 == 0, "x").otherwise(n.cast("string")).alias("offset"), F.col("URL").alias("url"),
        )
    )
    lines = _lines(_with_epoch(spark, sf), F.when(n % 17 == 0, F.lit("{broken")).otherwise(line))
    return jsonl.lines_to_events(lines).filter("ok").select("datetime", "source", "sourcetype", "desc", "host", "tag", "offset", "URL")


@query("SELECT CASE WHEN datetime LIKE '2%' THEN datetime WHEN datetime LIKE '0%' THEN '' ELSE datetime END AS datetime, type, CASE WHEN id % 2 = 0 THEN 'MACB' ELSE " + _M2 + " END AS \"MACB\", source, \"user\", \"desc\", 'UTC' AS timezone, 'Odd Name: ' || id || '; unknown: more' AS extra FROM tl")
def read_dynamic_csv(spark, sf):
    header = ["MACB", "Date", "timestamp_desc", "Source", "username", "message", "desc", "Odd Name"]
    when = F.when(F.col("datetime").startswith("2"), F.concat(F.translate("datetime", " ", "T"), F.lit(".123+02:00"))).when(F.col("datetime").startswith("0"), "0000-00-00T00:00:00+00:00").otherwise(F.col("datetime"))
    values = [F.when(F.col("id") % 2 == 0, "MACB").otherwise(""), when, F.concat(F.lit(" "), F.col("type")), F.col("source"), F.col("user"), F.col("desc"), F.lit("-"), F.col("id").cast("string"), F.lit("more")]
    cells = timeline(spark, sf).select(*[v.alias(n) for v, n in zip(values, dynamic.cell_names(header, 1), strict=True)])
    return dynamic.cells_to_events(cells, header).select("datetime", "type", "MACB", "source", "user", "desc", "timezone", "extra")


def _files(rows: DataFrame, header: str, line: Column, path: str) -> str:
    """Text files of lines, each with the header in front."""
    dealt = rows.select(line.alias("line")).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    dealt.select(F.concat(F.when(first, header + "\n").otherwise(""), "line").alias("value")).write.text(path)
    return path


_SPARE = "CASE WHEN id % 2000 = 7 THEN 20000 WHEN id % 200 = 9 THEN 200 WHEN id % 20 = 11 THEN 9 ELSE 0 END"


@query(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, source, \"desc\" || CASE WHEN id % 3 = 0 THEN chr(10) || 'more \"of it\", and on' ELSE '' END AS \"desc\","
    f" array_to_string(list_transform(range({_SPARE}), lambda k: 'unknown: ' || (id + k % 7)), '; ') AS extra FROM (SELECT tl.*, ts FROM tl JOIN events ON id = event_id + 1)"
)
def ragged_csv_files(spark, sf):
    """CSV files with line breaks in quotes and up to 20,000 cells beyond the header."""
    iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(F.lit('"'), "desc", F.when(F.col("id") % 3 == 0, '\nmore ""of it"", and on').otherwise(""), F.lit('"'))
    n = F.when(F.col("id") % 2000 == 7, 20000).when(F.col("id") % 200 == 9, 200).when(F.col("id") % 20 == 11, 9).otherwise(0)
    spare = F.transform(F.slice(F.sequence(F.lit(0), F.lit(19_999)), F.lit(1), n), lambda k: F.concat(F.lit(", "), (F.col("id") + k % 7).cast("string")))
    line = F.concat_ws(",", iso, "source", F.concat(text, F.array_join(spare, "")))
    path = _files(_with_epoch(spark, sf), "datetime,source,message", line, f"{_folder(spark)}/csv")
    return imports.read_all(spark, [path]).select("datetime", "source", "desc", "extra")


@query(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, source, \"user\", \"desc\" || CASE WHEN id % 4 = 0 THEN chr(10) || 'second' ELSE '' END AS \"desc\", 'a, \"b\"' AS notes, CAST(-1 AS BIGINT) AS store_number"
    " FROM (SELECT tl.*, ts FROM tl JOIN events ON id = event_id + 1) WHERE strftime(ts, '%Y-%m-%d') > '2024-01-05' AND strftime(ts, '%Y-%m-%d') < '2024-01-20'"
)
def import_l2t_files(spark, sf):
    """L2T files with line breaks in quotes, imported into a store within a window of dates."""
    t = F.timestamp_seconds("epoch")
    desc = F.concat(F.lit('"'), "desc", F.when(F.col("id") % 4 == 0, "\nsecond").otherwise(""), F.lit('"'))
    own = {"date": F.date_format(t, "MM/dd/yyyy"), "time": F.date_format(t, "HH:mm:ss"), "desc": desc, "notes": F.lit('"a, ""b"""'), "short": F.lit("x"), "version": F.lit("2"), "extra": F.lit("")}
    line = F.concat_ws(",", *[own[c] if c in own else F.col(c) for c in l2t.COLUMNS])
    path = _folder(spark)
    _files(_with_epoch(spark, sf), ",".join(l2t.COLUMNS), line, f"{path}/csv")
    store.import_files(spark, [f"{path}/csv"], f"{path}/store", "2024-01-05", "2024-01-20")
    return store.open_parquet(spark, f"{path}/store").select("datetime", "source", "user", "desc", "notes", "store_number")


@query("SELECT host AS file, CAST(count_if(id % 13 != 0) AS BIGINT) AS events, CAST(count_if(id % 13 = 0) AS BIGINT) AS excluded FROM tl GROUP BY host")
def import_summary(spark, sf):
    from chronoforge.sources.imports import summary

    bad = F.when(F.col("id") % 13 == 0, F.lit("abc")).otherwise("1")
    lines = timeline(spark, sf).select(F.concat_ws("|", bad, "source", "host", "user", "desc").alias("value"), F.col("host").alias("file"))
    return summary(tln.lines_to_events(lines, 5, ("file",)).withColumn("import_format", F.lit("tln"))).drop("import_format")


# -- row functions


def _macb_sql(words: dict[str, str], none: str) -> str:
    flags = " || ".join(f"CASE WHEN regexp_matches(lower(d), '{w}') THEN '{k}' ELSE '.' END" for k, w in words.items())
    return f"SELECT id, CASE WHEN {flags} = '....' THEN '{none}' ELSE {flags} END AS macb FROM (SELECT id, type || ' ' || \"desc\" || CASE WHEN id % 4 = 0 THEN ' Visited MFT Entry' ELSE '' END AS d FROM tl)"


def _described(spark, sf):
    return timeline(spark, sf).select("id", F.concat(F.col("type"), F.lit(" "), F.col("desc"), F.when(F.col("id") % 4 == 0, " Visited MFT Entry").otherwise("")).alias("d"))


@query(_macb_sql(MACB_JSON, ""))
def macb_jsonl(spark, sf):
    return _described(spark, sf).select("id", macb(F.col("d"), MACB_JSON, "").alias("macb"))


@query(_macb_sql(MACB_OTHER, "...."))
def macb_tln(spark, sf):
    return _described(spark, sf).select("id", macb(F.col("d"), MACB_OTHER).alias("macb"))


_TYPES = [*SOURCES, "fs:stat:odd", "new:thing:x", "single", ""]


@query(
    "SELECT id, coalesce(m.s, n.s, upper(split_part(d, ':', 1))) AS source, coalesce(m.t, n.t, d) AS sourcetype FROM (SELECT id, (["
    + ", ".join(f"'{t}'" for t in _TYPES) + f"])[id % {len(_TYPES)} + 1] AS d FROM tl)"
    + "".join(
        f" LEFT JOIN (VALUES {', '.join(f"('{k}', '{s}', '{t}')" for k, (s, t) in SOURCES.items())}) AS {a}(k, s, t) ON {a}.k = {on}"
        for a, on in (("m", "d"), ("n", "split_part(d, ':', 1) || ':' || split_part(d, ':', 2)"))
    )
)
def source_mapping(spark, sf):
    d = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("id") % len(_TYPES) + 1).cast("int"))
    return timeline(spark, sf).select("id", source_of(d).alias("s")).select("id", "s.source", "s.sourcetype")


@query("SELECT id, strftime(ts, '%Y-%m-%d') AS us, strftime(ts, '%Y-%m-%d') AS iso, '0000-00-00' AS bad, strftime(ts, '%H:%M:%S') AS clock, '00:00:00' AS bad_clock FROM tl JOIN events ON id = event_id + 1")
def l2t_times(spark, sf):
    t = F.timestamp_seconds("epoch")
    return _with_epoch(spark, sf).select(
        "id", l2t_date(F.date_format(t, "MM/dd/yyyy")).alias("us"), l2t_date(F.date_format(t, "yyyy-MM-dd")).alias("iso"), l2t_date(F.date_format(t, "dd.MM.yyyy")).alias("bad"),
        l2t_time(F.date_format(t, "HH:mm:ss")).alias("clock"), l2t_time(F.concat(F.lit("99:"), F.col("id"))).alias("bad_clock"),
    )


@query("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS filetime, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS cut FROM tl JOIN events ON id = event_id + 1")
def time_conversions(spark, sf):
    iso = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")
    return _with_epoch(spark, sf).select(
        "id", filetime_text(F.col("epoch") * 10_000_000 + 116444736000000000).alias("filetime"), iso_to_utc(F.concat(iso, F.lit(".5+02:00"))).alias("utc"), drop_offset(F.concat(iso, F.lit(".5+02:00"))).alias("cut")
    )
