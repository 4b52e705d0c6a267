"""Event rows and notes derived from a table of user events: a timeline of any size to run queries on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, as_events

MACB_TEXTS = ["Content Modification Time", "Last Access Time", "Metadata Change Time", "Creation Time", "Unknown Time"]
TAGS = ["malware", "suspicious, lateral_movement", "Malware"]
COLORS = ["RED", "BLUE"]


def timeline(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and the event columns; keep may add epoch, the real time in seconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, kind = F.col("event_id"), F.col("event_type")
    date = F.when(n % 97 == 0, "0000-00-00 00:00:00").when(n % 101 == 0, "Not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    web = kind.isin("view", "click")
    pick = lambda texts, k: F.coalesce(F.try_element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int")), F.lit(""))
    values = {
        "datetime": date, "timezone": F.lit("UTC"),
        "source": F.when(web, "WEBHIST").when(kind == "signup", "REG").when(kind == "purchase", "LOG").otherwise("EVT"),
        "sourcetype": kind, "type": pick(MACB_TEXTS, n % 5), "user": F.concat(F.lit("user"), F.col("user_id")), "host": F.concat(F.lit("HOST"), F.col("user_id") % 7),
        "filename": F.concat(F.lit("C:\\Users\\user"), F.col("user_id"), F.lit("\\"), kind),
        "desc": F.concat(kind, F.lit(" value "), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")),
        "extra": F.col("props"), "URL": F.when(web, F.concat(F.lit("http://site/"), n % 50)), "tag": pick(TAGS, n % 11), "color": pick(COLORS, n % 13),
        "bookmark": (n % 10 == 0).cast("long"), "record_number": n.cast("string"),
    }
    return as_events(e.withColumn("id", n + 1).withColumn("epoch", F.unix_timestamp(F.col("ts").cast("timestamp"))), values, ("id", *keep))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 500 = 0")
    n = F.col("event_id")
    return e.select(
        F.expr("event_id div 500 + 1").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.concat(F.lit("note on "), F.col("event_type")).alias("description"),
        F.when(n % 1000 == 0, "reviewed").otherwise("").alias("tag"), F.lit("").alias("color"), F.lit(0).cast("long").alias("bookmark"),
    )


_NAMES = {
    "datetime": "CASE WHEN event_id % 97 = 0 THEN '0000-00-00 00:00:00' WHEN event_id % 101 = 0 THEN 'Not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END",
    "timezone": "'UTC'",
    "source": "CASE WHEN event_type IN ('view', 'click') THEN 'WEBHIST' WHEN event_type = 'signup' THEN 'REG' WHEN event_type = 'purchase' THEN 'LOG' ELSE 'EVT' END",
    "sourcetype": "event_type",
    "type": "(['Content Modification Time', 'Last Access Time', 'Metadata Change Time', 'Creation Time', 'Unknown Time'])[event_id % 5 + 1]",
    "user": "'user' || user_id",
    "host": "'HOST' || user_id % 7",
    "filename": "'C:\\Users\\user' || user_id || '\\' || event_type",
    "desc": "event_type || ' value ' || CAST(round(coalesce(value, 0) * 100) AS BIGINT)",
    "extra": "coalesce(props, '')",
    "URL": "CASE WHEN event_type IN ('view', 'click') THEN 'http://site/' || event_id % 50 ELSE '' END",
    "tag": "coalesce((['malware', 'suspicious, lateral_movement', 'Malware'])[event_id % 11 + 1], '')",
    "color": "coalesce((['RED', 'BLUE'])[event_id % 13 + 1], '')",
    "bookmark": "CAST(event_id % 10 = 0 AS BIGINT)",
    "record_number": "CAST(event_id AS VARCHAR)",
}
_INTS = ("offset", "store_number", "store_index", "vss_store_number")
#: The same two tables, tl and nt, as SQL.
TIMELINE_SQL = (
    "WITH tl AS (SELECT event_id + 1 AS id, "
    + ", ".join(f'{_NAMES.get(c, "CAST(0 AS BIGINT)" if c in _INTS else "''")} AS "{c}"' for c in EVENT_COLUMNS)
    + " FROM events), nt AS (SELECT event_id // 500 + 1 AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, 'note on ' || event_type AS description, "
    "CASE WHEN event_id % 1000 = 0 THEN 'reviewed' ELSE '' END AS tag, '' AS color, CAST(0 AS BIGINT) AS bookmark FROM events WHERE event_id % 500 = 0) "
)
#: Notes as events, as SQL.
NOTES_SQL = "SELECT -id AS id, " + ", ".join(
    {"datetime": "datetime", "source": "'EXAMINER' AS source", "sourcetype": "'Examiner Note' AS sourcetype", "desc": 'description AS "desc"', "tag": "tag", "color": "color", "bookmark": "bookmark"}.get(
        c, f'CAST(0 AS BIGINT) AS "{c}"' if c in _INTS else f"'' AS \"{c}\""
    )
    for c in EVENT_COLUMNS
) + " FROM nt"
