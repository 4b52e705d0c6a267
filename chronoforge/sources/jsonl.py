"""JSON lines, raw storage rows and formatted rows; which is decided row by row.

A line is parsed once, to VARIANT: the parsed value passes through a generator, which Spark neither repeats
in later expressions nor filters ahead of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.data_types import source_of
from chronoforge.functions.schema import as_events
from chronoforge.functions.text import MACB_JSON, macb
from chronoforge.functions.times import date_time_object, iso_to_utc, micros_text

# Keys that have a place of their own, or none at all.
NOT_EXTRA = [
    "timestamp", "datetime", "timestamp_desc", "date_time", "source_short", "source_long", "source", "data_type", "message", "display_name",
    "filename", "inode", "parser", "hostname", "username", "computer_name", "event_identifier", "event_type", "source_name", "user_sid",
    "record_number", "store_number", "store_index", "vss_store_number", "offset", "url", "zone", "inode_number", "path_separator", "tag", "tag_list",
    "__container_type__", "__type__", "pathspec",
]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def _whole(v: Column) -> Column:
    """A number cut to a whole one, exact in the range of long."""
    return F.when(_is_number(v), F.coalesce(F.try_variant_get(v, "$", "decimal(38,6)").try_cast("long"), F.try_variant_get(v, "$", "double").try_cast("long")))


def as_text(v: Column) -> Column:
    """A JSON value as text: whole numbers without a fraction, null as ''."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    # only what reads like a number with a fraction or exponent needs its kind looked up
    whole = text.rlike(r"^-?\d+[.E]") & _is_number(v) & (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return F.coalesce(F.when(whole, _whole(v).cast("string")).otherwise(text), F.lit(""))


def as_long(v: Column) -> Column:
    text = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string").try_cast("long"))
    return F.coalesce(_whole(v), text, F.lit(0))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with one more column, whose expression Spark evaluates once a row."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def lines_to_events(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of a column ``value``; a column ``ok`` says which lines are objects (others are excluded)."""
    rows = lines.filter(F.trim(F.col("value"), F.lit(" \t\r\n")) != "")
    parsed = F.try_parse_json("value")
    # a key that stands twice makes no VARIANT; the map reader takes it, and the last value counts
    pairs = F.map_entries(F.expr("from_json(value, 'map<string, variant>', map('mode', 'PERMISSIVE'))"))

    def last_of_each(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(p, lambda e: e["key"] == k), -1)["value"]))

    rows = _once(rows, "_v", parsed)
    twice = F.when(F.col("_v").isNull() & F.col("value").rlike(r"^\s*\{.*\}\s*$"), F.element_at(F.transform(F.array(pairs), last_of_each), 1))
    rows = _once(rows, "_m", F.coalesce(F.expr("try_cast(_v AS map<string, variant>)"), twice)).withColumn("ok", F.col("_m").isNotNull())
    rows = _once(rows, "_t", F.transform_values("_m", lambda _, v: as_text(v)))  # each value's text is made once

    def get(key: str) -> Column:
        return F.try_element_at(F.col("_m"), F.lit(key))

    def text(key: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("_t"), F.lit(key)), F.lit(""))

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(text(k), F.lit("")) for k in keys], F.lit(""))

    raw = F.map_contains_key("_m", F.lit("data_type")) & F.map_contains_key("_m", F.lit("date_time"))
    moment = F.try_variant_get(get("date_time"), "$.timestamp", "variant")
    nested = date_time_object(F.try_variant_get(get("date_time"), "$.__class_name__", "string"), _is_number(moment), _whole(moment), F.try_variant_get(moment, "$", "double"))
    stamp = get("timestamp")
    given = F.when(_is_number(stamp), micros_text(_whole(stamp))).when(_kind(stamp) == "STRING", F.try_variant_get(stamp, "$", "string"))
    plain = iso_to_utc(F.coalesce(F.nullif(text("datetime"), F.lit("")), given, F.lit("")))
    known, short = source_of(text("data_type")), first("source_short", "source")
    derived = (short == "") & (text("data_type") != "")
    listed = F.array_join(F.filter(F.try_variant_get(get("tag_list"), "$", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING").cast("array<string>"), ", ")
    spare = F.map_filter("_m", lambda k, v: ~k.isin(NOT_EXTRA) & ~F.schema_of_variant(v).rlike("^(OBJECT|VOID)"))
    pairs = F.transform(F.sort_array(F.map_keys(spare)), lambda k: F.concat(k, F.lit(": "), F.try_element_at(F.col("_t"), k)))
    out = {
        "datetime": F.when(raw, nested).otherwise(plain),
        "timezone": F.coalesce(F.nullif(text("zone"), F.lit("")), F.lit("UTC")),
        "type": text("timestamp_desc"),
        "MACB": macb(text("timestamp_desc"), MACB_JSON, ""),
        "source": F.when(raw | derived, known["source"]).otherwise(short),
        "sourcetype": F.when(raw | (derived & (known["sourcetype"] != "")), known["sourcetype"]).otherwise(text("source_long")),
        "user": text("username"), "host": first("hostname", "computer_name"), "desc": text("message"),
        "filename": first("filename", "display_name"), "inode": text("inode"), "format": text("parser"), "URL": text("url"),
        "event_identifier": text("event_identifier"), "event_type": text("event_type"), "source_name": text("source_name"),
        "user_sid": text("user_sid"), "computer_name": text("computer_name"), "record_number": text("record_number"),
        "store_number": as_long(get("store_number")), "store_index": as_long(get("store_index")),
        "vss_store_number": as_long(get("vss_store_number")), "offset": as_long(get("offset")),
        "tag": F.coalesce(F.nullif(text("tag"), F.lit("")), listed, F.lit("")), "extra": F.array_join(pairs, "; "),
    }
    return as_events(rows, out, ("ok", *keep))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Events with ok and file."""
    return lines_to_events(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")), ("file",))
