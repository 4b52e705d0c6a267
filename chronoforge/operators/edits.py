"""Edits as new snapshots: lists of ids or of edits joined to events or notes.

Spark picks the join by the size of the edit list: a small one is broadcast, a large one shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, INT_COLUMNS
from chronoforge.functions.text import append_tag


def split_ids(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event ids, note ids) of ids(id): positive ones name events, negative ones notes, 0 nothing."""
    return ids.filter("id > 0").select("id").distinct(), ids.filter("id < 0").select((-F.col("id")).alias("id")).distinct()


def _change(rows: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return rows.join(hit, "id", "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(rows.columns)


def set_color(events: DataFrame, notes: DataFrame, ids: DataFrame, color: str) -> tuple[DataFrame, DataFrame]:
    e, n = split_ids(ids)
    return _change(events, e, "color", F.lit(color)), _change(notes, n, "color", F.lit(color))


def set_bookmark(events: DataFrame, notes: DataFrame, ids: DataFrame, value: bool) -> tuple[DataFrame, DataFrame]:
    e, n = split_ids(ids)
    v = F.lit(int(value)).cast("long")
    return _change(events, e, "bookmark", v), _change(notes, n, "bookmark", v)


def toggle_bookmark(events: DataFrame, ids: DataFrame) -> DataFrame:
    """1 to 0 and all else to 1, on the rows that ids names."""
    return _change(events, ids, "bookmark", F.when(F.col("bookmark") == 1, 0).otherwise(1).cast("long"))


def toggle_bookmarks(events: DataFrame, notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for events and notes: negative ids name notes."""
    e, n = split_ids(ids)
    return toggle_bookmark(events, e), toggle_bookmark(notes, n)


def add_tag(events: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """Events with one more tag on those named; ValueError if one of them is unknown."""
    named = split_ids(ids)[0]
    if not tag:
        return events
    if not named.join(events.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("an id names no event")
    return _change(events, named, "tag", append_tag(F.col("tag"), tag))


def update_fields(events: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(id, field, value, seq): the last value of each id and field holds; unknown ids change nothing.

    A field that is no event column, or a negative id, is an error of the task that meets it.
    """
    bad = (F.col("id") < 0) | ~F.col("field").isin(EVENT_COLUMNS)
    checked = edits.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("no such edit: "), F.col("field"))).cast("long")).otherwise(F.col("id")))
    last = checked.groupBy("id").pivot("field", EVENT_COLUMNS).agg(F.max_by("value", "seq"))
    last = last.select("id", *[F.col(c).alias(f"_{c}") for c in EVENT_COLUMNS])
    new = [F.coalesce(F.col(f"_{c}").try_cast("long") if c in INT_COLUMNS else F.col(f"_{c}"), F.col(c)).alias(c) for c in EVENT_COLUMNS]
    rest = [c for c in events.columns if c not in EVENT_COLUMNS]
    return events.join(last, "id", "left").select(*rest, *new).select(events.columns)


def apply_color_template(events: DataFrame, template: DataFrame, field: str) -> DataFrame:
    """Colors by type or host; rows without a match keep theirs."""
    keys = template.filter(F.col("field") == field).select(F.col("key").alias("_key"), F.col("color").alias("_color"))
    rows = events.join(keys, F.col(field) == F.col("_key"), "left")
    return rows.withColumn("color", F.coalesce("_color", "color")).select(events.columns)


def add_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with new(datetime, description) rows; rows without either are left out. Ids go on from the largest."""
    some = new.filter("datetime != '' AND description != ''")
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = some.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(last))  # last: one row
    made = rows.select((F.col("_last") + F.col("_at") + 1).alias("id"), "datetime", "description", F.lit("").alias("tag"), F.lit("").alias("color"), F.lit(0).cast("long").alias("bookmark"))
    return notes.unionByName(made)


def delete_notes(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids as shown, so negative."""
    return notes.join(split_ids(ids)[1], "id", "left_anti")
