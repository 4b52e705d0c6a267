"""The event row: one fixed set of columns for every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of an event in their canonical order.
EVENT_COLUMNS = [
    "datetime", "timezone", "MACB", "source", "sourcetype", "type", "user", "host", "desc", "filename", "inode", "notes", "format",
    "extra", "reportnotes", "inreport", "tag", "color", "offset", "store_number", "store_index", "vss_store_number", "URL",
    "record_number", "event_identifier", "event_type", "source_name", "user_sid", "computer_name", "bookmark",
]
INT_COLUMNS = ["offset", "store_number", "store_index", "vss_store_number", "bookmark"]
# What an export holds, in order.
EXPORT_COLUMNS = [
    "datetime", "timezone", "MACB", "source", "sourcetype", "type", "user", "host", "desc", "filename", "inode", "notes", "format",
    "extra", "reportnotes", "inreport", "tag", "color", "offset", "store_number", "store_index", "vss_store_number", "bookmark",
]
# Where a keyword is looked for.
SEARCH_COLUMNS = ["desc", "filename", "source", "sourcetype", "type", "user", "host", "extra", "tag", "URL", "source_name", "computer_name", "format", "notes"]
# Whose values are counted as metadata.
FREQUENCY_COLUMNS = ["sourcetype", "source", "user", "host", "MACB", "color", "type", "record_number"]
EVENT_SCHEMA = "id long, " + ", ".join(f"`{c}` {'long' if c in INT_COLUMNS else 'string'}" for c in EVENT_COLUMNS)
_BY_LOWER = {c.lower(): c for c in EVENT_COLUMNS}


def column_name(name: str) -> str | None:
    """The canonical name, whatever its case; None: no event column."""
    return _BY_LOWER.get(name.lower())


def blank(name: str) -> Column:
    return F.lit(0).cast("long") if name in INT_COLUMNS else F.lit("")


def as_events(df: DataFrame, values: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Event columns from expressions; those without one are blank. Nulls become blanks too."""
    out = [F.coalesce(values[c].cast("long" if c in INT_COLUMNS else "string"), blank(c)).alias(c) if c in values else blank(c).alias(c) for c in EVENT_COLUMNS]
    return df.select(*keep, *out)


def no_nulls(events: DataFrame) -> DataFrame:
    """Null text as '', null numbers as 0: how a store's rows are read."""
    return events.select(*[F.coalesce(F.col(c), blank(c)).alias(c) if c in EVENT_COLUMNS else F.col(c) for c in events.columns])
