"""Timelines as CSV of 17 fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import as_events
from chronoforge.functions.text import strip_nul
from chronoforge.functions.times import l2t_date, l2t_time
from chronoforge.sources import delimited

# The header.
COLUMNS = ["date", "time", "timezone", "MACB", "source", "sourcetype", "type", "user", "host", "short", "desc", "version", "filename", "inode", "notes", "format", "extra"]
_SAME = ["timezone", "MACB", "source", "sourcetype", "type", "user", "host", "desc", "filename", "inode", "notes", "format", "extra"]


def cells_to_events(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of the 17 text columns; missing cells are empty."""
    c = {n: strip_nul(F.coalesce(F.col(n), F.lit(""))) for n in COLUMNS}
    out = {n: c[n] for n in _SAME} | {n: F.lit(-1) for n in ("offset", "store_number", "store_index", "vss_store_number")}
    return as_events(cells, out | {"datetime": F.concat(l2t_date(c["date"]), F.lit(" "), l2t_time(c["time"]))}, keep)


def mark_window(events: DataFrame, date_from: str = "", date_to: str = "") -> DataFrame:
    """Events with ok: whether they lie between two dates, both excluded, if both are given."""
    day = F.substring("datetime", 1, 10)
    return events.withColumn("ok", (day > date_from) & (day < date_to) if date_from and date_to else F.lit(True))


def in_window(events: DataFrame, date_from: str = "", date_to: str = "", limit: int = 0) -> DataFrame:
    """Events between two dates, both excluded, if both are given; at most limit of them, if it is given."""
    if date_from and date_to:
        day = F.substring("datetime", 1, 10)
        events = events.filter((day > date_from) & (day < date_to))
    return events.limit(limit) if limit else events


def read(spark: SparkSession, paths: list[str], multiline: bool = True) -> DataFrame:
    """Events with file. multiline False: no line break stands within quotes."""
    rows = delimited.records(spark, paths, multiline).select("file", delimited.cells(F.col("record")).alias("_cells"))
    return cells_to_events(rows.select("file", *[F.try_element_at("_cells", F.lit(k + 1)).alias(c) for k, c in enumerate(COLUMNS)]), ("file",))
