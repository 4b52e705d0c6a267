"""CSV whose header says what its columns are.

Quotes are read leniently and rows may be ragged, so that no row is malformed: every row is an event.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import as_events, column_name
from chronoforge.functions.text import MACB_OTHER, macb
from chronoforge.functions.times import drop_offset
from chronoforge.sources import delimited

# Event column (lower case) of each header name (lower case).
TARGET = {
    "datetime": "datetime", "date": "datetime",
    "timestamp_desc": "type", "type": "type",
    "source": "source", "source_short": "source",
    "sourcetype": "sourcetype", "source_long": "sourcetype",
    "message": "desc", "desc": "desc", "short": "desc", "description": "desc",
    "parser": "format", "format": "format",
    "display_name": "filename", "filename": "filename",
    "host": "host", "hostname": "host",
    "user": "user", "username": "user",
    "macb": "macb",
    "tag": "tag",
    "inode": "inode",
    "timezone": "timezone", "zone": "timezone", "tz": "timezone",
    "notes": "notes",
    "extra": "extra",
    "url": "url",
    "record_number": "record_number",
    "event_identifier": "event_identifier",
    "event_type": "event_type",
    "source_name": "source_name",
    "user_sid": "user_sid",
    "computer_name": "computer_name",
}
BLANKS = " \t\r\n"


def cell_names(header: list[str], surplus: int) -> list[str]:
    """Columns of the header's cells and of as many cells beyond it."""
    return [f"_c{k}" for k in range(len(header))] + [f"_o{k}" for k in range(surplus)]


def cells_to_events(cells: DataFrame, header: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of the columns _c0, _c1 ... named by the header, and of overflow columns _o0 ... or an array _beyond if there are any."""
    first: dict[str, int] = {}
    for k, name in enumerate(header):
        if target := TARGET.get(name.strip().lower()):
            first.setdefault(target, k)
    if not first:
        raise ValueError("no column of the header is known")
    cell = {n: F.trim(F.coalesce(F.col(n), F.lit("")), F.lit(BLANKS)) for n in cell_names(header, 0) if n in cells.columns}
    out: dict[str, Column] = {column_name(t): cell[f"_c{k}"] for t, k in first.items()}
    if "datetime" in first:
        out["datetime"] = drop_offset(out["datetime"])
    if "type" in first:
        flags = F.when(F.col(f"_c{first['type']}").isNotNull() | (out["type"] != ""), macb(out["type"], MACB_OTHER))
        if "macb" not in first:
            out["MACB"] = flags
        elif first["macb"] < first["type"]:  # an empty cell is filled by the type that follows
            out["MACB"] = F.when(out["MACB"] != "", out["MACB"]).otherwise(flags)
    zone = out.get("timezone", F.lit(""))
    out["timezone"] = F.when(zone == "", "UTC").otherwise(zone)
    spare = [(header[k].strip(), f"_c{k}") for k in range(len(header)) if k not in first.values()]
    pairs = [F.when(~cell[n].isin("", "-"), F.concat(F.lit(f"{name}: "), cell[n])) for name, n in spare]
    surplus = [F.array(n) for n in sorted((n for n in cells.columns if re.fullmatch(r"_o\d+", n)), key=lambda n: int(n[2:]))] + [F.col("_beyond")] * ("_beyond" in cells.columns)
    if surplus:
        beyond = F.transform(F.concat(*surplus), lambda x: F.trim(x, F.lit(BLANKS)))
        pairs.append(F.transform(F.filter(beyond, lambda x: ~x.isin("", "-")), lambda x: F.concat(F.lit("unknown: "), x)))
    if pairs:
        made, given = F.concat_ws("; ", *pairs), out.get("extra", F.lit(""))
        out["extra"] = F.when(given != "", given).otherwise(made)
    return as_events(cells, out, keep)


def header_of(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")], skipinitialspace=True), [])


def read(spark: SparkSession, paths: list[str], header: list[str], multiline: bool = True) -> DataFrame:
    """Events with file, of files that have this header. multiline False: no line break stands within quotes."""
    rows = delimited.records(spark, paths, multiline, trim=True).select("file", delimited.cells(F.col("record"), trim=True).alias("_cells"))
    n = len(header)
    own = [F.try_element_at("_cells", F.lit(k + 1)).alias(c) for k, c in enumerate(cell_names(header, 0))]
    beyond = F.slice("_cells", F.lit(n + 1), F.greatest(F.lit(0), F.size("_cells") - n)).alias("_beyond")
    return cells_to_events(rows.select("file", *own, beyond), header, ("file",))
