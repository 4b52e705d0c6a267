"""TLN (5 fields) and L2TTLN (7 fields): pipe-separated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import as_events
from chronoforge.functions.text import MACB_OTHER, macb
from chronoforge.functions.times import tln_time

# The optional header lines.
HEADERS = {"Time|Source|Host|User|Description": 5, "Time|Source|Host|User|Description|TZ|Notes": 7}


def lines_to_events(lines: DataFrame, fields: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of a column ``value``; a column ``ok`` says which lines have an integer time (others are excluded)."""
    value = F.trim(F.col("value"), F.lit(" \t\r\n\v\f"))
    p = [F.trim(F.coalesce(F.try_element_at(F.split(value, r"\|", fields), F.lit(k + 1)), F.lit(""))) for k in range(fields)]
    epoch = F.when(p[0].rlike(r"^[+-]?\d+$"), p[0].try_cast("long"))
    parts = F.split(p[4], ";", 3)
    kind = F.trim(F.try_element_at(parts, F.lit(2)))
    out: dict[str, Column] = {
        "datetime": tln_time(epoch), "source": p[1], "format": p[1], "host": p[2], "user": p[3],
        "desc": F.when(F.size(parts) == 3, F.trim(parts[2])).otherwise(p[4]),
        "type": kind, "MACB": F.when(kind.isNotNull(), macb(kind, MACB_OTHER)), "timezone": F.lit("UTC"),
    }
    if fields == 7:
        path = F.when(p[6].startswith("File: "), F.substring(p[6], 7, 1 << 30))
        at = F.locate(" inode: ", path)
        out |= {
            "timezone": F.when(p[5].isin("", "-"), "UTC").otherwise(p[5]),
            "notes": F.when(p[6] == "-", "").otherwise(p[6]),
            "filename": F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path),
            "inode": F.when(at > 0, F.substring(path, at + 8, F.lit(1 << 30))),
        }
    rows = lines.filter((value != "") & ~value.isin(*HEADERS)).withColumn("ok", epoch.isNotNull())
    return as_events(rows, out, ("ok", *keep))


def field_count(first_line: str) -> int | None:
    """5 or 7 by the first line of a file; None: neither."""
    line = first_line.strip()
    return HEADERS.get(line) or (n if (n := line.count("|") + 1) in (5, 7) else None)


def read(spark: SparkSession, paths: list[str], fields: int) -> DataFrame:
    """Events with ok and file, of files of one kind."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return lines_to_events(lines, fields, ("file",))
