"""Format detection, imports of many files of several formats, and what an import kept and left out."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.sources import delimited, dynamic, files, jsonl, l2t, tln


def detect(path: str, first_line: str) -> str | None:
    """jsonl, tln, l2ttln, l2t or dynamic, by a file's name and first line; None: no known format."""
    line, name = first_line.lstrip("﻿").strip(), path.lower()
    if name.endswith((".jsonl", ".json")):
        try:
            row = json.loads(line)
        except ValueError:
            return None
        keys = set(row) if isinstance(row, dict) else set()
        raw, plain = {"data_type", "date_time"} <= keys, keys & {"timestamp", "datetime"} and keys & {"message", "source_short"}
        return "jsonl" if raw or plain else None
    kind = None
    if fields := tln.HEADERS.get(line) or (tln.field_count(line) if re.fullmatch(r"[+-]?\d+", line.split("|")[0]) else None):
        kind = "tln" if fields == 5 else "l2ttln"
    if name.endswith((".tln", ".l2ttln")):
        return kind
    header = dynamic.header_of(line)
    if header[:17] == l2t.COLUMNS:
        return "l2t"
    return kind or ("dynamic" if any(h.strip().lower() in dynamic.TARGET for h in header) else None)


#: Files up to this size are read whole, many a task, to find their first lines.
SMALL_FILE = 1 << 20


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line that isn't blank of each file (a row a file reaches the driver). Of a large file only the head is read."""
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length").collect()  # lists the files without reading them
    filled = lambda df: df.filter(F.trim("value") != "")
    out: dict[str, str] = {}
    if small := [r.path for r in sizes if r.length <= SMALL_FILE]:
        lines = spark.read.text(small).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
        found = {r["file"]: r["first"] for r in filled(lines).groupBy("file").agg(F.min_by("value", "at").alias("first")).collect()}
        by_name = {plain(k): v for k, v in found.items()}
        out = {p: by_name[plain(p)] for p in small if plain(p) in by_name}
    with ThreadPoolExecutor(8) as pool:  # the driver reads the head of a large file, without a job
        heads = pool.map(lambda r: (r.path, files.first_line(spark, r.path)), [r for r in sizes if r.length > SMALL_FILE])
        out |= {path: line for path, line in heads if line}
    return out


def plain(path: str) -> str:
    """A path without its encoding and the doubled slashes that the two ways to name a file differ in."""
    return re.sub("^(\\w+):/*", "\\1:/", unquote(path))


def plain_path(c: Column) -> Column:
    """The same of a column; a plus sign is itself."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^(\\w+):/*", "$1:/")


def breaks_lines(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a CSV file may hold line breaks within quotes; a file without needs no look at the order of its blocks."""
    return delimited.breaks_lines(spark, paths)


def read_all(spark: SparkSession, paths: list[str], multiline: bool | str = "auto", date_from: str = "", date_to: str = "") -> DataFrame:
    """Events of all files, with ok (false: excluded), file and import_format; ValueError for a file of no known format.

    multiline: whether CSV may hold line breaks within quotes; "auto" looks. date_from, date_to: the window of L2T files (see l2t.mark_window).
    """
    groups: dict[tuple, list[str]] = {}
    for file, line in sorted(first_lines(spark, paths).items()):
        kind = detect(file, line)
        if kind is None:
            raise ValueError(f"{file} is of no known format")
        groups.setdefault((kind, tuple(dynamic.header_of(line)) if kind == "dynamic" else ()), []).append(file)
    out = None
    for (kind, header), group in groups.items():
        breaks = kind in ("l2t", "dynamic") and (breaks_lines(spark, group) if multiline == "auto" else multiline)
        if kind == "jsonl":
            df = jsonl.read(spark, group)
        elif kind == "l2t":
            df = l2t.mark_window(l2t.read(spark, group, breaks), date_from, date_to)
        elif kind == "dynamic":
            df = dynamic.read(spark, group, list(header), breaks).withColumn("ok", F.lit(True))
        else:
            df = tln.read(spark, group, 5 if kind == "tln" else 7)
        df = df.withColumn("import_format", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


def summary(imported: DataFrame) -> DataFrame:
    """Per file and format: events and excluded lines."""
    return imported.groupBy("file", "import_format").agg(F.count_if("ok").alias("events"), F.count_if(~F.col("ok")).alias("excluded"))


def kept(imported: DataFrame) -> DataFrame:
    return imported.filter("ok").drop("ok", "file", "import_format")


def with_ids(events: DataFrame, after: int = 0) -> DataFrame:
    """Unique ids greater than after; not dense, so that no task waits for another."""
    return events.withColumn("id", F.monotonically_increasing_id() + F.lit(after + 1))
