"""CSV records as text, and their cells as arrays: any width, quotes read leniently, files with line breaks in quotes split among tasks.

A cell is quoted if its first character is a quote (after blanks, if these are trimmed). A quote within it is doubled; one that no comma and
no line end follows is itself. All other quotes are plain characters. A quote that is never closed takes the rest of the file.

Whether a line starts within quotes is known only from all lines before it. So each block of a file (what one task reads) is looked at from both
possible starts: which lines start records, and how the block ends. The blocks' ends, a row a block, settle each block's start in file order; the
lines of records that go over several lines then meet by the place where their record starts. All other records never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTENT = '(?:[^"]++|""|"(?=[^",]))*+'


def _cell(trim: bool) -> str:
    return ("[ \\t]*+" if trim else "") + f'(?:"{_CONTENT}"(?=,|\\z)|[^",][^,]*+|)'


def _closed(value: Column, trim: bool) -> tuple[Column, Column]:
    """Whether a line ends outside quotes, if it starts outside them and if it starts within."""
    more = f"(?:,{_cell(trim)})*+\\z"
    quoted = F.contains(value, F.lit('"'))
    return ~quoted | value.rlike(f"\\A{_cell(trim)}{more}"), quoted & value.rlike(f'\\A{_CONTENT}"(?=,|\\z){more}')


def cells(record: Column, trim: bool = False) -> Column:
    """The cells of a record, an array of texts without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_cell(trim)})"), F.lit(1))
    bare = (lambda x: F.ltrim(x, F.lit(" \t"))) if trim else (lambda x: x)
    return F.transform(F.transform(found, bare), lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, value: lines in the order of each block."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r\\z", "").alias("value"))


def breaks_lines(spark: SparkSession, paths: list[str], trim: bool = True) -> bool:
    """Whether a file holds line breaks within quotes. One pass over the lines, which any task can do."""
    return not _lines(spark, paths).filter(~_closed(F.col("value"), trim)[0]).isEmpty()


def records(spark: SparkSession, paths: list[str], breaks: bool = True, trim: bool = False) -> DataFrame:
    """file, record of files with a header, which is left out, as are blank lines. breaks False: no line break stands within quotes."""
    lines = _lines(spark, paths)
    if breaks:
        return _joined(lines, trim)
    lines = lines.withColumn("at", F.monotonically_increasing_id()).filter("value != ''")
    heads = lines.groupBy("file").agg(F.min(F.struct("block", "at")).getField("at").alias("at"))
    return lines.join(heads.select("at"), "at", "left_anti").select("file", F.col("value").alias("record"))


_LINE = "file string, block long, at long, value string, in0 boolean, in1 boolean, start0 long, start1 long, end0 boolean, end1 boolean"


def _from_both_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with, for a block that starts outside quotes (0) or within (1): whether the line starts and ends within, and where its record starts (-1: in an earlier block)."""
    where, at, now, start = None, 0, [False, True], [-1, -1]
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for file, block, *closed in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
            if (file, block) != where:
                where, at, now, start = (file, block), 0, [False, True], [-1, -1]
            begun = now
            start = [s if inside else at for s, inside in zip(start, begun, strict=True)]
            now = [not closed[inside] for inside in begun]
            for column, v in zip(out, (at, *begun, *start, *now), strict=True):
                column.append(v)
            at += 1
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        at_, in0, in1, start0, start1, end0, end1 = (pa.array(c, k) for c, k in zip(out, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at_, b.column(2), in0, in1, start0, start1, end0, end1], [c.split()[0] for c in _LINE.split(", ")])


def _settled(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """Each block of a file: whether it starts within quotes, and where the record that it goes on with starts; and the file's header."""
    inside, begun, head, out = False, (-1, -1), (-1, -1), []
    for r in blocks.sort_values("block").itertuples():
        out.append((key[0], r.block, inside, *begun))
        first, last = (r.first1, r.last1) if inside else (r.first0, r.last0)
        if head[0] < 0 <= first:
            head = (r.block, first)
        if last >= 0:
            begun = (r.block, last)
        inside = bool(r.end1 if inside else r.end0)
    rows = pd.DataFrame(out, columns=["file", "block", "inside", "from_block", "from_at"])
    return rows.assign(head_block=head[0], head_at=head[1])


def _joined(lines: DataFrame, trim: bool) -> DataFrame:
    out0, out1 = _closed(F.col("value"), trim)
    both = lines.select("file", "block", "value", out0.alias("out0"), out1.alias("out1")).mapInArrow(_from_both_starts, _LINE)
    first = lambda k: F.coalesce(F.min(F.when(~F.col(f"in{k}") & (F.col("value") != ""), F.col("at"))), F.lit(-1)).alias(f"first{k}")
    ends = both.groupBy("file", "block").agg(first(0), first(1), *[F.max(f"start{k}").alias(f"last{k}") for k in (0, 1)], *[F.max_by(f"end{k}", "at").alias(f"end{k}") for k in (0, 1)])
    blocks = ends.groupBy("file").applyInPandas(_settled, "file string, block long, inside boolean, from_block long, from_at long, head_block long, head_at long")
    named = both.join(blocks, ["file", "block"])
    settled = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    here = settled("start") >= 0
    rows = named.select(
        "file", "block", "at", "value", settled("in").alias("goes_on"), settled("end").alias("is_open"), "head_block", "head_at",
        F.when(here, F.col("block")).otherwise(F.col("from_block")).alias("of_block"), F.when(here, settled("start")).otherwise(F.col("from_at")).alias("of_at"),
    )
    rows = rows.filter("NOT (of_block = head_block AND of_at = head_at) AND (goes_on OR value != '')")
    single = rows.filter("NOT goes_on AND NOT is_open").select("file", F.col("value").alias("record"))
    parts = rows.filter("goes_on OR is_open").groupBy("file", "of_block", "of_at").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).getField("value").alias("parts"), F.max_by("is_open", F.struct("block", "at")).alias("is_open")
    )
    closing = F.when(F.col("is_open"), '"').otherwise("")  # the quote that the file left open
    return single.unionByName(parts.select("file", F.concat(F.array_join("parts", "\n"), closing).alias("record")))
