"""Counts over events: values, tags, dates, histograms, saved queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoforge.functions.schema import FREQUENCY_COLUMNS, column_name
from chronoforge.functions.times import FORMAT
from chronoforge.operators.predicates import REAL_DATES, Request, date_span, predicate, real_dates, within_days

#: Conditions counted in one pass; more would outgrow a compiled method.
CONDITIONS_A_PASS = 50


def count(events: DataFrame, condition: Column | None = None) -> DataFrame:
    return (events if condition is None else events.filter(condition)).agg(F.count("id").alias("total"))


def distinct_values(events: DataFrame, name: str, notes: DataFrame | None = None) -> DataFrame:
    """value, frequency of a column without '', sorted by value; notes count in source, sourcetype and tag."""
    c = column_name(name)
    if c is None:
        raise ValueError(f"unknown column: {name}")
    values = events.select(F.col(c).cast("string").alias("value"))
    of_notes = {"source": F.lit("EXAMINER"), "sourcetype": F.lit("Examiner Note"), "tag": F.col("tag")}
    if notes is not None and c in of_notes:
        values = values.unionByName(notes.select(of_notes[c].alias("value")))
    return values.filter("value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("frequency")).orderBy("value")


def frequencies(events: DataFrame, columns: list[str] = FREQUENCY_COLUMNS) -> DataFrame:
    """field, value, frequency of all metadata columns, in one scan; blanks don't count."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = events.select(F.expr(f"stack({len(columns)}, {pairs}) AS (field, value)")).filter("value != ''")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("frequency"))


def distinct_tags(events: DataFrame) -> DataFrame:
    """tag: single tags of all comma-separated lists. Lists are made distinct before they are split."""
    lists = events.select("tag").filter("tag != ''").distinct()
    return lists.select(F.explode(F.split("tag", ",")).alias("tag")).select(F.trim("tag").alias("tag")).filter("tag != ''").distinct()


def min_max_date(events: DataFrame) -> DataFrame:
    rows = events.filter(real_dates()).agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"))
    return rows.select(F.coalesce("lo", F.lit("")).alias("min_date"), F.coalesce("hi", F.lit("")).alias("max_date"))


def summary(events: DataFrame) -> DataFrame:
    """events, min_date, max_date: one row, one scan."""
    real = F.when(real_dates(), F.col("datetime"))
    return events.agg(F.count("id").alias("events"), F.coalesce(F.min(real), F.lit("")).alias("min_date"), F.coalesce(F.max(real), F.lit("")).alias("max_date"))


def histogram(events: DataFrame, request: Request | None = None) -> DataFrame:
    """bucket, cnt: hours within a day, days within a month or a year, else months.

    One scan counts hours, of a store's days in range alone; the range and the buckets come from those few rows (hours of 130 years at most).
    """
    condition = predicate(request) if request else None
    low, high = date_span(request) if request else ("", "")
    events = within_days(events, max(low, REAL_DATES[0]), min(high or REAL_DATES[1], REAL_DATES[1]))
    rows = events.filter(real_dates() if condition is None else real_dates() & condition)
    ts = F.try_to_timestamp("datetime", F.lit(FORMAT))
    hours = rows.select(F.date_format(ts, "yyyy-MM-dd HH").alias("hour")).filter("hour IS NOT NULL").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    hours = hours.select("hour", "n", F.min("hour").over(Window.partitionBy()).alias("lo"), F.max("hour").over(Window.partitionBy()).alias("hi"))

    def same(n: int) -> Column:
        return F.substring("lo", 1, n) == F.substring("hi", 1, n)

    bucket = F.when(same(10), F.concat("hour", F.lit(":00:00"))).when(same(4), F.substring("hour", 1, 10)).otherwise(F.substring("hour", 1, 7))
    return hours.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("cnt")).orderBy("bucket")


def saved_query_counts(events: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """name, events: how many events match each saved query; one scan for up to CONDITIONS_A_PASS of them."""
    names, out = list(conditions), None
    for lo in range(0, len(names), CONDITIONS_A_PASS):
        some = names[lo : lo + CONDITIONS_A_PASS]
        row = events.agg(*[F.count_if(F.lit(True) if conditions[n] is None else conditions[n]).alias(f"n{k}") for k, n in enumerate(some)])
        part = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n{k}").alias("events")) for k, n in enumerate(some)])))
        out = part if out is None else out.unionByName(part)
    return out
