"""Pages of results with examiner notes merged in, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, as_events, column_name
from chronoforge.operators.predicates import Request, asks_for_notes, date_span, predicate, raw_where, saved, within_days

#: A page that ends behind so many rows is found by counting first.
DEEP = 100_000


def notes_as_events(notes: DataFrame) -> DataFrame:
    """Notes(id, datetime, description, tag, color, bookmark) as events of negative id."""
    values = {"datetime": F.col("datetime"), "source": F.lit("EXAMINER"), "sourcetype": F.lit("Examiner Note"), "desc": F.col("description"), "tag": F.col("tag"), "color": F.col("color"), "bookmark": F.col("bookmark")}
    return as_events(notes.withColumn("id", -F.col("id")), values, ("id",))


def matching(events: DataFrame, condition: Column | None, notes: DataFrame | None = None, rule: str = "filtered") -> DataFrame:
    """Events that match, and notes: 'filtered' like events, 'all' (whatever the condition) or 'none'."""
    rows = events.select("id", *EVENT_COLUMNS)
    found = rows if condition is None else rows.filter(condition)
    if notes is None or rule == "none":
        return found
    more = notes_as_events(notes)
    return found.unionByName(more if rule == "all" or condition is None else more.filter(condition))


def found(events: DataFrame, request: Request, notes: DataFrame | None = None, rule: str = "filtered") -> DataFrame:
    """What matches a request; of a store only the days in its dates are read."""
    return matching(within_days(events, *date_span(request)), predicate(request), notes, rule)


def ordered(rows: DataFrame, order_by: str = "datetime") -> DataFrame:
    """Sorted by one event column, ids breaking ties; ValueError for an unknown one."""
    if column_name(order_by) is None:
        raise ValueError(f"unknown column: {order_by}")
    return rows.orderBy(column_name(order_by), "id")


def between(events: DataFrame, first: str, last: str) -> DataFrame:
    """Events from one time to another; a store's other days are not read."""
    return within_days(events, first, last).filter(F.col("datetime").between(first, last))


#: Rows that a sample holds, at most, and characters of a text in it.
SAMPLED, SAMPLED_CHARS = 4096, 4096


def _before(name: str, place: tuple | None, kind: str) -> Column:
    """Whether a row comes before a place (value, id) in the order."""
    if place is None:
        return F.lit(False)
    return F.struct(F.col(name).alias("v"), F.col("id").alias("i")) < F.struct(F.lit(place[0]).cast(kind).alias("v"), F.lit(place[1]).cast("long").alias("i"))


def _from_to(rows: DataFrame, name: str, low: tuple | None, high: tuple | None) -> DataFrame:
    kind = rows.schema[name].dataType.simpleString()
    if low is not None:
        rows = rows.filter(~_before(name, low, kind))
        if low[0] is not None:
            rows = rows.filter(F.col(name) >= F.lit(low[0]))  # reaches the scan, and leaves out nulls, which come first
    if high is not None:
        rows = rows.filter(_before(name, high, kind))
        if high[0] is not None:
            rows = rows.filter(F.col(name).isNull() | (F.col(name) <= F.lit(high[0])))
    return rows


def _near(rows: DataFrame, name: str, k: int, size: int, deep: int) -> tuple[DataFrame, int]:
    """rows without most of those outside the k-th to the k + size-th in the order of (name, id), and how many of the first k are left.

    One scan counts the rows and draws a row from each of SAMPLED groups by a hash of the id. The sample says between which two of its
    rows the page lies, give or take four standard errors; a second scan counts exactly, and a third one reads what lies between.
    The width of the values doesn't matter. Where more than deep rows are still to be skipped, the same is done within that part.
    """
    kind = rows.schema[name].dataType.simpleString()
    value = F.substring(name, 1, SAMPLED_CHARS) if kind == "string" else F.col(name)  # the beginning of a text is a place in the order too
    while k > deep:
        drawn = F.min(F.struct(F.xxhash64(F.lit("drawn"), "id").alias("by"), value.alias("v"), F.col("id").alias("i"))).alias("row")
        got = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)).alias("g")).agg(drawn, F.count(F.lit(1)).alias("n")).select("row.v", "row.i", "n").collect()
        n = sum(r.n for r in got)
        if n <= k:
            return rows.limit(0), 0  # behind the last row
        places = sorted(((r.v, r.i) for r in got), key=lambda p: (p[0] is not None, p[0].encode() if isinstance(p[0], str) else p[0] or 0, p[1]))
        m = len(places)
        wide = 4 * (m * (k / n) * (1 - k / n)) ** 0.5 + 2
        while True:
            lo, hi = int(k / n * m - wide), int((k + size) / n * m + wide) + 1
            low, high = places[lo] if lo >= 0 else None, places[hi] if hi < m else None
            if low is None and high is None:
                return rows, k
            before, within = rows.agg(F.count_if(_before(name, low, kind)), F.count_if(_before(name, high, kind)) if high else F.count(F.lit(1))).first()
            if before <= k and (k + size <= within or high is None):
                break
            wide *= 2
        rows, k = _from_to(rows, name, low, high), k - before
        if within - before > n // 2:  # the sample can't tell the rows apart, or there are few
            break
    return rows, k


def page(rows: DataFrame, number: int = 1, size: int = 1000, order_by: str = "datetime", deep: int = DEEP) -> DataFrame:
    """One page; the first pages need no full sort (the best rows of each task suffice), later ones skip most rows by a sample and counts."""
    if size <= 0:
        return ordered(rows, order_by)
    k = size * (max(number, 1) - 1)
    if k > deep and column_name(order_by):
        rows, k = _near(rows, column_name(order_by), k, size, deep)
    return ordered(rows, order_by).offset(k).limit(size)


def last_page(rows: DataFrame, size: int = 1000, order_by: str = "datetime", deep: int = DEEP) -> DataFrame:
    return page(rows, max(1, -(-rows.count() // size)), size, order_by, deep)


def page_after(rows: DataFrame, last_value: str, last_id: int, size: int = 1000, order_by: str = "datetime") -> DataFrame:
    """The page behind a row that was seen last: as cheap for the millionth page as for the second."""
    c = F.col(column_name(order_by))
    return page(rows.filter((c > last_value) | ((c == last_value) & (F.col("id") > last_id))), 1, size, order_by)


def query(events: DataFrame, request: Request, notes: DataFrame | None = None, rule: str = "filtered") -> DataFrame:
    return page(found(events, request, notes, rule), request.page, request.page_size, request.order_by)


def total(events: DataFrame, request: Request, notes: DataFrame | None = None, rule: str = "filtered") -> DataFrame:
    """total, pages: one row."""
    return _total(found(events, request, notes, rule), request.page_size)


def _total(rows: DataFrame, size: int) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    size = size if size > 0 else 1000
    return n.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def raw_matching(events: DataFrame, where: str, notes: DataFrame | None = None, bookmarked: bool = False) -> DataFrame:
    """Events that match a raw condition; all notes too, unless the condition names a source that isn't theirs."""
    return matching(events, raw_where(where, bookmarked), notes, "all" if asks_for_notes(where) else "none")


def raw_query(events: DataFrame, where: str, notes: DataFrame | None = None, number: int = 1, size: int = 1000, bookmarked: bool = False, order_by: str = "datetime") -> DataFrame:
    """A page of a raw search."""
    return page(raw_matching(events, where, notes, bookmarked), number, size, order_by)


def raw_total(events: DataFrame, where: str, notes: DataFrame | None = None, size: int = 1000, bookmarked: bool = False) -> DataFrame:
    """total, pages of a raw search: one row."""
    return _total(raw_matching(events, where, notes, bookmarked), size)


def saved_query(events: DataFrame, text: str, notes: DataFrame | None = None, number: int = 1, size: int = 1000) -> DataFrame:
    """A page of a saved query."""
    return page(matching(events, saved(text), notes), number, size)
