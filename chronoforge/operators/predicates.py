"""Filters: requests and raw conditions as columns that Catalyst pushes down."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.functions.schema import INT_COLUMNS, SEARCH_COLUMNS, column_name
from chronoforge.functions.times import expand_date

OPERATORS = ("=", "!=", ">=", "<=", "LIKE", "NOT LIKE")


@dataclass
class Request:
    """What a user asks for. filters: (column, operator, value); logic joins all conditions, AND or OR.

    and_scopes: dates, keyword and bookmark narrow the result even where logic is OR.
    """

    filters: list[tuple[str, str, str]] = field(default_factory=list)
    logic: str = "AND"
    search: str = ""
    bookmarked: bool = False
    date_from: str = ""
    date_to: str = ""
    order_by: str = "datetime"
    page: int = 1
    page_size: int = 1000
    and_scopes: bool = False


def like(c: Column, value: str) -> Column:
    """value anywhere in c, in any case; % and _ in it are wildcards, a backslash is itself."""
    return c.cast("string").ilike("%" + value.replace("\\", "\\\\") + "%")


def simple(name: str, operator: str, value: str, strict: bool = False) -> Column | None:
    """One comparison; None for an unknown column or operator (ValueError if strict)."""
    known = column_name(name)
    if known is None or operator not in OPERATORS:
        if strict:
            raise ValueError(f"unknown column or operator: {name} {operator}")
        return None
    c = F.col(known)
    if operator.endswith("LIKE"):
        return ~like(c, value) if operator == "NOT LIKE" else like(c, value)
    if known in INT_COLUMNS and re.fullmatch(r"\s*[+-]?\d+\s*", value):
        n = int(value)
        if not -(1 << 63) <= n < 1 << 63:  # beyond all numbers of the column
            return c.isNotNull() & F.lit({"=": False, "!=": True, ">=": n < 0, "<=": n > 0}[operator])
        v = F.lit(n)
    else:
        c, v = c.cast("string") if known in INT_COLUMNS else c, F.lit(value)
    return {"=": c == v, "!=": c != v, ">=": c >= v, "<=": c <= v}[operator]


def between(first: str, last: str) -> Column:
    return F.col("datetime").between(first, last)


def combine(parts: list[Column | None], logic: str = "AND") -> Column | None:
    some = [p for p in parts if p is not None]
    return reduce(or_ if logic == "OR" else and_, some) if some else None


def keyword(value: str) -> Column | None:
    return combine([like(F.col(c), value) for c in SEARCH_COLUMNS], "OR") if value else None


def predicate(request: Request) -> Column | None:
    """The condition of a request; None: no condition."""
    user = []
    for name, operator, value in request.filters:
        if value != "":
            user.append(simple(name, operator, expand_date(value, operator == "<=") if name.lower() == "datetime" else value))
    scopes = []
    if request.date_from and request.date_to:
        scopes += [F.col("datetime") >= expand_date(request.date_from), F.col("datetime") <= expand_date(request.date_to, True)]
    scopes.append(keyword(request.search))
    if request.bookmarked:
        scopes.append(F.col("bookmark") == 1)
    if request.and_scopes:
        return combine([combine(user, request.logic), *scopes])
    return combine([*user, *scopes], request.logic)


def date_span(request: Request) -> tuple[str, str]:
    """The least and greatest time text that a request's result can hold; '' for no bound."""
    lows, highs = [], []
    if request.logic != "OR":
        for name, operator, value in request.filters:
            if name.lower() == "datetime" and value:
                lows += [expand_date(value)] if operator in (">=", "=") else []
                highs += [expand_date(value, operator == "<=")] if operator in ("<=", "=") else []
    if (request.logic != "OR" or request.and_scopes) and request.date_from and request.date_to:
        lows.append(expand_date(request.date_from))
        highs.append(expand_date(request.date_to, True))
    return max(lows, default=""), min(highs, default="")


def texts_held(request: Request) -> list[str]:
    """Texts that each event of a request's result holds in one of SEARCH_COLUMNS, in any case; % and _ stand for others."""
    alone = len([v for _, _, v in request.filters if v]) + bool(request.search) + bool(request.date_from and request.date_to) + request.bookmarked == 1
    every = request.logic != "OR" or alone
    out = [request.search] if request.search and (every or request.and_scopes) else []
    for name, operator, value in request.filters if every else []:
        if column_name(name) in SEARCH_COLUMNS and operator in ("LIKE", "=") and value:
            out.append(value)
    return out


def _day(text: str) -> date | None:
    try:
        return date.fromisoformat(text[:10]) if re.match(r"\d{4}-\d{2}-\d{2}", text) else None
    except ValueError:  # no such day
        return None


def within_days(events: DataFrame, low: str = "", high: str = "") -> DataFrame:
    """A store's events without the days (partitions) that hold no time text from low to high; rows without a day stay.

    A time's first ten characters are its day, so bounds of texts bound the days. Tables without event_date pass as they are.
    """
    days = [F.col("event_date") >= F.lit(d) for d in [_day(low)] if d] + [F.col("event_date") <= F.lit(d) for d in [_day(high)] if d]
    if not days or "event_date" not in events.columns:
        return events
    return events.filter(F.col("event_date").isNull() | reduce(and_, days))


#: What real_dates lets through lies between.
REAL_DATES = ("1970-01-01", "2100-01-01")


def real_dates() -> Column:
    """Times within 1970 to 2099, compared as texts: unset and broken ones are out."""
    return (F.col("datetime") > REAL_DATES[0]) & (F.col("datetime") < REAL_DATES[1])


_quoted = re.compile(r"('(?:[^']|'')*')")


def raw_where(where: str, bookmarked: bool = False) -> Column:
    """A condition in SQL as the reference's default store understands it: LIKE ignores case, backslashes are plain."""
    out, before = [], ""
    for k, part in enumerate(_quoted.split(where)):
        if k % 2:
            pattern = re.search(r"\bI?LIKE\s*$", before, re.I)
            text = part[1:-1].replace("''", "'").replace("\\", "\\\\" * (2 if pattern else 1)).replace("'", "\\'")
            out.append(f"'{text}'")
        else:
            part = re.sub(r"\bLIKE\b", "ILIKE", part, flags=re.I)
            out.append(re.sub(r'"([^"]*)"', r"`\1`", part))
        before = part
    condition = F.expr("".join(out))
    return condition & (F.col("bookmark") == 1) if bookmarked else condition


def asks_for_notes(where: str) -> bool:
    """Whether a raw condition lets notes in: no source is named, or theirs is."""
    named = re.findall(r"\bsource\b\s*=\s*'([^']*)'", where, re.I)
    return not named or any(n.upper() == "EXAMINER" for n in named)


def saved_request(text: str) -> Request | Column:
    """A saved query: JSON of a filter panel, as a request, or of a raw condition."""
    state = json.loads(text)
    if state.get("advanced"):
        return raw_where(state.get("whereClause", ""))
    filters = [(f["field"], f["operator"], f["value"]) for f in state.get("filters", [])]
    return Request(filters, state.get("logic", "AND"), date_from=state.get("dateFrom", ""), date_to=state.get("dateTo", ""))


def saved(text: str) -> Column | None:
    """The condition of a saved query."""
    state = saved_request(text)
    return predicate(state) if isinstance(state, Request) else state
