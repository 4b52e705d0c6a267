"""Counts of any number of saved queries, in one scan: each comparison is made once, texts are looked for together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_, or_

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.functions.schema import INT_COLUMNS, SEARCH_COLUMNS, column_name
from chronoforge.functions.times import expand_date
from chronoforge.operators.predicates import OPERATORS, Request

# A comparison is (column, operator, value), a query a tree of them: ("and" | "or", [parts]), ("is", comparison) or ("raw", number).
Comparison = tuple[str, str, str]
_COMPARE = {"=": pc.equal, "!=": pc.not_equal, ">=": pc.greater_equal, "<=": pc.less_equal}


def _tree(request: Request) -> tuple | None:
    """What predicates.predicate says of a request, as a tree; None: no condition."""
    user: list[tuple] = []
    for name, operator, value in request.filters:
        known = column_name(name)
        if value != "" and known and operator in OPERATORS:
            user.append(("is", (known, operator, expand_date(value, operator == "<=") if known == "datetime" else value)))
    scopes: list[tuple] = []
    if request.date_from and request.date_to:
        scopes += [("is", ("datetime", ">=", expand_date(request.date_from))), ("is", ("datetime", "<=", expand_date(request.date_to, True)))]
    if request.search:
        scopes.append(("or", [("is", (c, "LIKE", request.search)) for c in SEARCH_COLUMNS]))
    if request.bookmarked:
        scopes.append(("is", ("bookmark", "=", "1")))
    logic = "or" if request.logic == "OR" else "and"
    if request.and_scopes:
        user, logic = ([(logic, user)] if user else []), "and"
    return (logic, user + scopes) if user or scopes else None


def _comparisons(tree: tuple | None) -> set[Comparison]:
    if tree is None or tree[0] == "raw":
        return set()
    return {tree[1]} if tree[0] == "is" else set().union(*map(_comparisons, tree[1]))


def _finder(patterns: dict[str, str]) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    """For lowered texts: which rows hold each value (a key; its lowered form, with wildcards, is looked for)."""
    plain: dict[str, list[str]] = {}
    for value, low in patterns.items():
        if not re.search("[%_]", low):
            plain.setdefault(low, []).append(value)
    wild = {v: re.compile(re.escape(low).replace("%", ".*").replace("_", "."), re.S) for v, low in patterns.items() if re.search("[%_]", low)}
    automaton = ahocorasick.Automaton()
    for low in plain:
        automaton.add_word(low, low)
    if plain:
        automaton.make_automaton()

    def find(texts: pa.Array) -> dict[str, np.ndarray]:
        coded = texts.dictionary_encode()  # a text that stands in many rows is searched once
        words, at = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        hits: dict[str, list[int]] = {low: [] for low in plain}
        if plain:
            for k, text in enumerate(words):
                for low in {low for _, low in automaton.iter(text)}:
                    hits[low].append(k)
        out = {}
        held = np.zeros(len(words) + 1, bool)  # the last is for nulls
        for low, values in plain.items():
            held[:] = False
            held[hits[low]] = True
            rows = held[at]
            out |= dict.fromkeys(values, rows)
        for value, pattern in wild.items():
            held[:-1] = [pattern.search(text) is not None for text in words]
            held[-1] = False
            out[value] = held[at]
        return out

    return find


def counts(events: DataFrame, queries: dict[str, Request | Column | None]) -> DataFrame:
    """name, events: how many events match each query (a request, a raw condition, or None: all), in one scan however many they are.

    Equal comparisons are made once. Texts that LIKE looks for are found by one automaton a column; raw conditions stay with Spark.
    A row's nulls fulfil no comparison. Each task hands up a row a query.
    """
    spark, names = events.sparkSession, list(queries)
    raw = [n for n in names if isinstance(queries[n], Column)]
    trees = [None if queries[n] is None else ("raw", raw.index(n)) if n in raw else _tree(queries[n]) for n in names]
    made = sorted(set().union(*map(_comparisons, trees)))
    likes = sorted({(c, v) for c, op, v in made if op.endswith("LIKE")})
    values = sorted({v for _, v in likes})
    lowered = dict(spark.sql("SELECT v, lower(v) AS low FROM (SELECT explode(:vs) AS v)", args={"vs": values}).collect()) if values else {}
    liked = {c: {v: lowered[v] for d, v in likes if d == c} for c in sorted({c for c, _ in likes})}
    compared = sorted({c for c, op, _ in made if not op.endswith("LIKE")})
    columns = [F.col(c).alias(f"c_{c}") for c in compared] + [F.lower(F.col(c).cast("string")).alias(f"l_{c}") for c in liked]
    rows = events.select(*columns, *[F.coalesce(queries[n], F.lit(False)).alias(f"r_{k}") for k, n in enumerate(raw)], F.lit(True).alias("one"))

    def compare(batch: pa.RecordBatch, c: str, op: str, value: str) -> np.ndarray:
        column, v = batch.column(f"c_{c}"), value
        if c in INT_COLUMNS and re.fullmatch(r"\s*[+-]?\d+\s*", value):
            v = int(value)
            if not -(1 << 63) <= v < 1 << 63:  # beyond all numbers of the column
                always = {"=": False, "!=": True, ">=": v < 0, "<=": v > 0}[op]
                return pc.is_valid(column).to_numpy(zero_copy_only=False) & always
        elif c in INT_COLUMNS:
            column = column.cast(pa.string())
        return _COMPARE[op](column, pa.scalar(v, column.type)).fill_null(False).to_numpy(zero_copy_only=False)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders, sums = {c: _finder(patterns) for c, patterns in liked.items()}, np.zeros(len(names), np.int64)
        for batch in batches:
            is_: dict[Comparison, np.ndarray] = {(c, op, v): compare(batch, c, op, v) for c, op, v in made if not op.endswith("LIKE")}
            for c, finder in finders.items():
                texts = batch.column(f"l_{c}")
                there = pc.is_valid(texts).to_numpy(zero_copy_only=False)
                for v, found in finder(texts).items():
                    is_[c, "LIKE", v], is_[c, "NOT LIKE", v] = found, there & ~found

            def holds(tree: tuple) -> np.ndarray:
                if tree[0] == "is":
                    return is_[tree[1]]  # noqa: B023
                if tree[0] == "raw":
                    return batch.column(f"r_{tree[1]}").to_numpy(zero_copy_only=False)  # noqa: B023
                return reduce(and_ if tree[0] == "and" else or_, map(holds, tree[1]))

            sums += [batch.num_rows if t is None else int(np.count_nonzero(holds(t))) for t in trees]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(sums)], names=["k", "n"])

    if not names:
        return spark.createDataFrame([], "name string, events long")
    summed = rows.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("events"))
    return summed.select(F.element_at(F.lit(names), F.col("k") + 1).alias("name"), "events")
