"""Pushes to SQL servers: staged part by part, moved in one transaction, once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import FREQUENCY_COLUMNS, no_nulls
from chronoforge.functions.text import strip_nul
from chronoforge.functions.times import store_time
from chronoforge.operators import aggregates
from chronoforge.sources.store import sanitised

#: Names of the pushes that a server holds, and how many rows each moved.
LEDGER = "l2t_pushes"
#: A push is staged in so many parts; one that failed is staged again alone.
PARTS = 32


@contextmanager
def _connected(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator:
    """A connection of the driver, in a transaction that ends well or not at all."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    given = jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        con.setAutoCommit(False)
        yield con
        con.commit()
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()


def _quoted(con, name: str) -> str:
    q = con.getMetaData().getIdentifierQuoteString().strip()
    return f"{q}{name}{q}"


def _run(con, sql: str, *values: str) -> int:
    statement = con.prepareStatement(sql)
    try:
        for k, v in enumerate(values):
            statement.setString(k + 1, v)
        return statement.executeUpdate()
    finally:
        statement.close()


def _there(spark: SparkSession, url: str, table: str, options: dict[str, str]) -> bool:
    with _connected(spark, url, options) as con:
        for name in {table, table.upper(), table.lower()}:
            found = con.getMetaData().getTables(con.getCatalog(), None, name, None)
            if found.next():
                return True
    return False


def has_push(spark: SparkSession, url: str, name: str, **options: str) -> bool:
    """Whether a server holds the push of that name."""
    if not _there(spark, url, LEDGER, options):
        return False
    with _connected(spark, url, options) as con:
        statement = con.prepareStatement(f"SELECT moved FROM {LEDGER} WHERE push = ?")
        statement.setString(1, name)
        held = statement.executeQuery().next()
        statement.close()
    return held


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with push_part, a rule of their values (their id too) alone: the same at every run."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int")
    return rows.withColumn("push_part", part).drop("id")


def _stage(spark: SparkSession, rows: DataFrame, staging: str, url: str, options: dict[str, str]) -> int:
    """Brings a staging table to hold each row once; returns the number of rows. Parts that it holds already stay."""
    want = {r.push_part: r["count"] for r in rows.groupBy("push_part").count().collect()}  # PARTS rows at most
    for _ in range(2):
        have: dict[int, int] = {}
        if _there(spark, url, staging, options):
            counts = spark.read.format("jdbc").options(url=url, dbtable=staging, **options).load().groupBy("push_part").count()
            have = {r.push_part: r["count"] for r in counts.collect()}
        bad = sorted(k for k in want.keys() | have.keys() if want.get(k) != have.get(k))
        if not bad:
            return sum(want.values())
        if stale := [k for k in bad if k in have]:
            with _connected(spark, url, options) as con:
                _run(con, f"DELETE FROM {staging} WHERE {_quoted(con, 'push_part')} IN ({', '.join(map(str, stale))})")
        # a part is one task's, and a task's rows are one transaction
        again = rows.filter(F.col("push_part").isin(bad)).repartition(PARTS, "push_part")
        again.write.mode("append").option("batchsize", 5000).options(**options).jdbc(url, staging)
    raise RuntimeError(f"{staging} does not hold what was sent; push again")


def _move(spark: SparkSession, url: str, name: str, moves: list[tuple[str, str, list[str], int]], options: dict[str, str]) -> None:
    """Moves staged rows and notes the push in one transaction. A row too many or too few undoes it."""
    with _connected(spark, url, options) as con:
        total = 0
        for staging, table, columns, n in moves:
            listed = ", ".join(_quoted(con, c) for c in columns)
            moved = _run(con, f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}")
            if moved != n:
                raise RuntimeError(f"{staging} holds {moved} rows in place of {n}; push again")
            total += n
        _run(con, f"INSERT INTO {LEDGER} (push, moved) VALUES (?, {total})", name)


def _drop(spark: SparkSession, url: str, tables: list[str], options: dict[str, str]) -> None:
    for table in tables:
        if _there(spark, url, table, options):
            with _connected(spark, url, options) as con:
                _run(con, f"DROP TABLE {table}")


def push_jdbc(events: DataFrame, notes: DataFrame, url: str, table: str = "log2timeline", notes_table: str = "examiner_notes", push: str = "", **options: str) -> None:
    """Appends events and notes to a server, all or none, then counts values and tags anew; ValueError if there is no event.

    push: a name (letters, digits, _). A push whose name the server holds adds nothing, so one that failed, or that ended without a
    word, can be run again with its name: parts that were staged stay, and the counts are made. Without a name each call is a push of
    its own. The same events are to be given again; rows that are equal are rows of their own. Tables for counts: one a field, one for tags.
    """
    if push and not re.fullmatch(r"\w{1,40}", push, re.ASCII):
        raise ValueError("a push is named by up to 40 letters, digits and _")
    spark, named = events.sparkSession, bool(push)
    push = push or uuid.uuid4().hex
    if not (named and has_push(spark, url, push, **options)):
        if events.isEmpty():
            raise ValueError("the timeline is empty")
        rows = sanitised(events.drop("event_date"))
        texts = [strip_nul(F.col(c)).alias(c) if c in ("description", "tag", "color") else F.col(c) for c in notes.columns]
        said = notes.select(*texts).withColumn("datetime", store_time(F.col("datetime")))
        for made, target in ((rows, table), (said, notes_table)):  # a table that is not there yet
            made.drop("id").limit(0).write.mode("append").options(**options).jdbc(url, target)
        if not _there(spark, url, LEDGER, options):
            try:
                with _connected(spark, url, options) as con:
                    _run(con, f"CREATE TABLE {LEDGER} (push VARCHAR(40) NOT NULL PRIMARY KEY, moved BIGINT)")
            except Py4JJavaError:
                if not _there(spark, url, LEDGER, options):  # else another push made it
                    raise
        staged = [(f"{target}_{push}", target, made) for made, target in ((rows, table), (said, notes_table))]
        try:
            moves = [(name, target, made.drop("id").columns, _stage(spark, _dealt(made), name, url, options)) for name, target, made in staged]
            moves = [m for m in moves if m[3]]  # nothing was staged of an empty table
            _move(spark, url, push, moves, options)
        except BaseException:
            if not named:  # nobody can go on with it
                _drop(spark, url, [name for name, _, _ in staged], options)
            raise
    _drop(spark, url, [f"{table}_{push}", f"{notes_table}_{push}"], options)
    there = no_nulls(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*FREQUENCY_COLUMNS, "tag"))
    counts = aggregates.frequencies(there).persist()
    for field in FREQUENCY_COLUMNS:  # a small table each
        counts.filter(F.col("field") == field).select(F.col("value").alias(field), "frequency").write.mode("overwrite").options(**options).jdbc(url, f"l2t_{field}s")
    counts.unpersist()
    aggregates.distinct_tags(there).write.mode("overwrite").options(**options).jdbc(url, "l2t_tags")
