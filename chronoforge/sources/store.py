"""Timelines in stores: date-partitioned Parquet, CSV exports, SQL servers; small CSV tables beside them."""

from __future__ import annotations

import json
import uuid
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, EVENT_SCHEMA, EXPORT_COLUMNS, FREQUENCY_COLUMNS, INT_COLUMNS, SEARCH_COLUMNS, no_nulls
from chronoforge.functions.text import strip_nul
from chronoforge.functions.times import store_time
from chronoforge.operators import aggregates, edits
from chronoforge.operators.predicates import Request, texts_held
from chronoforge.sources import files, imports, trigrams

STORE_SCHEMA = EVENT_SCHEMA + ", ts timestamp_ntz, import_batch string, event_date date"
LEDGER_SCHEMA = "batch string, path string, length long, modified timestamp, file string, import_format string, events long, excluded long"
COUNTS_SCHEMA = "field string, value string, frequency long"
#: Ids are given out in blocks of so many.
BLOCK = 1 << 32
#: What is counted: the metadata columns, and lists of tags.
COUNTED = [*FREQUENCY_COLUMNS, "tag"]
#: More files of counts than these are summed into few.
COUNT_FILES = 1000

# A store is a folder of Parquet files by day. Beside it lies its journal, ``<store>.journal``:
#   pending/<change>/  what a change adds, written there first, and COMMIT, which lists the files to move in and those to remove
#   ids/               a file for each block of ids that is given out
#   counts/            counts of values, a difference for each change
#   ledger/            what was imported
#   index/             trigrams of the texts of files, for searches
# A change takes effect with COMMIT. Whoever next opens the store finishes it: files are moved to names of their own and removed by
# name, so that it does no harm to do so twice, or two at a time. A change that ended before its COMMIT has no effect.


def _journal(path: str) -> str:
    return f"{path.rstrip('/')}.journal"


def _dated(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", store_time(F.col("datetime"))).withColumn("event_date", F.to_date("ts"))


def _write(rows: DataFrame, folder: str, files_a_day: int) -> None:
    rows = rows.select("id", *EVENT_COLUMNS, "ts", "import_batch", "event_date").repartition("event_date", F.pmod("id", F.lit(files_a_day)))
    rows.write.partitionBy("event_date").option("maxRecordsPerFile", 5_000_000).parquet(folder)


def _change(path: str) -> str:
    """The folder of a new change."""
    return f"{_journal(path)}/pending/{uuid.uuid4().hex}"


def _commit(spark: SparkSession, path: str, change: str, remove: list[str] = (), beside: list[str] = ()) -> None:
    """From now on the change holds. remove: files of the store; beside: files of its journal."""
    add = [[f"data/{f}", f"{path}/{f}"] for f in files.tables(spark, f"{change}/data", 1)]
    add += [[f"{kind}/{f}", f"{_journal(path)}/{kind}/{f}"] for kind in ("counts", "ledger", "index") for f in files.tables(spark, f"{change}/{kind}")]
    gone = [f for f in remove if not files.exists(spark, f"{path}/{f}")]
    if gone:
        raise RuntimeError(f"another change came first: {gone[0]} is no longer there")
    files.write_text(spark, f"{change}/COMMIT", json.dumps({"add": add, "remove": [f"{path}/{f}" for f in remove] + [f"{_journal(path)}/{f}" for f in beside]}))


def finish(spark: SparkSession, path: str) -> None:
    """Carries out the changes that were committed but not carried out to the end."""
    pending = f"{_journal(path)}/pending"
    for name in files.names(spark, pending):
        if files.exists(spark, f"{pending}/{name}/COMMIT"):
            todo = json.loads(files.read_text(spark, f"{pending}/{name}/COMMIT"))
            for source, target in todo["add"]:
                files.move(spark, f"{pending}/{name}/{source}", target)
            for old in todo["remove"]:
                files.delete(spark, old)
            for day in {old.rsplit("/", 1)[0] for old in todo["remove"]}:
                files.delete_if_empty(spark, day)
            files.delete(spark, f"{pending}/{name}/COMMIT")
            files.delete(spark, f"{pending}/{name}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what changes that never came to their COMMIT left behind. No change may be under way."""
    finish(spark, path)
    files.delete(spark, f"{_journal(path)}/pending")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    finish(spark, path)
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def _beside(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    folder = f"{_journal(path)}/{kind}"
    return spark.read.schema(schema).parquet(folder) if files.tables(spark, folder) else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was imported: a row a file (batch, path, length, modified, file, import_format, events, excluded) or a named batch."""
    finish(spark, path)
    return _beside(spark, path, "ledger", LEDGER_SCHEMA)


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether that batch is in the store."""
    return not ledger(spark, path).filter(F.col("batch") == batch).isEmpty()


def last_id(spark: SparkSession, path: str) -> int:
    """Largest id of a store; 0 for none."""
    return _whole(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if files.exists(spark, path) else 0


def _blocks(spark: SparkSession, path: str, n: int) -> list[int]:
    """n blocks of ids that nobody else gets."""
    folder = f"{_journal(path)}/ids"
    taken = [int(k) for k in files.names(spark, folder)]
    k = max(taken) + 1 if taken else -(-last_id(spark, path) // BLOCK)
    out: list[int] = []
    while len(out) < n:
        if files.create(spark, f"{folder}/{k:010d}"):
            out.append(k)
        k += 1
    return out


def _numbered(spark: SparkSession, path: str, staged: str, schema: str) -> DataFrame:
    """The staged rows with ids: their places in the staged files, counted on from file to file, in blocks of their own."""
    rows = spark.read.schema(schema).parquet(staged)
    sizes = sorted(tuple(r) for r in rows.groupBy(F.col("_metadata.file_name")).count().collect())  # a row for each task that wrote
    starts = list(accumulate((n for _, n in sizes), initial=1))
    blocks = F.array(*[F.lit(b) for b in _blocks(spark, path, starts[-1] // BLOCK + 1)])
    begin = F.broadcast(spark.createDataFrame([(f, s) for (f, _), s in zip(sizes, starts, strict=False)], "_file string, _start long"))
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(begin, "_file")
    at = F.col("_start") + F.col("_row")
    return placed.withColumn("id", F.element_at(blocks, (F.floor(at / BLOCK) + 1).cast("int")) * BLOCK + at % BLOCK).drop("_file", "_start", "_row")


def _counts(plus: DataFrame, minus: DataFrame | None = None) -> DataFrame:
    out = aggregates.frequencies(plus, COUNTED)
    if minus is None:
        return out
    both = out.unionByName(aggregates.frequencies(minus, COUNTED).withColumn("frequency", -F.col("frequency")))
    return both.groupBy("field", "value").agg(F.sum("frequency").alias("frequency")).filter("frequency != 0")


def _add(spark: SparkSession, path: str, change: str, schema: str, entries: DataFrame | None, files_a_day: int, batch: str) -> None:
    """Adds the rows staged in a change to the store, with their counts and ledger entries."""
    rows = _numbered(spark, path, f"{change}/rows", schema)
    rows = rows.filter("ok") if "ok" in rows.columns else rows
    _write(_dated(rows.withColumn("import_batch", F.lit(batch))), f"{change}/data", files_a_day)
    added = spark.read.schema(STORE_SCHEMA).parquet(f"{change}/data")
    _counts(added).write.parquet(f"{change}/counts")
    if entries is not None:
        entries.write.parquet(f"{change}/ledger")
    files.make_folder(spark, path)  # a store without rows is one too
    _commit(spark, path, change)
    finish(spark, path)
    if len(files.tables(spark, f"{_journal(path)}/counts")) > COUNT_FILES:
        compact_metadata(spark, path)


_STAGED = EVENT_SCHEMA.removeprefix("id long, ")


def append(events: DataFrame, path: str, files_a_day: int = 8, batch: str = "") -> None:
    """Adds events to a Parquet store by day, all or none; a busy day is dealt to several tasks. Appends may run side by side.

    batch: a name; a batch whose name is in the store is not added again. The rows are computed once and written twice.
    """
    spark, change = events.sparkSession, _change(path)
    if batch and has_batch(spark, path, batch):
        return
    no_nulls(events.select(*EVENT_COLUMNS)).write.parquet(f"{change}/rows")
    one = spark.range(1).select(F.lit(batch).alias("batch"), *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in LEDGER_SCHEMA.split(", ")[1:])])
    _add(spark, path, change, _STAGED, one if batch else None, files_a_day, batch)


def import_files(spark: SparkSession, paths: list[str], path: str, date_from: str = "", date_to: str = "") -> DataFrame:
    """Imports files of any known formats into a store; returns (file, import_format, events, excluded) of each file that was read.

    A file that is in the store already, with the same path, length and time of change, is left out, so an import that failed, or
    that ended without a word, can be run again. Two imports at once get ids of their own; the same files should not be in both.
    """
    there = ledger(spark, path).select("path", "length", "modified")
    found = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"))
    new = found.join(there, ["path", "length", "modified"], "left_anti").collect()  # a row a file
    if not new:
        return _beside(spark, path, "ledger", LEDGER_SCHEMA).select("file", "import_format", "events", "excluded").limit(0)
    change = _change(path)
    batch = change.rsplit("/", 1)[1]
    read = imports.read_all(spark, [r.path for r in new], date_from=date_from, date_to=date_to)
    no_nulls(read.select(*EVENT_COLUMNS, "ok", "file", "import_format")).write.parquet(f"{change}/rows")
    schema = f"{_STAGED}, ok boolean, file string, import_format string"
    counted = imports.summary(spark.read.schema(schema).parquet(f"{change}/rows")).withColumn("key", imports.plain_path(F.col("file")))
    listed = spark.createDataFrame([(*r, imports.plain(r.path)) for r in new], "path string, length long, modified timestamp, key string")
    names = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]
    entries = listed.join(counted, "key", "left").withColumn("batch", F.lit(batch)).select(*names)  # files without a line too
    _add(spark, path, change, schema, entries, 8, batch)
    return ledger(spark, path).filter((F.col("batch") == batch) & F.col("file").isNotNull()).select("file", "import_format", "events", "excluded")


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A store's events, with event_date. Stores hold no nulls, so conditions on bare columns reach the files."""
    return _whole(spark, path).select("id", *EVENT_COLUMNS, "event_date")


def index_texts(spark: SparkSession, path: str) -> int:
    """Indexes the texts of files that are not indexed yet, for open_for; returns their number. Reads no other file of the store.

    Files never change, so what is indexed stays right; files that an edit or import adds later are searched whole until the next call.
    Entries of files that are gone go when the index has more than COUNT_FILES files.
    """
    finish(spark, path)
    parts = [f"index/{f}" for f in files.tables(spark, f"{_journal(path)}/index")]
    index = spark.read.schema(trigrams.SCHEMA).parquet(*[f"{_journal(path)}/{f}" for f in parts]) if parts else None
    there = set(files.tables(spark, path, 1))
    new = sorted(there - ({r.file for r in index.select("file").distinct().collect()} if parts else set()))
    merge = len(parts) > COUNT_FILES
    if not new and not merge:
        return 0
    out = None
    if new:
        rows = spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*[f"{path}/{f}" for f in new])
        out = trigrams.sketch(rows, _file_below(), SEARCH_COLUMNS)
    if merge:
        left = index.join(F.broadcast(spark.createDataFrame([(f,) for f in sorted(there)], "file string")), "file", "left_semi")
        out = left if out is None else out.unionByName(left)
    change = _change(path)
    # a file's rows stay together, so that nobody sees some of them; sorted, so that a search reads the pages of its pieces
    out.repartition(max(1, len(there if merge else new) // 1000), "file").sortWithinPartitions("piece").write.parquet(f"{change}/index")
    _commit(spark, path, change, beside=parts if merge else [])
    finish(spark, path)
    return len(new)


def _file_below() -> Column:
    """A row's file as a path below its store: its last two names, decoded as touched files are."""
    named = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    return F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))


def files_for(spark: SparkSession, path: str, request: Request) -> list[str]:
    """The files of a store that may hold what a request asks for, by their texts; those that are not indexed are among them."""
    finish(spark, path)
    there = files.tables(spark, path, 1)
    bits = trigrams.asked(spark, texts_held(request))
    if not bits or not files.tables(spark, f"{_journal(path)}/index"):
        return there
    out = {r.file for r in trigrams.ruled_out(_beside(spark, path, "index", trigrams.SCHEMA), bits).collect()}  # a row a file
    return [f for f in there if f not in out]


def open_for(spark: SparkSession, path: str, request: Request) -> DataFrame:
    """As open_parquet, without the files that can't hold what a request asks for; its condition is still to be applied (pages.found)."""
    some = files_for(spark, path, request)
    rows = spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*[f"{path}/{f}" for f in some]) if some else spark.createDataFrame([], STORE_SCHEMA)
    return rows.select("id", *EVENT_COLUMNS, "event_date")


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(field, value, frequency), (tag): sums of what each change counted."""
    finish(spark, path)
    counts = _beside(spark, path, "counts", COUNTS_SCHEMA).groupBy("field", "value").agg(F.sum("frequency").alias("frequency")).filter("frequency > 0")
    tags = aggregates.distinct_tags(counts.filter("field = 'tag'").select(F.col("value").alias("tag")))
    return counts.filter("field != 'tag'"), tags


def compact_metadata(spark: SparkSession, path: str) -> None:
    """Sums the counts of all changes so far into few files."""
    finish(spark, path)
    _replace_counts(spark, path, _beside(spark, path, "counts", COUNTS_SCHEMA).groupBy("field", "value").agg(F.sum("frequency").alias("frequency")).filter("frequency != 0"))


def refresh_metadata(spark: SparkSession, path: str) -> None:
    """Counts the whole store anew. Changes keep the counts by themselves; this is for stores written by other means."""
    _replace_counts(spark, path, _counts(_whole(spark, path)))


def _replace_counts(spark: SparkSession, path: str, counts: DataFrame) -> None:
    old, change = files.tables(spark, f"{_journal(path)}/counts"), _change(path)
    counts.write.parquet(f"{change}/counts")
    _commit(spark, path, change, beside=[f"counts/{f}" for f in old])
    finish(spark, path)


def prepare_edits(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """apply_edits up to its commit: whoever opens the store next carries it out."""
    old = _whole(spark, path)
    named = changes.select("id").distinct()
    at = old.select("id", F.col("_metadata.file_path").alias("file")).join(named, "id", "left_semi").select("file").distinct()
    touched = ["/".join(unquote(r.file).rsplit("/", 2)[1:]) for r in at.collect()]  # files of the store
    if not touched:
        return
    change = _change(path)
    before = spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*[f"{path}/{f}" for f in touched])
    _write(_dated(edits.update_fields(before, changes)), f"{change}/data", 8)
    _counts(spark.read.schema(STORE_SCHEMA).parquet(f"{change}/data"), before).write.parquet(f"{change}/counts")
    _commit(spark, path, change, touched)


def apply_edits(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Applies changes(id, field, value, seq) to a store (see edits.update_fields); only the files that hold the events named are rewritten.

    All or nothing, and a run that fails can be run again. Of two edits of one file at a time, the later one fails and can be run again.
    """
    prepare_edits(spark, path, changes)
    finish(spark, path)


def open_jdbc(spark: SparkSession, url: str, table: str = "log2timeline", id_column: str = "id", partitions: int = 16, **options: str) -> DataFrame:
    """A store's events, read by ranges of ids in parallel."""
    bounds = spark.read.format("jdbc").options(url=url, query=f'SELECT min("{id_column}") AS lo, max("{id_column}") AS hi FROM {table}', **options).load().first()
    lo, hi = int(bounds[0] or 0), int(bounds[1] or 0)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=id_column, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(partitions), **options)
    return no_nulls(reader.load())


def export_rows(events: DataFrame, order_by: str = "datetime") -> DataFrame:
    """The columns of an export, in order."""
    return events.orderBy(order_by, "id").select(*EXPORT_COLUMNS)


def export_csv(events: DataFrame, path: str, order_by: str = "datetime", one_file: bool = False) -> None:
    """Sorted CSV with a header: files follow each other in name order. one_file: through a single task."""
    rows = export_rows(events, order_by)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def sanitised(events: DataFrame) -> DataFrame:
    """What a SQL server takes: no NUL in texts, a timestamp or null for datetime."""
    clean = events.select(*[c if c in INT_COLUMNS or c not in EVENT_COLUMNS else strip_nul(F.col(c)).alias(c) for c in events.columns])
    return clean.withColumn("datetime", store_time(F.col("datetime")))


def read_color_template(spark: SparkSession, path: str) -> DataFrame:
    """key, color of a two-column CSV headed (type or host, colorcode); the last row of a key counts. Column ``field`` says which."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if len(raw.columns) < 2 or raw.columns[0] not in ("type", "host") or raw.columns[1] != "colorcode":
        raise ValueError("the header must be type or host, then colorcode")
    color = F.when(F.coalesce("colorcode", F.lit("")) == "", "WHITE").otherwise(F.col("colorcode"))
    rows = raw.select(F.lit(raw.columns[0]).alias("field"), F.coalesce(raw.columns[0], F.lit("")).alias("key"), color.alias("color"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("field", "key").agg(F.max_by("color", "at").alias("color"))


# The header of a file of saved queries.
SAVED_COLUMNS = ["Name", "SQL", "Description", "EID", "OS", "IP"]


def read_saved_queries(spark: SparkSession, path: str) -> DataFrame:
    """Saved queries; short rows are filled with ''."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)  # SQL may go over several lines
    if raw.columns != SAVED_COLUMNS:
        raise ValueError(f"the header must be {', '.join(SAVED_COLUMNS)}")
    return raw.na.fill("")
