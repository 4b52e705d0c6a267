"""What the corpus operators share: table access, shared scratch tables, text conventions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: the space and the ASCII controls 0x09 to 0x0D.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local session gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Paths of the tables written in each scope that is open, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written within, at the end, but for those that outlive it: they belong to the scope around it.

    A result reads tables that outlive its operator. Whoever writes that result elsewhere can do so in a scope of their own.
    """
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no call of its own to delete files
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark then removes a step's shuffle files as soon as the step ends, not when the driver happens to forget its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoforge/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if outlive else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out() -> Column:
    """Rows whose labels no model may learn from: crc32 of the id as text leaves 2 on division by 4."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
