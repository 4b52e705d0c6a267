"""Files of any Hadoop file system, by the few calls that PySpark has none of its own for. Each is a small driver call."""

from __future__ import annotations

import re
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all it holds, if it is there."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def delete_if_empty(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    if fs.exists(where) and not list(fs.listStatus(where)):
        fs.delete(where, False)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def tables(spark: SparkSession, path: str, depth: int = 0) -> list[str]:
    """The Parquet files of a folder, or of the folders within it, as paths below it."""
    if depth:
        return [f"{n}/{f}" for n in names(spark, path) if not n.startswith("_") for f in tables(spark, f"{path}/{n}", depth - 1)]
    return [n for n in names(spark, path) if n.endswith(".parquet")]


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file; one that is already at its target stays."""
    fs, src = _at(spark, source)
    _, dst = _at(spark, target)
    for _ in range(3):
        fs.mkdirs(dst.getParent())
        try:
            if fs.rename(src, dst):
                return
        except Py4JJavaError:  # some file systems raise where others return false
            pass
        if fs.exists(dst):
            return
    raise OSError(f"{source} can't be moved to {target}")


def create(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; false if it is there already. One of several callers makes it."""
    fs, where = _at(spark, path)
    try:
        fs.create(where, False).close()
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file with that text, there as a whole or not at all."""
    fs, part = _at(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    move(spark, f"{path}.part", path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str, part: int = 1 << 16) -> str | None:
    """First line of a text file that isn't blank, of which so much is read as it takes; None for none. Unpacks what its name says is packed."""
    fs, where = _at(spark, path)
    packed = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    raw = fs.open(where)
    stream = packed.createInputStream(raw) if packed else raw
    head = b""
    try:
        while True:
            more = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, part)))
            head += more
            lines = re.split(b"\r\n|\n|\r", head)
            for line in lines if not more else lines[:-1]:  # the last may go on
                if line.strip(b" "):
                    return line.decode("utf-8", "replace")
            if not more:
                return None
            head, part = lines[-1], 2 * part
    finally:
        stream.close()
