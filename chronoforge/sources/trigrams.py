"""Which files may hold a text: a bitmap of hashed trigrams for each file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file's bitmap has so many pieces of 4,096 bytes, as bitmap_or_agg takes them; pieces without a bit are left out.
PIECES = 32
PIECE_BITS = 8 * 4096
#: Trigrams asked for at most; fewer leave out fewer files, never one that holds the text.
ASKED = 64
SCHEMA = "file string, piece int, bits binary"
_CHUNK = 1 << 22


def places(text: np.ndarray) -> np.ndarray:
    """The bit of each three bytes that follow each other."""
    b = text.astype(np.uint64)
    code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    return ((code * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, text) to pieces of bitmaps, for each run of rows of one file. Trigrams across two texts are noise that does no harm."""
    file, seen = None, np.zeros(PIECES * PIECE_BITS, bool)

    def pieces() -> pa.RecordBatch:
        packed = np.packbits(seen, bitorder="little").reshape(PIECES, -1)
        some = [k for k in range(PIECES) if packed[k].any()] or [0]  # a file without text has a row too
        return pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(some, pa.int32()), pa.array([packed[k].tobytes() for k in some], pa.binary())], names=["file", "piece", "bits"])

    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(names):
            last = row
            while last < len(names) and names[last] == names[row]:
                last += 1
            if names[row] != file:
                if file is not None:
                    yield pieces()
                file, seen[:] = names[row], False
            for lo in range(ends[row], ends[last], _CHUNK):
                part = data[lo : min(lo + _CHUNK + 2, ends[last])]
                if len(part) > 2:
                    seen[places(part)] = True
            row = last
    if file is not None:
        yield pieces()


def sketch(rows: DataFrame, file: Column, columns: list[str]) -> DataFrame:
    """file, piece, bits of rows of files."""
    texts = rows.select(file.alias("file"), F.concat_ws("\n", *[F.lower(F.col(c)) for c in columns]).alias("text"))
    return texts.mapInArrow(_sketches, SCHEMA).groupBy("file", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def asked(spark: SparkSession, texts: list[str]) -> list[int]:
    """The bits of a file that may hold all these texts, in any case; % and _ stand for others. None: every file may."""
    bits: set[int] = set()
    for text in texts:
        lowered = spark.sql("SELECT lower(:t) AS t", args={"t": f"%{text}%"}).first()["t"]  # as the search lowers its pattern
        for piece in re.split("[%_]", lowered):
            found = np.frombuffer(piece.encode(), np.uint8)
            bits |= set(places(found).tolist()) if len(found) > 2 else set()
    spread = sorted(bits)
    return spread[:: -(-len(spread) // ASKED)] if spread else []


def ruled_out(index: DataFrame, bits: list[int]) -> DataFrame:
    """file: files that lack one of the bits."""
    by_piece: dict[int, list[int]] = {}
    for b in bits:
        by_piece.setdefault(b // PIECE_BITS, []).append(b % PIECE_BITS)

    def has(at: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(F.lit(1 << at % 8)) != 0

    full = reduce(or_, [(F.col("piece") == p) & reduce(and_, [has(at) for at in places_]) for p, places_ in by_piece.items()])
    # only the pieces asked for are unpacked; a file's other rows just name it
    return index.groupBy("file").agg(F.count_if(full).alias("n")).filter(F.col("n") < len(by_piece)).select("file")
