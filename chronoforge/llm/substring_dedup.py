"""Substring deduplication: words covered by a window of 35 words that starts twice anywhere are removed.

The method named for this operator is a set of suffix automata of reference shards, broadcast in turn.
Here the corpus is its own reference, so every shard would have to meet every document: the work
grows with the square of the corpus (figures in the README). This operator therefore finds the same maximal
spans by fingerprints, in work proportional to the input:

1. Anchors: of the 26 ten-word grams of a window, the one with the least hash. Equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so about one word in 13 starts one.
   Anchors that stand at one place only rule out their windows.
2. Documents get the anchors of theirs that stand at several places; windows of those are kept, as runs
   of windows with the same anchor.
3. Runs that occur twice, with all their windows, are repeated. For the others, the windows are counted
   within their anchor, once per distinct run.
4. Words of repeated windows are removed.

A window is compared by 128 bits, 64 of its anchor and 64 of its own, whose word hashes are independent of text
length and place.

Cases: null and empty text have no words; texts of less than 35 words lose nothing; the very same row twice
is two places; rows are told apart by id and text together, so null or repeated ids are no trouble; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written
from chronoforge.llm.minhash_dedup import mix, word_hashes

WINDOW, GRAM = 35, 10
#: Windows that share a gram, and so the longest run.
REACH = WINDOW - GRAM + 1
_BASE = 0xD1342543DE82EF95


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            grow = lambda base: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
            self.up, self.down = grow(np.uint64(_BASE)), grow(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


def rolling(h: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of every window of the width."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers.get(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1] + np.uint64(width))


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """np.minimum or np.maximum over every window of the width, by doubling."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Reader:
    """Anchors and windows of texts."""

    def __init__(self):
        self.hashes, self.powers = word_hashes(), Powers()

    def words(self, text: str | None) -> np.ndarray:
        w = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))

    def anchors(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and the number of places each stands at."""
        h = self.words(text)
        if len(h) < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams = rolling(h, GRAM, self.powers)
        least = sliding(grams, REACH, np.minimum)
        edge = np.zeros(REACH - 1, np.uint64)
        at = grams == sliding(np.concatenate([edge, least, edge]), REACH, np.maximum)
        return np.unique(grams[at], return_counts=True)

    def runs(self, text: str | None, wanted: np.ndarray) -> list[tuple]:
        """(anchor, hash of the run, first window, windows' hashes) for the windows whose anchor is wanted."""
        h = self.words(text)
        if len(h) < WINDOW:
            return []
        least = sliding(rolling(h, GRAM, self.powers), REACH, np.minimum)
        at = np.flatnonzero(np.isin(least, wanted))
        if not len(at):
            return []
        values, own = rolling(h, WINDOW, self.powers)[at], least[at]
        new = np.concatenate([[True], (np.diff(at) != 1) | (own[1:] != own[:-1])])
        first = np.flatnonzero(new)
        place = np.arange(len(at)) - first[np.cumsum(new) - 1]
        starts = np.flatnonzero(place % REACH == 0)
        ends = np.append(starts[1:], len(at))
        own, values = own.view(np.int64), values.view(np.int64)
        return [
            (int(own[a]), xxhash.xxh3_64_intdigest(values[a:b].tobytes()) - (1 << 63), int(at[a]), values[a:b])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ]


@cache
def reader_here() -> Reader:
    """One per worker process, which Spark uses for many tasks."""
    return Reader()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two numbers that name the row."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("id0"), F.xxhash64("doc_id", "text").alias("id1")
    )


def held_anchors(docs: DataFrame) -> DataFrame:
    """id0, id1, anchor, n: how often each row holds each anchor; written, for both uses made of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_here()
        for b in batches:
            got = [reader.anchors(t) for t in b.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(got)), [len(x) for x, _ in got]))
            v = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in got)]).view(np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *(c for _, c in got)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(v), pa.array(n.astype(np.int32))], ["id0", "id1", "anchor", "n"])

    return written(_keyed(docs).select("id0", "id1", "text").mapInArrow(run, "id0 long, id1 long, anchor long, n int"), "substring-held")


def repeated_anchors(held: DataFrame) -> DataFrame:
    """anchor, for those that stand at several places; written, so that joins with it can split a common anchor."""
    return written(held.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "substring-anchors")


def candidate_runs(docs: DataFrame) -> DataFrame:
    """id0, id1, anchor, run, start, windows: the windows whose anchor stands at several places."""
    keyed = _keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_here()
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                cols: list[list] = [[] for _ in range(6)]
                for id0, id1, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for anchor, name, start, windows in reader.runs(text, np.array(wanted, np.int64).view(np.uint64)):
                        for c, v in zip(cols, (id0, id1, anchor, name, start, windows), strict=True):
                            c.append(v)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, cols[5])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *cols[5]]))
                )
                flat = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(flat, ["id0", "id1", "anchor", "run", "start", "windows"])

    held = held_anchors(docs)
    wanted = held.join(repeated_anchors(held), "anchor", "left_semi").groupBy("id0", "id1").agg(F.collect_set("anchor").alias("wanted"))
    rows = keyed.join(wanted, ["id0", "id1"]).select("id0", "id1", "text", "wanted")
    return written(rows.mapInArrow(run, "id0 long, id1 long, anchor long, run long, start int, windows array<long>"), "substring-runs")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """id0, id1, marks: per row the (start, mask) of runs with repeated windows; bit k is window start + k.

    A common anchor has runs without bound. The tables it is joined with are written first: both sides of the
    join are then plain shuffles, which the adaptive engine splits. Windows are keyed by one struct of
    anchor and window, so that Spark doesn't count them where the join by anchor alone has put them.
    """
    runs = candidate_runs(docs)
    kinds = written(runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows")), "substring-kinds")
    open_anchors = written(kinds.filter("n = 1").select("anchor").distinct(), "substring-open")
    each = kinds.join(open_anchors, "anchor", "left_semi").select("anchor", "run", "n", F.posexplode("windows").alias("k", "window"))
    each = each.select("anchor", "run", "n", "k", F.struct("anchor", "window").alias("key"))
    counted = each.groupBy("key").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    twice = written(counted.filter("all > 1 AND least = 1").select("key"), "substring-twice")
    bits = each.filter("n = 1").join(twice, "key", "left_semi").groupBy("anchor", "run").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    full = kinds.filter("n > 1").select("anchor", "run", F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))
    marked = runs.select("id0", "id1", "anchor", "run", "start").join(full.unionByName(bits), ["anchor", "run"])
    return marked.groupBy("id0", "id1").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))


def removed(n: int, marks: list[dict] | None) -> np.ndarray:
    """Which of n words repeated windows cover."""
    change = np.zeros(n + 1, np.int64)
    for m in marks or []:
        starts = m["start"] + np.flatnonzero((np.uint64(m["mask"]) >> np.arange(REACH, dtype=np.uint64)) & np.uint64(1))
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                n, gone, kept = [], [], []
                for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    cut = removed(len(words), marks)
                    n.append(len(words))
                    gone.append(int(cut.sum()))
                    kept.append(b" ".join(words if not gone[-1] else [words[i] for i in np.flatnonzero(~cut)]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    with temporary(docs.sparkSession):
        marks = written(repeated_windows(docs), "substring-marks", outlive=True)
    rows = _keyed(docs).join(marks, ["id0", "id1"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
