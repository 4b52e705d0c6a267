"""Hard negatives by exact inner products: length buckets and coordinate pruning in the manner of LEMP.

Anchors are the rows whose id ``EVERY`` divides. Rows of an anchor's label give its first ``POSITIVES`` by score; for each of
these, the first ``NEGATIVES`` rows of other labels whose score lies between ``LEAST`` hundredths of the positive's and all of it.

* Rows are dealt, by a hash of their number, into blocks; anchors are dealt into blocks too. A task takes a block of
  rows and a block of anchors. Every row meets every anchor in this way: a stated query set against all rows, in blocks.
* Within a task the rows are sorted by length and cut into buckets of ``BUCKET``. A bucket holds, for each coordinate, the
  sorted list of its rows' values divided by their lengths.
* An anchor needs scores of at least ``t``. A bucket whose longest row can't reach ``t`` ends the search. In all others
  the angle between a row and the anchor must be at most ``arccos(t / (|anchor| |longest|))``, which bounds the values
  at each of the anchor's ``FOCUS`` largest coordinates; the ranges of the sorted lists are intersected and what is left
  is verified by exact integer products.
* Positives come first: a task's threshold is the last of its best ``POSITIVES`` so far. Their scores, merged over tasks, bound the negatives.

Cases: rows with a null label, a null vector, a null or a non-finite component take no part, nor do rows with a component of
2^20 or more, whose scores a long might not hold; shorter vectors count as if zeros followed; a null id names no anchor and comes last in ties;
repeated rows are rows of their own, an anchor's copy may be its positive; an anchor without positives, and a positive without negatives,
give no rows; ids that ``SHIFT`` divides take the next label; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written

EVERY, SHIFT, LABELS = 100, 7, 10
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
SCALE = 256
LARGEST = float(1 << 20)
BUCKET, FOCUS = 1024, 4
#: Rows of a block: ROWS_A_BLOCK times the root of all rows, within these bounds. Anchors of a block.
ROWS_A_BLOCK, LEAST_BLOCK, MOST_BLOCK, ANCHORS_A_BLOCK = 24, 2048, 131_072, 4096
#: Components of a block, at most (but for blocks of 64 vectors).
MOST_COMPONENTS = 1 << 23
#: Stands for a null id in ties.
LAST = (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """n, id (LAST for null), label, x (whole numbers), is_anchor of the rows that take part, written to the shared folder."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False)) & ~F.isnan(v))
    label = F.when(F.col("vec_id") % SHIFT == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))
    name = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST))  # not null: pandas would make doubles of such ids
    out = rows.filter(fine).select(name.alias("id"), label.cast("long").alias("label"), whole.alias("x"), F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)).alias("is_anchor"))
    return written(out.withColumn("n", F.monotonically_increasing_id()), "negatives-rows")


class Rows:
    """A block of vectors in length buckets with sorted coordinate lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, n: np.ndarray, labels: np.ndarray):
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((n, ids, -length))
        self.x, self.ids, self.n, self.labels = exact(x[order]), ids[order], n[order], labels[order]
        self.buckets = []
        for lo in range(0, len(order), BUCKET):
            hi = min(lo + BUCKET, len(order))
            size = length[order[lo:hi]]
            unit = self.x[lo:hi].astype(float) / np.where(size > 0, size, 1.0)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").T
            self.buckets.append((lo, hi, size[0], size[-1], lists, np.take_along_axis(unit.T, lists, axis=1)))

    def candidates(self, q: np.ndarray, size: float, bucket: tuple, t: float) -> np.ndarray | None:
        """Positions of the bucket's rows that may score t or more; None: no row does, in this bucket or a later one."""
        lo, hi, longest, shortest, lists, values = bucket
        if longest * size < t:
            return None
        if size == 0 or shortest == 0 or t <= 0:
            return np.arange(lo, hi)  # no bound on angles
        reach = math.acos(min(1.0, t / (size * longest)))
        left = None
        for f in np.argpartition(-np.abs(q), min(FOCUS, len(q)) - 1)[:FOCUS]:
            at = math.acos(max(-1.0, min(1.0, q[f] / size)))
            first = np.searchsorted(values[f], math.cos(min(math.pi, at + reach)) - 1e-9, "left")
            last = np.searchsorted(values[f], math.cos(max(0.0, at - reach)) + 1e-9, "right")
            if last - first < hi - lo:
                inside = np.zeros(hi - lo, bool)
                inside[lists[f, first:last]] = True
                left = inside if left is None else left & inside
        return np.arange(lo, hi) if left is None else lo + np.flatnonzero(left)


def exact(x: np.ndarray) -> np.ndarray:
    """Doubles where they hold every product of such vectors exactly, else longs."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.float64 if most * most * max(1, x.shape[1]) < 1 << 52 else np.int64)


def best(scores: np.ndarray, rows: np.ndarray, of: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, then id, then number."""
    if len(scores) > 8 * k:  # the k-th score rules most of them out
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, rows = scores[near], rows[near]
    order = np.lexsort((of.n[rows], of.ids[rows], -scores))[:k]
    return scores[order], rows[order]


def positives_of(q: np.ndarray, n: int, label: int, of: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Scores and positions of the block's first POSITIVES rows of the label, without row n."""
    size, t = math.sqrt(float((q.astype(float) ** 2).sum())), -math.inf
    scores, rows = np.zeros(0, of.x.dtype), np.zeros(0, int)
    for bucket in of.buckets:
        found = of.candidates(q, size, bucket, t)
        if found is None:
            break
        found = found[(of.labels[found] == label) & (of.n[found] != n)]
        scores, rows = best(np.concatenate([scores, of.x[found] @ q]), np.concatenate([rows, found]), of, POSITIVES)
        if len(scores) == POSITIVES:
            t = float(scores[-1])
    return scores, rows


def negatives_of(q: np.ndarray, label: int, wanted: list[int], of: Rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place in wanted, the positives' scores: scores and positions of the block's first NEGATIVES rows of other labels in its range."""
    possible = [(k, s) for k, s in enumerate(wanted) if s >= 0]  # no score is at least 80 and at most 100 hundredths of a negative one
    if not possible:
        return
    size, t = math.sqrt(float((q.astype(float) ** 2).sum())), -(-LEAST * min(s for _, s in possible) // 100)
    scores, rows = [np.zeros(0, of.x.dtype)], [np.zeros(0, int)]
    for bucket in of.buckets:
        found = of.candidates(q, size, bucket, float(t))
        if found is None:
            break
        found = found[of.labels[found] != label]
        got = of.x[found] @ q
        rows.append(found[got >= t])
        scores.append(got[got >= t])
    scores, rows = np.concatenate(scores).astype(np.int64), np.concatenate(rows)
    for k, s in possible:
        inside = (scores <= s) & (scores * 100 >= s * LEAST)
        if inside.any():
            yield k, *best(scores[inside], rows[inside], of, NEGATIVES)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _met(left: pd.DataFrame, right: pd.DataFrame) -> tuple[Rows, np.ndarray]:
    """A block of rows, and the vectors of a block of anchors."""
    width = max(max(map(len, left["x"]), default=0), max(map(len, right["x"]), default=0))
    x, q = _matrix(left["x"], width), _matrix(right["x"], width)
    rows = Rows(x, left["id"].to_numpy(), left["n"].to_numpy(), left["label"].to_numpy())
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, width)
    if most >= 1 << 52:
        rows.x = rows.x.astype(np.int64)
    return rows, q.astype(rows.x.dtype)


def _dealt(rows: DataFrame, anchors: DataFrame, size: int, several: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, a row of the first for each block of anchors and an anchor for each block of rows."""
    fit = max(64, MOST_COMPONENTS // max(1, width))
    block = min(fit, max(LEAST_BLOCK, min(MOST_BLOCK, int(ROWS_A_BLOCK * math.sqrt(size)))))
    i, j = max(1, -(-size // block)), max(1, -(-several // min(fit, ANCHORS_A_BLOCK)))
    deal = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("i", deal(i)).withColumn("j", each(j)), anchors.withColumn("i", each(i)).withColumn("j", deal(j))


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    with temporary(spark):
        rows = usable(embeddings)
        anchors = rows.filter("is_anchor")
        size, several, width = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        left, right = _dealt(rows, anchors, size, several, width)

        def near(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            of, q = _met(left, right)
            out = []
            for v, n, label in zip(q, right["n"], right["label"], strict=True):
                scores, found = positives_of(v, n, label, of)
                out += [(n, int(s), of.ids[r], of.n[r]) for s, r in zip(scores, found, strict=True)]
            return pd.DataFrame(out, columns=["anchor", "score", "id", "n"]).astype("int64")

        met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
        first = _first(met.applyInPandas(near, "anchor long, score long, id long, n long"), ["anchor"], POSITIVES)
        pairs = written(first.select("anchor", F.posexplode("best").alias("place", "p")).select("anchor", "place", F.col("p.id").alias("positive_id"), (-F.col("p.loss")).alias("positive_score")), "negatives-positives")
        wanted = pairs.groupBy(F.col("anchor").alias("n")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).getField("positive_score").alias("wanted"))
        asking = written(anchors.join(wanted, "n"), "negatives-anchors")
        left, right = _dealt(rows, asking, size, several, width)

        def far(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            of, q = _met(left, right)
            out = []
            for v, n, label, wanted in zip(q, right["n"], right["label"], right["wanted"], strict=True):
                for place, scores, found in negatives_of(v, label, [int(s) for s in wanted], of):
                    out += [(n, place, int(s), of.ids[r], of.n[r]) for s, r in zip(scores, found, strict=True)]
            return pd.DataFrame(out, columns=["anchor", "place", "score", "id", "n"]).astype("int64")

        met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
        last = _first(met.applyInPandas(far, "anchor long, place int, score long, id long, n long"), ["anchor", "place"], NEGATIVES)
        chosen = last.select("anchor", "place", F.posexplode("best").alias("at", "b"))
        names = anchors.select(F.col("n").alias("anchor"), F.col("id").alias("anchor_id"))
        out = chosen.join(pairs, ["anchor", "place"]).join(names, "anchor").select(
            "anchor_id", _id("positive_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), _id("b.id").alias("negative_id"), "positive_score", (-F.col("b.loss")).alias("negative_score")
        )
        return written(out, "negatives", outlive=True)


def _id(name: str) -> Column:
    return F.when(F.col(name) != LAST, F.col(name))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, best: the first k of each; a task gives k a block at most, so a list is as long as there are blocks."""
    item = F.struct((-F.col("score")).alias("loss"), "id", "n")
    return found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(item)), 1, k).alias("best"))


#: Every anchor meets every row.
ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % {SHIFT} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    [CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.n, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score
  FROM v AS a, v AS b WHERE a.vec_id % {EVERY} = 0 AND a.n != b.n
), p AS (
  SELECT anchor, n AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) <= {POSITIVES}
), r AS (
  SELECT s.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id, n) AS rank
  FROM p JOIN s USING (anchor) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}
"""
