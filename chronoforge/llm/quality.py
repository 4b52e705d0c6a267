"""Quality scores: ridge on random Fourier features of document statistics, isotonic calibration.

* Statistics: some twenty numbers per text (lengths, shares of character kinds, repetition of words
  and lines, entropy). Scores see nothing but them.
* Random Fourier features ``sqrt(2/D) cos(Wx + b)`` of the standardised statistics approximate a
  Gaussian kernel.
* Normal equations: each task adds up ``Z'Z`` and ``Z'y`` over its labelled rows, Spark adds up the
  tasks' sums, the driver solves one system of D + 1 unknowns, whatever the input.
* Isotonic calibration: raw scores of the labelled rows, counted in ``GRID`` steps, give the
  non-decreasing step means (pool adjacent violators); between steps the score is interpolated.

Learns from at most ``LABELLED`` labelled rows outside the held-out quarter (smallest hashes of the id; a
documented, fixed bound, so that their ids can be broadcast and no text is shuffled). Statistics are computed
once and written to the shared folder.

Cases: null or empty text has defined statistics (zeros) and gets a score like any other; labels
that are null are not learned from; a document labelled twice counts twice; an empty table gives no
rows; without any labelled row every score is 0.5; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import WORDS, held_out, temporary, written

STATS = 20
FEATURES = 127
GAMMA = 0.05
RIDGE = 1e-2
GRID = 2048
THRESHOLD = 0.7
#: Rows to learn from, at most.
LABELLED = 100_000

_word, _letters, _odd = re.compile(WORDS), re.compile(r"[^\W\d_]"), re.compile(r"[^\w\s.,;:'\"?()-]")


def statistics(text: str | None) -> list[float]:
    """The numbers that a score depends on."""
    text = text or ""
    words = _word.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATS
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_odd = len(_odd.findall(text))
    squeezed = chars - text.count(" ") - text.count("\n")
    upper = sum(map(str.isupper, words))
    capital = sum(w[0].isupper() for w in counts)
    most = max(counts.values())
    ends = [w[-1] for w in words]
    marked = sum(not (e.isalnum() or e in ".,;:?!\"')") for e in ends)
    stops = sum(e in ".?!" for e in ends)
    commas = sum(e == "," for e in ends)
    bangs = sum(e == "!" for e in ends)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    entropy = -sum(c / n * math.log(c / n) for c in counts.values())
    digits = sum(map(str.isdigit, words))
    return [
        math.log1p(n),
        squeezed / n,
        upper / n,
        capital / len(counts),
        ascii_odd / chars,
        marked / n,
        stops / n,
        commas / n,
        bangs / n,
        same / n,
        most / n,
        len(counts) / n,
        entropy,
        entropy / math.log(n + 1),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        digits / n,
        (text.count("http") + text.count("@")) / n,
        max(map(len, counts)) ** 0.5,
        len(_letters.findall(text)) / chars,
    ]


def all_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return written(rows.mapInArrow(run, "doc_id long, stats array<double>"), "quality-stats", outlive=True)


class Model:
    """Weights of the ridge and the calibration; small, of fixed size."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, math.sqrt(2 * GAMMA), (STATS, FEATURES))
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)
        self.beta: np.ndarray | None = None
        self.at, self.value = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = math.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.beta is None else np.clip(self.features(stats) @ self.beta, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.value)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: positions and non-decreasing means."""
    blocks: list[list[float]] = []
    for xi, t, c in zip(x, total, n, strict=True):
        blocks.append([xi, xi, t, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            lo, hi = blocks[-2], blocks.pop()
            blocks[-1] = [lo[0], hi[1], lo[2] + hi[2], lo[3] + hi[3]]
    at = [p for b in blocks for p in ((b[0], b[1]) if b[1] > b[0] else (b[0],))]
    return np.array(at), np.array([b[2] / b[3] for b in blocks for _ in range(2 if b[1] > b[0] else 1)])


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["stats"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, STATS))


def labelled(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, y: the rows to learn from."""
    named = labels.filter(~held_out()).select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y")).dropna()
    return F.broadcast(named.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(LABELLED))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from the statistics of labelled rows that are not held out."""
    with temporary(stats.sparkSession):
        return _fit(written(stats.join(labelled(labels, label), "doc_id"), "quality-labelled"))


def _fit(rows: DataFrame) -> Model:
    model = Model()
    cols = [F.col("stats")[i] for i in range(STATS)]
    got = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not got[0]:
        return model
    model.mean, model.scale = np.array(got[1 : STATS + 1]), np.maximum(np.array(got[STATS + 1 :]), 1e-6)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((FEATURES + 2, FEATURES + 2))
        for pdf in parts:
            z = np.hstack([model.features(_matrix(pdf)), pdf["y"].to_numpy()[:, None]])
            a += z.T @ z
        i, j = np.triu_indices(len(a))
        yield pd.DataFrame({"i": i, "j": j, "v": a[i, j]})

    a = np.zeros((FEATURES + 2, FEATURES + 2))
    for i, j, v in rows.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        a[i, j] = a[j, i] = v
    ztz = a[:-1, :-1] + RIDGE * got[0] / 1000 * np.eye(FEATURES + 1)
    model.beta = np.linalg.solve(ztz, a[:-1, -1])

    def raw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            r = model.raw(_matrix(pdf))
            yield pd.DataFrame({"step": np.round((r + 0.5) / 2 * GRID).astype(int), "y": pdf["y"]})

    steps = rows.mapInPandas(raw, "step int, y double").groupBy("step")
    got = sorted(steps.agg(F.sum("y"), F.count(F.lit(1))).collect())
    x, total, n = (np.array(v, float) for v in zip(*got, strict=True))
    model.at, model.value = isotonic(x / GRID * 2 - 0.5, total, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(_matrix(pdf))})

    out = stats.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; the fit reads labelled texts alone."""
    with temporary(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text"))  # no other column may clash
        model = fit(all_statistics(texts.join(F.broadcast(labelled(labels).select("doc_id")), "doc_id", "left_semi")), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(-1, STATS)))

    return docs.filter(score(F.col("text")) >= threshold)
