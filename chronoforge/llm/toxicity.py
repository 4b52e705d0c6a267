"""Toxicity scores: a regularised word classifier that must not react to identity terms.

* A text's features are the hashed lower-case words it holds, and their beginnings (present or not). Features that are
  too rare, or as frequent among toxic as among other labelled texts, weigh nothing.
* Logistic regression with an L2 penalty and the counterfactual penalty: in every sentence of a
  labelled text that names an identity term, the term is swapped for another term of its group,
  and the squared change of the sentence's logit is added to the loss. Texts where a neutral
  mention is all that differs thus score alike.
* The classifier learns from at most ``SAMPLE`` labelled ids of each class (smallest hashes of
  the id; a documented, fixed bound); where ids stand in so many rows that more texts come of them, from about
  ``SAMPLE`` of these texts (smallest hashes). The class prior is that of all labelled rows. Every whole
  text is scored.

Cases: null or empty text scores by the prior alone; null labels are not learned from; a document
labelled twice counts twice; an empty table gives no rows; without labels of both classes every
score is the prior (0 without labels); other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import held_out, temporary, written

BUCKETS = 1 << 18
SAMPLE = 4000
#: Words count by themselves and by their beginnings of these lengths (inflected languages).
BEGINNINGS = (4, 5, 6)
#: Least number of labelled texts that hold a feature, and its least likelihood ratio statistic.
LEAST_TEXTS, LEAST_G = 4, 15.0
L2, COUNTERFACTUAL = 0.5, 20.0
THRESHOLD = 0.3

# Identity terms by group; terms of a group are swapped for each other.
IDENTITY = [
    ["women", "men", "girls", "boys", "woman", "man", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "juden", "musulmans", "judíos"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "schwarze", "noirs", "negros"],
    ["gay", "straight", "lesbian", "heterosexual", "transgender", "bisexual"],
    ["immigrants", "refugees", "foreigners", "natives", "locals", "migrants", "ausländer", "étrangers", "extranjeros"],
    ["old", "young", "elderly", "teenagers", "disabled", "blind", "deaf"],
]
GROUP = {t: g for g in IDENTITY for t in g}

_words = re.compile(r"[^\W\d_]+")
_sentences = re.compile(r"[.!?\n]+")


class Buckets(dict):
    """Feature numbers of each word seen: the word and its beginnings; starts anew when large.

    wanted: only these features, all others weigh nothing.
    """

    def __init__(self, wanted: set[int] | None = None):
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        # an identity term counts as a whole alone, so that the penalty reaches all it weighs
        parts = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n and word not in GROUP)]
        got = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)
        self[word] = got = got if self.wanted is None else tuple(f for f in got if f in self.wanted)
        return got


def features(text: str | None, buckets: Buckets) -> set[int]:
    return set().union(*filter(None, map(buckets.__getitem__, set(_words.findall((text or "").lower())))))


def swaps(text: str | None) -> Counter:
    """(term, other term) -> number of sentences in which one replaces the other."""
    out: Counter = Counter()
    lower = (text or "").lower()
    if not GROUP.keys() & set(_words.findall(lower)):
        return out
    for sentence in _sentences.split(lower):
        words = set(_words.findall(sentence))
        for term in GROUP.keys() & words:
            for other in GROUP[term]:
                if other not in words:
                    out[term, other] += 1
    return out


class Model:
    def __init__(self, bias: float):
        self.bias, self.weights = bias, {}

    def logits(self, texts, buckets: Buckets) -> np.ndarray:
        """buckets: of the weights' features alone."""
        w = self.weights
        return np.array([self.bias + sum(w[f] for f in sorted(features(t, buckets))) for t in texts], float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """The texts to learn from (a bounded number), and the number of labelled rows of each class."""
    named = labels.filter(~held_out()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    named = named.filter("y IN (0, 1)")
    counts = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    some = [named.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    few = F.broadcast(some[0].unionByName(some[1]))  # 2 * SAMPLE rows at most
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).join(few, "doc_id"), counts


def likelihood_ratio(a: Column, both: Column, pos: int, neg: int) -> Column:
    """G statistic of a feature that a texts of class 1 and both texts of either class hold."""
    n = pos + neg
    cells = ((a, both, pos), (both - a, both, neg), (pos - a, n - both, pos), (neg - both + a, n - both, neg))
    return sum((F.when(seen > 0, 2 * seen * F.log(seen * n / (held * of))).otherwise(0.0) for seen, held, of in cells), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", counterfactual: float = COUNTERFACTUAL) -> Model:
    """Spark counts features and swaps; the driver gets the chosen features alone, of 2 * SAMPLE texts at most."""
    few, counts = sample(docs, labels, label)
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = np.log(max(n1, 1e-6) / max(n0, 1e-6)) if n1 + n0 else -40.0
    model = Model(float(np.clip(prior, -40, 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            texts = b.column(0).to_pylist()
            rows = [sorted(features(t, buckets)) for t in texts]
            pairs = [[f"{a} {c} {n}" for (a, c), n in swaps(t).items()] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(rows, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.string()))], ["y", "h", "features", "swaps"]
            )

    with temporary(docs.sparkSession):
        hashed = few.select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
        learned = written(hashed.mapInArrow(run, "y int, h long, features array<int>, swaps array<string>"), "toxicity-features")
        texts = {r["y"]: r["count"] for r in learned.groupBy("y").count().collect()}
        if max(texts.values(), default=0) > SAMPLE:  # ids of many rows; equal texts of one id stay or go together
            least = F.when(F.col("y") == 1, SAMPLE / texts.get(1, 1)).otherwise(SAMPLE / texts.get(0, 1))
            learned = written(learned.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 32)) < least * (1 << 32)), "toxicity-features")
            texts = {r["y"]: r["count"] for r in learned.groupBy("y").count().collect()}
        if len(texts) < 2:
            return model
        held = learned.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("both"))
        held = held.filter((F.col("both") >= LEAST_TEXTS) & (likelihood_ratio(F.col("a"), F.col("both"), texts[1], texts[0]) >= LEAST_G))
        used = np.array(sorted(r["f"] for r in held.select("f").collect()), int)  # BUCKETS at most
        swapped = learned.select(F.explode("swaps").alias("s")).select(F.split("s", " ").alias("s")).groupBy(F.col("s")[0].alias("t"), F.col("s")[1].alias("o")).agg(F.sum(F.col("s")[2].cast("long")).alias("n")).collect()  # pairs of IDENTITY

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [[int(f) for f in np.intersect1d(np.array(r, int), used)] for r in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["y", "features"])

        got = learned.select("y", "features").mapInArrow(chosen, "y int, features array<int>").toPandas()
    y = got["y"].to_numpy(float)
    flat = np.concatenate([np.zeros(0, np.int32), *got["features"]]).astype(np.int32)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(f) for f in got["features"]])
    pairs: Counter = Counter()
    for t, o, n in swapped:
        pairs[Buckets()[t][0], Buckets()[o][0]] += n
    at = np.full(BUCKETS, -1)
    at[used] = np.arange(len(used))
    ia = np.array([at[i] for i, _ in pairs], int)
    ib = np.array([at[j] for _, j in pairs], int)
    weight = np.array(list(pairs.values()), float)
    weight = counterfactual * weight / max(weight.sum(), 1.0) * len(y) / 100
    w, bias = _descend(row, at[flat], y, len(used), ia, ib, weight)
    # the sample holds the classes in other shares than the labels do
    model.bias = bias + prior - np.log(texts[1] / texts[0])
    model.weights = {int(f): float(v) for f, v in zip(used, w, strict=True)}
    return model


def _descend(row, col, y, d, ia, ib, weight, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent on logistic loss + L2 + counterfactual penalty; all full sums."""
    w, bias = np.zeros(d), 0.0
    v, vb, t = w.copy(), 0.0, 1.0
    n = len(y)
    seen = np.bincount(row, minlength=n).max(initial=1) + 1
    step = 1 / (0.25 * n * seen**0.5 + L2 + 4 * weight.sum())
    at = lambda x, i: np.where(i >= 0, x[i], 0.0) if d else np.zeros(len(i))

    def loss(x, c):
        m = np.bincount(row, weights=x[col], minlength=n) + c
        gap = at(x, ia) - at(x, ib)
        return np.logaddexp(0, m).sum() - (y * m).sum() + L2 / 2 * (x @ x) + (weight * gap**2).sum()

    last = np.inf
    for _ in range(rounds):
        m = np.bincount(row, weights=v[col], minlength=n) + vb
        r = _sigmoid(m) - y
        g = np.bincount(col, weights=r[row], minlength=d) + L2 * v
        gap = 2 * weight * (at(v, ia) - at(v, ib))
        np.add.at(g, ia[ia >= 0], gap[ia >= 0])
        np.add.at(g, ib[ib >= 0], -gap[ib >= 0])
        while True:  # step sizes are found by trial
            new, new_b = v - step * g, vb - step * r.sum()
            now = loss(new, new_b)
            dx, db = new - v, new_b - vb
            if now <= loss(v, vb) + g @ dx + r.sum() * db + (dx @ dx + db * db) / (2 * step) + 1e-9 or step < 1e-12:
                break
            step /= 2
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if now > last:
            nt, v, vb = 1.0, new, new_b
        else:
            v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - bias)
        if abs(last - now) < 1e-7 * max(1.0, abs(now)):
            return new, new_b
        w, bias, t, last, step = new, new_b, nt, now, step * 1.5
    return w, bias


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(set(model.weights))
        for b in batches:
            s = _sigmoid(model.logits(b.column(1).to_pylist(), buckets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
