"""Spelling variants: words one code point apart, found by a bit-sliced position index, and the form each stands for.

* Words are counted per batch of texts in Python, then summed by Spark.
* Dealing: an edit leaves the first or the last ``(m - 1) / 2`` code points (rounded up) of the shorter word, of length m, as they
  are. Every word is dealt by its first and by its last so many code points, once as the shorter and once as the longer word of
  a pair; a hash packs these keys into groups of some ``LETTERS`` letters, and a group that a common key makes too large is cut into blocks
  that meet pairwise, each pair of blocks in a task's group of its own. No pair is listed unless it is near.
* Index of a group: for each position and letter, the bitset of the words that have it there. All words of length m run through
  the index at once, 64 words of the vocabulary a machine word: ``same`` holds the words that agree so far, ``swapped`` those with one
  replaced code point, and ``longer``, which looks one position ahead, those with one code point inserted. A step costs three
  rows of ANDs and ORs, whatever the pairs.
* A pair that agrees in its first half is reported where it was dealt by that half, all others where they were dealt by the
  last one, so each pair is reported once.
* Each word's near words are counted and the largest chosen in one sum. Roots come by doubling: a form is at
  least ``RATIO`` times as frequent, so a chain of forms has at most ``CHAIN`` links and ``ROUNDS`` doublings reach its end.

Cases: a null text has no words; a null doc_id counts as an empty one in the hash; repeated rows count again; upper-case letters
beyond A-Z stay as they are; a run of any length is one word; of near words with the same count the smallest in code-point order is the form; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written

SHORTEST, FEWEST, RATIO, ERRED = 7, 2, 10, 31
#: Letters of a group, about; a group of more than twice as many is cut into blocks.
LETTERS = 16_384
#: Counts are longs below 2^63: no chain of forms is longer, and so many doublings pass it.
CHAIN, ROUNDS = 18, 5
#: Different words that a task counts before it hands them on.
COUNTED = 200_000

_run = re.compile("[A-Za-zÀ-ÿ]+")
_lower = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def spelled(doc_id: int | None, run: str) -> str:
    """The run as it counts: in one of ERRED cases, by a hash of document and run, without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % ERRED else (k := h % len(run), run[:k] + run[k + 1 :])[1]


def words(docs: DataFrame) -> DataFrame:
    """word, n of the words of at least SHORTEST code points that occur FEWEST times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        total: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for run, n in Counter(_run.findall((text or "").translate(_lower))).items():
                    if len(run) >= SHORTEST and len(word := spelled(doc_id, run)) >= SHORTEST:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield hand_on()
        yield hand_on()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEWEST)


def _half(m):
    """Code points at either end that one edit can't touch both of, for a shorter word of length m."""
    return -(-(m - 1) // 2) if isinstance(m, int) else F.ceil((m - 1) / 2).cast("int")


def dealt(vocabulary: DataFrame) -> DataFrame:
    """Groups of words that may be near: m, tail, g, i, j, side, word, n; blocks i and j of a group meet (one block if they are the same)."""
    size = F.length("word")
    each = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= SHORTEST)
    both = each.select("word", "n", "m", F.explode(F.array(F.lit(False), F.lit(True))).alias("tail"))
    end = _half(F.col("m"))
    key = F.xxhash64(F.when(F.col("tail"), F.substring("word", F.length("word") - end + 1, end)).otherwise(F.substring("word", F.lit(1), end)))
    fit = F.greatest(F.lit(32), F.expr(f"{LETTERS} div m"))
    room = each.groupBy("m").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / fit)).alias("groups"))
    grouped = written(both.join(room, "m").select("word", "n", "m", "tail", F.pmod(key, "groups").alias("g")), "spelling-dealt")
    sizes = grouped.groupBy("m", "tail", "g").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short")).filter("size > 1 AND short > 0")
    sizes = written(sizes.withColumn("blocks", F.when(F.col("size") > 2 * fit, F.ceil(F.col("size") / fit)).otherwise(1).cast("int")).drop("size", "short"), "spelling-groups")
    own = grouped.join(sizes, ["m", "tail", "g"]).withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    met = own.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("m", "tail", "g", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") > F.col("to")).alias("side"), "word", "n")


def _letters(some: list[str], width: int) -> np.ndarray:
    """Code points by word and position; 0 beyond the end."""
    return np.array([w.ljust(width, "\0") for w in some], f"<U{width}").view(np.uint32).reshape(len(some), width) if some else np.zeros((0, width), np.uint32)


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitsets, 64 a number."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def near(asked: list[str], vocabulary: list[str], tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in asked, in vocabulary) of words one edit apart: asked are all of one length m, those met of length m or m + 1.

    tail False: only pairs that agree in their first half; True: only those that don't.
    """
    m = len(asked[0])
    q, v = _letters(asked, m), _letters(vocabulary, m + 1)
    size = np.array([len(w) for w in vocabulary])
    as_long, one_more = _bits((size == m)[None])[0], _bits((size == m + 1)[None])[0]

    def has(position: int, asked_at: int) -> np.ndarray:
        """For each asked word, the bitset of the words that have its letter of asked_at at the position."""
        letters, which = np.unique(q[:, asked_at], return_inverse=True)
        return _bits(v[None, :, position] == letters[:, None])[which]

    same = np.tile(as_long | one_more, (len(q), 1))
    swapped, longer, half = np.zeros_like(same), same & one_more, same
    for k in range(m):
        here = has(k, k)
        swapped = (swapped & here) | (same & ~here & as_long)
        same = same & here
        longer = (longer & has(k + 1, k)) | (same & one_more)
        if k + 1 == _half(m):
            half = same
    found = (swapped | longer) & (~half if tail else half)
    rows, at = np.nonzero(found)
    bits = np.unpackbits(found[rows, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    one, bit = np.nonzero(bits)
    return rows[one], at[one] * 64 + bit


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, other, other_n: each near pair from both sides, once."""

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, tail, _, i, j = key
        out = []

        def meet(asked: pd.DataFrame, others: pd.DataFrame, once: bool) -> None:
            """once: both are one block, where words of a length meet from both sides."""
            if len(asked) and len(others):
                a, b = near(asked["word"].tolist(), others["word"].tolist(), bool(tail))
                one, two = asked.iloc[a].reset_index(drop=True), others.iloc[b].reset_index(drop=True)
                new = ((one["word"].str.len() < two["word"].str.len()) | (one["word"] < two["word"])).to_numpy() if once else np.ones(len(a), bool)
                for x, y in ((one, two), (two, one)):
                    out.append(pd.DataFrame({"word": x["word"], "other": y["word"], "other_n": y["n"]})[new])

        length = pdf["word"].str.len()
        if i == j:
            meet(pdf[length == m], pdf, True)
        else:
            one, two = pdf[~pdf["side"]], pdf[pdf["side"]]
            meet(one[one["word"].str.len() == m], two, False)
            meet(two[two["word"].str.len() == m], one[one["word"].str.len() == m + 1], False)
        return pd.concat(out) if out else pd.DataFrame({"word": [], "other": [], "other_n": []}).astype({"word": "object", "other": "object", "other_n": "int64"})

    return dealt(vocabulary).groupBy("m", "tail", "g", "i", "j").applyInPandas(pairs, "word string, other string, other_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    with temporary(docs.sparkSession):
        vocabulary = written(words(docs), "spelling-words")
        best = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        strong = -F.col("best.less") >= RATIO * F.col("n")
        found = vocabulary.join(best, "word", "left").select(
            "word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
        )
        found = written(found, "spelling-forms", outlive=True)
        links = written(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots", outlive=True)
        for _ in range(ROUNDS):
            on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
            links = written(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots", outlive=True)
        return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by a table that SQL builds, near words by the words without one code point each.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))
), w AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS n FROM w WHERE length(run) >= {SHORTEST} GROUP BY doc_id, run
), b AS (
  SELECT run, n, regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..') AS x FROM d
), c AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || y)::BIGINT FOR y IN x]), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b, t
), s AS (
  SELECT CASE WHEN h % {ERRED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}
), l AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM v, unnest(range(1, length(word) + 1)) AS r(i)
), p AS (
  SELECT a.word, b.word AS other, b.n FROM l AS a JOIN l AS b ON a.i = b.i AND a.x = b.x AND a.word != b.word
  UNION SELECT l.word, v.word, v.n FROM l JOIN v ON l.x = v.word
  UNION SELECT v.word, l.word, l.n FROM l JOIN v ON l.x = v.word
), g AS (
  SELECT word, count(*) AS n_near, first({{'n': n, 'other': other}} ORDER BY n DESC, other) AS best FROM p GROUP BY word
), f AS (
  SELECT v.word, CASE WHEN best.n >= {RATIO} * v.n THEN best.other END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {RATIO} * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN g USING (word)
), o AS (
  SELECT word, word AS root FROM f UNION SELECT o.word, f.form FROM o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o USING (word) JOIN f AS e ON e.word = o.root WHERE e.form IS NULL
"""
