"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with ``n`` rows and target share ``w`` of ``total`` rows has the repetition rate
``w * total / n``. Each row draws its number of copies by inverting the Poisson distribution of
that mean at a uniform number made from a hash of its id, so a rerun of any task draws the same.
Rates above ``SPLIT`` are drawn as a sum of Poisson numbers of smaller mean (exp would underflow).
Copies are then dealt over all partitions and ordered by a hash of (id, copy, seed): no partition
keeps the order or the source of its input.

The table of rates has a row per source. It is written first, so that Spark plans the join by its
true size: broadcast below the session's threshold, else a shuffled join whose hot source the
adaptive engine splits.

Cases: a null source is a source of its own; null text and other columns are carried as they are;
a row with a null doc_id draws by a hash of all its columns (but maps and variants), which the SQL can't say;
repeated rows draw alike; where docs has a column named like an added one, the added one gets a trailing underscore; a source without a weight
shares none and disappears; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import written

SPLIT = 64.0
#: Hex digits of the hash that make a uniform number: 13 digits are 52 bits, exact in a double.
DIGITS = 13


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson(u: Column, rate: Column) -> Column:
    """Smallest k with P(X <= k) > u for a Poisson X; beyond the reach of a double's tail, the last k."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] > u, s).otherwise(
            F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["k"] + 1).alias("k"))
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["k"]


def copies(seed: str, row: Column, rate: Column) -> Column:
    """Number of copies of a row whose mean is rate."""
    parts = F.greatest(F.lit(1), F.ceil(rate / SPLIT)).cast("int")
    one = F.when(rate > 0, poisson(uniform(seed, row, F.lit(1)), rate)).otherwise(0)
    many = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson(uniform(seed, row, i), rate / parts)
    )
    return F.when(parts == 1, one).otherwise(many)


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """source, rate. weights(source, weight): any positive numbers; without it all sources weigh the same.

    total: rows wanted in all; without it as many as there are.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(w, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_n")
    return written(
        counts.join(F.broadcast(sums)).select(  # one row
            "source", (F.col("weight") / F.col("all_weight") * wanted / F.col("n")).alias("rate")
        ),
        "mix-rates",
    )


def free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """docs with each row as often as drawn, shuffled; adds copy (from 1), mix_rate, mix_copies and order_key (see free_name)."""
    copy, rate, times, order = (free_name(docs, n) for n in ("copy", "mix_rate", "mix_copies", "order_key"))
    own = f"source_{uuid.uuid4().hex}"
    r = rates(docs, weights, total).select(F.col("source").alias(own), F.col("rate").alias(rate))
    drawn = docs.join(r, F.col("source").eqNullSafe(F.col(own))).drop(own)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64(*hashed))
    row = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), nameless))
    drawn = drawn.withColumn(times, copies(seed, row, F.col(rate)))
    out = drawn.filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    out = out.withColumn(order, F.xxhash64(F.lit(seed), F.col("doc_id"), nameless, F.col(copy)))
    return out.repartition(F.col(order)).sortWithinPartitions(order)


ORACLE_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n::DOUBLE AS rate FROM c
), s AS (
  SELECT source, parts, rate / parts AS rate FROM (SELECT source, rate, greatest(1, ceil(rate / 64.0::DOUBLE))::BIGINT AS parts FROM r)
), t AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM s
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM t
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), d AS (
  SELECT row_number() OVER () AS pos, doc_id, documents.source, text, parts FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source
), u AS (
  SELECT d.*, ('0x' || substr(md5('mix:' || doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d, unnest(range(1, parts + 1)) AS x(i)
), n AS (
  SELECT pos, doc_id, u.source, text, count(*) AS n FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source AND t.cdf <= u.u GROUP BY ALL
)
SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy FROM n
"""
