"""Exact deduplication, skew-safe, with DataFrame functions only.

Texts are equal when identical after each run of blanks is replaced by one space. Grouping goes by
digest *and* full normalised text at every stage, so a digest collision never merges two texts:

1. local: the map side of the first aggregation keeps one row per text and task;
2. salted: local winners of one digest are merged over ``salts`` reducers (the salt is the number
   of the scan task, so that copies met by one task still collapse there);
3. global: at most ``salts`` winners per text are combined.

Every row then meets its class by digest alone (numbers, no text), which is exact because stage 3
counts the contents of each digest; a digest with several contents takes a path that compares text.

Cases: null text counts as empty; a null doc_id is never smallest, counts in ``group_size`` and is
kept only where its whole group has no id; repeated rows with the same doc_id and text are all reported (and
kept once by ``deduplicate``), rows of one doc_id with different texts are rows of different groups; of rows without an id ``deduplicate`` keeps one per text, beside the row with
an id if their text has one; an empty table gives no rows; other columns are ignored here and
carried through unchanged by ``deduplicate``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import SPACES, whole_text, written


def normalised() -> Column:
    return F.regexp_replace(whole_text(), SPACES, " ")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, normalised text and its SHA-256 (binary)."""
    return docs.select("doc_id", normalised().alias("norm")).withColumn("digest", digest(F.col("norm")))


def contents(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id, group_size."""
    salted = (
        digests(docs)
        .groupBy("digest", "norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def classes_by_digest(docs: DataFrame, salts: int) -> DataFrame:
    """digest, keep_id, group_size, n_contents (1, but for digests that several texts share); written."""
    groups = contents(docs, salts).groupBy("digest")
    found = groups.agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_contents"))
    return written(found, "exact-classes")


def mark_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = classes_by_digest(docs, salts)
    rows = digests(docs).select("doc_id", "digest")
    marked = rows.join(classes.filter("n_contents = 1").drop("n_contents"), "digest")
    clashes = classes.filter("n_contents > 1").select("digest")
    if not clashes.isEmpty():
        by_text = contents(docs, salts).join(clashes, "digest", "left_semi")
        rows = digests(docs).join(clashes, "digest", "left_semi")
        marked = marked.unionByName(rows.join(by_text, ["digest", "norm"]).drop("norm"))
    return marked.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each text the row with the smallest id, once; of rows without an id one per text."""
    classes = classes_by_digest(docs, salts)
    key, norm = (f"{name}_{uuid.uuid4().hex}" for name in ("digest", "norm"))  # no columns of docs
    marked = docs.withColumn(key, digest(normalised()))
    firsts = classes.filter("n_contents = 1").select(F.col("keep_id").alias("doc_id"), F.col("digest").alias(key))
    named = marked.join(firsts, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(docs.columns)
    clashes = classes.filter("n_contents > 1").select(F.col("digest").alias(key))
    if not clashes.isEmpty():
        by_text = contents(docs, salts).select(F.col("digest").alias(key), F.col("norm").alias(norm), F.col("keep_id").alias("doc_id")).join(clashes, key, "left_semi")
        rows = marked.withColumn(norm, normalised()).join(by_text, [key, norm, "doc_id"], "left_semi").dropDuplicates(["doc_id", key, norm])
        named = named.unionByName(rows.select(docs.columns))
    nameless = docs.filter(F.col("doc_id").isNull()).withColumn(norm, normalised()).dropDuplicates([norm])
    return named.unionByName(nameless.select(docs.columns))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
