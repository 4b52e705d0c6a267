"""The queries opN_* with production parameters, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoforge.llm import chat, exact_dedup, hard_negatives, media, minhash_dedup, mixing, packing, quality, spelling, substring_dedup, token_counts, toxicity, url_filter
from chronoforge.llm.common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(packing.pack(read_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fields = [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], T.StructType(fields))
    return chat.digests(chat.formatted_chats(rows.unionByName(more)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.mark_near_copies(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.all_statistics(read_table(spark, sf_dir, "documents"))
    return quality.scored(stats, quality.fit(stats, read_table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "copy")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    rules, default = url_filter.mine(url_filter.labelled_pages(pages, read_table(spark, sf_dir, "labels")))
    return url_filter.judged(pages, url_filter.RULES, rules, default)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


_ALL = (
    op1_best_fit_packing, op2_toxicity, op3_matroska, op4_chat_format, op5_minhash_dedup, op6_substring_dedup, op7_quality, op8_token_counts, op9_exact_dedup, op10_mixing,
    op11_url_filter, op12_hard_negatives, op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), r AS (
  SELECT doc_id, i FROM s WHERE x IN (SELECT x FROM s GROUP BY x HAVING count(*) > 1)
), c AS (
  SELECT DISTINCT doc_id, i + k AS at FROM r, range(35) AS u(k)
), g AS (
  SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id
), p AS (
  SELECT d.doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.at GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": _OP6, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL,
        "op11_url_filter": url_filter.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL,
    }
