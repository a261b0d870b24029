"""Registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatwise.llm import (
    backtrack, binpack, bpe, caps, fim, html, langid, lines, neardup, packing, planes, quality, shards,
)
from repeatwise.llm.work import documents, held_out
from repeatwise.session import shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RATIO, MIN_PAGES = 0.1, 5
SHARDS, TOLERANCE = 24, 0.02
MULTI_BPE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
FIM_SEED = 42
CLUSTERS, ROUNDS, CLUSTER_SEED, SCALE = 40, 5, 2, 256


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn(
        "text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shards.histogram_shards(docs, SHARDS, tolerance=TOLERANCE, carry=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs, PIECES, allowed=~held_out(F.col("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_patterns(documents(spark, sf_dir), BYTE_BPE)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, ratio=RATIO, min_pages=MIN_PAGES,
                                  n_lines="n_lines", n_dropped="n_dropped")


def op6_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the packed matrices, and returns a digest of each row as read back."""
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    binpack.write_packed(binpack.packed_rows(documents(spark, sf_dir), BYTE_BPE), path)
    rows = spark.read.parquet(path)
    return rows.select(
        "block", "row", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "pieces", "starts",
        F.sha2("ids", 256).alias("ids_sha256"), F.crc32("positions").alias("positions_crc32"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extracted(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_BPE).select(
        "doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


def op9_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.linked_vectors(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")) \
        .drop("embedding")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality_rules(docs).select(
        "doc_id", *(f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered",
            "longest", "longest_words", "base_failed", "kept")))


def op11_swar_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), FIM_SEED)
    back = fim.restored(F.col("fim.form"), F.col("fim.output"))
    return docs.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return backtrack.round_trip(docs, MULTI_BPE, PATTERN).select(
        "doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.clustered(documents(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, CLUSTER_SEED, SCALE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


OP5 = "WITH " + lines.SQL.format(docs="documents", ratio=RATIO, min_pages=MIN_PAGES) + """
SELECT doc_id, source, array_to_string(rest, chr(10)) AS text,
       CASE WHEN ls IS NULL THEN 0 ELSE len(ls) END AS n_lines,
       CASE WHEN ls IS NULL THEN 0 ELSE len(ls) - len(rest) END AS n_dropped
FROM cleaned
"""


#: CRC-32 bit by bit for the table of bytes, then a fold over each text's bytes.
OP1 = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, lower(hex(encode(coalesce(text, '')))) AS h,
         coalesce(('0x' || left(md5(text), 15))::BIGINT, -1) AS key
  FROM documents),
summed AS (
  SELECT doc_id, size, key, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      range(0, (size - 8)::BIGINT), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::INT])), 4294967295) AS text_crc32
  FROM docs, crc),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id) - size AS b0,
         sum(size) OVER (ORDER BY key) - sum(size) OVER (PARTITION BY key) AS g0,
         sum(size) OVER (ORDER BY key) AS g1, sum(size) OVER () AS total
  FROM summed),
targets AS (SELECT k, max(total) * k / {SHARDS}.0 AS t, {TOLERANCE} * max(total) / {SHARDS} AS loose
            FROM placed, range(1, {SHARDS}) r(k) GROUP BY k),
splits AS (
  SELECT k, CASE WHEN least(t - g0, g1 - t) <= loose THEN CASE WHEN t - g0 <= g1 - t THEN g0 ELSE g1 END
                 WHEN t - b0 <= b0 + size - t THEN b0 ELSE b0 + size END AS cut
  FROM targets JOIN placed ON b0 <= t AND t < b0 + size),
sharded AS (
  SELECT doc_id, size, text_crc32, key, (SELECT count(*) FROM splits WHERE cut <= b0)::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""


OP11 = "WITH " + fim.SQL.format(docs="documents", seed=FIM_SEED, rate=fim.RATE, spm_rate=fim.SPM_RATE) + """
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM fim
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_histogram_shards": OP1, "op5_line_dedup": OP5, "op11_swar_fill_in_middle": OP11,
            "op13_bit_plane_clusters": planes.sql("embeddings", CLUSTERS, ROUNDS, CLUSTER_SEED, SCALE)}
