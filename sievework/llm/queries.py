"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.clusters import ORACLE_SQL as OP11_SQL
from sievework.llm.clusters import cluster_vectors
from sievework.llm.codebooks import ORACLE_SQL as OP13_SQL
from sievework.llm.codebooks import compress_vectors
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.imatch import fingerprint_with_neighbours
from sievework.llm.langid import predict_languages, train_languages
from sievework.llm.media import media_facts, resolve, store_texts
from sievework.llm.mixing import mix_sources
from sievework.llm.ngram_join import ngram_jaccard_join
from sievework.llm.packing import pack_power_of_two
from sievework.llm.quality import fold, score_quality, train_quality
from sievework.llm.repair import read_token_shards, write_token_shards
from sievework.llm.secrets import find_secrets
from sievework.llm.warc import ORACLE_SQL as OP4_SQL
from sievework.llm.warc import captures_of, resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = write_token_shards(table(spark, sf_dir, "documents"))
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_gbt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda which: f"array_join(transform({which}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(listed("filter(spans, s -> s.kind <> 'random')")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"), count("random"),
    )


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines)


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op6_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS packed
  FROM documents),
r AS (
  SELECT doc_id, packed,
         first_value(doc_id) OVER (PARTITION BY packed ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY packed) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(packed) AS text_sha256
FROM r
"""


def op10_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, media, _ = store_texts(table(spark, sf_dir, "documents"))
    refs = resolve(sequences.select(F.struct("doc_id", "n_bytes").alias("doc"), "items"), media_facts(media), "doc")
    return refs.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op9_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, train_languages(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_power_of_two(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op11_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_neighbours(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_token_files": op1_repair_token_files,
    "op2_gbt_quality": op2_gbt_quality,
    "op3_token_efficiency_secrets": op3_token_efficiency_secrets,
    "op4_revisit_resolution": op4_revisit_resolution,
    "op5_grouped_prefix_join": op5_grouped_prefix_join,
    "op6_grace_exact_dedup": op6_grace_exact_dedup,
    "op7_interleaved_media": op7_interleaved_media,
    "op8_pack_power_of_two": op8_pack_power_of_two,
    "op9_hierarchical_language": op9_hierarchical_language,
    "op10_subset_sum_mix": op10_subset_sum_mix,
    "op11_weighted_centroids": op11_weighted_centroids,
    "op12_imatch_fingerprints": op12_imatch_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {"op4_revisit_resolution": OP4_SQL, "op6_grace_exact_dedup": OP6_SQL, "op11_weighted_centroids": OP11_SQL, "op13_vector_codes": OP13_SQL}
