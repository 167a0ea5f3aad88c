"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digest_examples, expand_examples, probe_conversation
from .counts import prefix_counts, whole_counts
from .decontam import find_contamination
from .importance import RESAMPLE_SQL, resample
from .licenses import LICENSE_SQL, scan_licenses
from .manifest import MANIFEST_SQL, audit_documents, every_fifth
from .mixing import MIX_SQL, mix_to_targets
from .quality import classify_quality
from .secrets import scan_secrets
from .simhash import near_duplicates
from .tokens import read_tokens, write_tokens
from .vectors import near_vectors
from .warc import WARC_SQL, parse_records, records_of_pages, resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the result are joined by name for the digest; the operator returns a map."""
    found = resolve_revisits(parse_records(records_of_pages(table(spark, sf_dir, "pages"))))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.select("record_id", "url", "base_id", F.unix_seconds("base_at").alias("base_at"), "verdict", headers.alias("headers"))


def op4_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_examples(expand_examples(probe_conversation(table(spark, sf_dir, "conversations"))))


def op8_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), by_word=True)
    return read_tokens(shards, folder)


def op9_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), every_fifth(F.col("doc_id")))


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_counts(prefix_counts(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json")), 1024)


def op13_line_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_sentences, op2_quality_qda, op3_warc_revisits, op4_simhash_gph, op5_mix_targets, op6_subspace_pigeonhole, op7_prefix_targets, op8_token_arrow, op9_assignment_secrets, op10_cgk_decontam, op11_merkle_manifest, op12_prefix_counts, op13_line_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_sentences": LICENSE_SQL, "op3_warc_revisits": WARC_SQL, "op5_mix_targets": MIX_SQL, "op11_merkle_manifest": MANIFEST_SQL, "op13_line_resampling": RESAMPLE_SQL}
