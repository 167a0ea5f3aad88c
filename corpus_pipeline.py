"""A corpus from raw documents to token files: five operators in turn, each on all that the one before it kept.

In every stage null, empty and very long texts and null or repeated doc_ids are rows like any other, extra columns stay whatever their names, and an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import queries as q
from tracewright.llm.common import shared_path
from tracewright.llm.decontam import drop_contaminated
from tracewright.llm.mixing import take_mix
from tracewright.llm.quality import keep_good
from tracewright.llm.simhash import keep_representatives
from tracewright.llm.tokens import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more; ties are kept). Null and empty texts are scored as empty ones. Without any labels all stay. Repeated rows fare alike."""
    return keep_good(docs, q.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash class: its smallest doc_id; of rows with that id and fingerprint, one. Null and blank texts are one class. A class with null ids alone keeps one row."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and blank texts hold none; without items all stay. Repeated rows fare alike."""
    return drop_contaminated(docs, q.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times. Null source: a source like any other; null text: no words; rows of one doc_id are taken together, those with a null doc_id by their text."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per row (doc_id, start, n_tokens, ids_crc32) where its ids lie in them, read back. Null text: the end id alone. Null doc_id: first; rows of one doc_id: by text."""
    shards, folder = write_tokens(docs, q.public_tokenizer("word_bpe_49k.json"), by_word=True)
    return read_tokens(shards, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Trained models, walks and token files are beyond SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None
