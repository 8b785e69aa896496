"""The corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next stage's documents.
No SQL can state the fitted classifier or the tokenizer's ids, so ORACLE_SQL is None; the tests hold the stages against
plain versions (rules counted word by word, every pair of texts compared, targets filled step by step, texts encoded by the
tokenizer itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthcal.llm import cascade, compress, mixing, packing, similar
from synthcal.llm.queries import tokenizer_path
from synthcal.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a rule rejects."""
    return cascade.quality_filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier takes for label 0.

    It is fitted on labelled documents of the whole table: the rules before it leave hardly any of label 0.
    """
    model = compress.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compress.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of five-word shingles 0.8 or more) stays.

    By SimHash's bit-sliced comparison and an exact check, with the buckets that :mod:`synthcal.llm.similar` describes.
    """
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for; n_chars follows a text that is cut."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 4096 tokens."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
