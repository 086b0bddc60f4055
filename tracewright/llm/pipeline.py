"""Stages of a corpus pipeline over the documents table: (spark, docs, sf_dir) -> DataFrame, each on all that the one before kept.

Defined results: every stage but the last returns the columns of its input, whatever their names; documents with null texts, or texts
without a letter, go in the first stage; of linked documents the one with the smallest id stays (of equal ids, and of documents without an
id, which come last, the one of the smallest hash of id and text), and of equal rows one; very long texts are read whole; the last stage
raises if the input already has one of its columns; empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from . import bpe, decontam, jaccard_join, langid, line_dedup
from .samples import crc_fold

#: Below this probability a language isn't taken as found.
LEAST_LANGUAGE_SCORE = 0.5
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def _unused(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    name = "_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; the model learns from the texts and languages of all folds but one."""
    model = langid.fit(docs, docs.where(crc_fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of repeated windows; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \t\r\n")) != ""))
    return cut.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles, the one with the smallest id stays."""
    key = _unused(docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard_join.linked(keyed, jaccard_join.JoinConfig(width=5, percent=80), doc_id=key)
    ids = keyed.select(F.col(key).alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("id"))
    own = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component")).join(ids, "key")
    first = own.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("place"))
    return keyed.join(first.select(F.col("place.key").alias(key)), key, "left_semi").dropDuplicates([key]).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Texts stand for documents, so that null ids don't matter."""
    key = _unused(docs)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    hits = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key).select(key).distinct()
    return keyed.join(hits, key, "left_anti").drop(key)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of the ids and of what they decode to."""
    import public_tokenizers

    coded = bpe.coded(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep=[c for c in docs.columns if c != "text"])
    return bpe.with_digests(coded).drop("decoded")


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list) -> DataFrame:
    """The stages one after the other; what each returns is written and read again."""
    for _, stage in stages[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return stages[-1][1](spark, docs, sf_dir)
