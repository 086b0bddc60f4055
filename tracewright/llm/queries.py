"""The queries of this subpackage, as the driver contract wants them: each applies an operator to its whole table.

Documents without an id are in no fold: nothing is learned from them, and held_out is false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, jaccard_join, langid, line_dedup, periodic, pii, quality, topk, toxicity, urlfilter, warc
from .samples import crc_fold

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_fold("doc_id", 5) != 0))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", crc_fold("doc_id", 5).eqNullSafe(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_read(spark, sf_dir, "documents"), jaccard_join.JoinConfig(width=4, percent=85))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_fold("doc_id", 4) != 2))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", crc_fold("doc_id", 4).eqNullSafe(2).alias("held_out"), "score", (F.col("score") >= model.config.threshold).cast("int").alias("predicted"), "evidence"
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731 (what the field adds is in spans and n_added)
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs, docs.where(crc_fold("doc_id", 4) != 2))
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", crc_fold("doc_id", 4).eqNullSafe(2).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return warc.audit(warc.records(pages), warc.truncated(warc.records(warc.damaged(pages))))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(_read(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.collapsed(docs))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_read(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES)).drop("url")


_ALL = (op1_toxicity, op2_jaccard_join, op3_line_dedup, op4_decontamination, op5_quality, op6_exact_topk, op7_pii, op8_language_id, op9_byte_bpe, op10_warc_fixity, op11_tokenizer_alignment, op12_periodic_runs, op13_url_filters)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE, "op6_exact_topk": topk.ORACLE, "op10_warc_fixity": warc.ORACLE, "op13_url_filters": urlfilter.ORACLE}
