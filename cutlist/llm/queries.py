"""The registered queries of this subpackage, each a thin use of one operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, licences, mixing, neardup, negatives, pii, quality, resample, secrets, sql, toxicity, warc
from .common import shared_dir, table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("matches")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits into one ledger: an earlier state of the table, with the blobs whose address begins with 0 to 7, then the whole table, of which only unseen blobs are scanned."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ledger = secrets.new_ledger(spark)
    secrets.scan(docs.filter(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) < "8"), ledger)
    return secrets.report(docs, ledger)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents", "doc_id", "text"), k=2)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    archives = warc.write_archives(pages, shared_dir(spark))
    return warc.resolved(spark, archives)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    ready = rows.filter(negatives.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), whole.alias("vector"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return negatives.mined(ready)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    profiles = langid.learned(docs.filter(~held).select("text", "lang"))
    return langid.identified(docs.select("doc_id", held.alias("held_out"), "text"), profiles)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_main_text": op9_main_text,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language": op12_language,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = sql.ORACLE_SQL
