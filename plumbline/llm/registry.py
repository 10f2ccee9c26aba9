"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, byte_dedup, html_text, langid, lm_score, media, ngram_join, oracles, packing, pieces, substring_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("piece_bpe_32k.model")
    got = pieces.decode(pieces.encode(_documents(spark, sf_dir), path), path)
    return got.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text").withColumn("train", F.coalesce(_fold(10) != 0, F.lit(True)))
    got = lm_score.score(docs)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(_fold(4) != 2))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_documents(spark, sf_dir))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_text": op4_html_text,
    "op5_language_id": op5_language_id,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_byte_dedup": op8_byte_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_lm_score": op10_lm_score,
}
ORACLES: dict[str, str] = {"op2_ngram_join": oracles.NGRAM_JOIN, "op3_substring_dedup": oracles.SUBSTRING_DEDUP, "op8_byte_dedup": oracles.BYTE_DEDUP}
