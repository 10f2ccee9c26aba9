"""The corpus pipeline: language ID, near duplicates, repeated passages, packing.

Every stage takes the documents that the one before it kept (a table with the columns of
`documents`) and applies one operator of `plumbline.llm` to all of them; `run` writes each
stage's result as Parquet in the folder of spark.checkpoint.dir and reads it again.

- language: documents in which no language can be told (no letter, or no language of
  probability 0.5) go; the language told replaces none that is given. The model learns from
  the labelled documents at hand.
- near_duplicates: of each group of texts that link by five-word shingles (Jaccard similarity
  of 0.75 or more), the document with the smallest doc_id stays. Documents without words are
  no duplicates of each other. Of rows with one doc_id and equal text one stays.
- passages: words in a passage of 50 words that also starts in a document with a smaller
  doc_id go. A text that loses nothing keeps its form; a document all of whose words go is
  dropped. n_chars follows the text.
- packing: what is left is tokenized, and packed into sequences of 4096 along a Hilbert curve.

Nulls: a null text holds no letter, so it goes at the first stage; rows with a null doc_id are
never anyone's duplicate at the second stage (operators state the rest). Extra columns are
carried through. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, ngram_join, packing, substring_dedup
from plumbline.llm._stage import Stage, fresh


def columns(docs: DataFrame) -> list[Column]:
    """All columns by name, whatever signs the names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = fresh("told", docs.columns)
    named = langid.identify(docs, langid.fit(docs), told)
    kept = named.filter(f"{told}.lang_pred != 'und' and {told}.score >= 0.5")
    return kept.withColumn("lang", F.coalesce("lang", f"{told}.lang_pred")).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mine = fresh("kept", docs.columns)
    kept = ngram_join.join(docs).filter("component_id = doc_id").select(F.col("doc_id").alias(mine)).distinct()
    one = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col(mine), "left_semi")
    return one.unionByName(docs.filter("doc_id is null")).dropDuplicates(["doc_id", "text"]).select(*columns(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = substring_dedup.replaced(docs, "text")
    return whole.withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Step = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Step]] = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packed)]
#: Language ID and the sequences' order along the curve can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.table(name, step(spark, docs, sf_dir))
    return docs
