"""A training corpus from ``documents``: language ID, line dedup, near-dedup, suffix dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_templates, minhash, packing, suffix_dedup
from tessera.llm.common import drop_stored, stored, tables_stored

#: A text whose best language has less probability than this is in none of them.
LEAST_SCORE = 0.35
TOKENIZER = "word_bpe_49k.json"


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters (null and empty texts too), or
    in no language, go. A null doc_id or lang is judged by its text like any other; repeated rows are
    judged alike; without any label every row goes, as no language is known."""
    net = language_id.fit(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that none is taken for the operator's own
    said = language_id.predict(docs.toDF(*names), net, text=names[docs.columns.index("text")])
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*names).toDF(*docs.columns)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur; the document with the smallest id
    keeps them. Null and empty texts and rows with a null doc_id stay as they are; repeated ids count
    as one document."""
    return counted(line_templates.drop_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of several with
    that id the one with the least key of its text, and of repeated rows one. Rows with a null doc_id
    and texts without words are in no group and stay."""
    return minhash.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes that a document with a smaller id has too. Rows
    with one id lose nothing to each other, those with a null id nothing at all; a null text stays."""
    return counted(suffix_dedup.dedup_texts(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in training sequences. A null or empty text is one
    token, the end id; repeated rows and null ids are packed like others."""
    return packing.pack_texts(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_template_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has read and stored goes once its result is stored."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for k, (_, stage) in enumerate(STAGES):
        known = tables_stored() - own
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            gone = tables_stored() - known
            docs = stored(docs)
            own = tables_stored() - known - gone
            drop_stored(gone)
    return docs
