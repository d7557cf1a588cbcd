"""A training-data pipeline over the documents table: five stages, each on what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import langid, linededup, nearsets, packing, quality
from lumenframe.llm._shared import quoted, shared_dir, table, written
from lumenframe.llm.queries import BYTE_VOCABULARY


def _same(docs: DataFrame) -> list[Column]:
    return [quoted(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence; the model learns from their labels."""
    model = langid.train(docs.select("text", "lang"))
    return langid.predict(docs, model).where("accepted").select(*_same(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and lie within their group's robust cutoff."""
    stats = written(quality.with_text_stats(docs))
    return quality.with_verdict(stats).where("kept").select(*_same(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines."""
    out = linededup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_same(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: by SimHash, verified at a similarity of five-word shingles of at
    least 0.8, and by an exact index of the shingles what SimHash leaves."""
    return nearsets.dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    with open(BYTE_VOCABULARY, encoding="utf-8") as f:
        return packing.pack(docs, f.read())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Language identification and the robust outliers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(path)
    return docs
