"""From documents to packed sequences: language, quality, exact copies, near
copies, packing. Each stage is a function (spark, docs, sf_dir) → DataFrame;
what it returns is written as Parquet and read again as the next one's docs.

All but the last return the columns of documents, of the rows that stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenstack.llm import exact_dedup, langid, minhash, packing, quality
from lumenstack.llm.common import staged, table, tokenizer_file

#: Share of their five-word shingles from which documents are near copies here.
NEAR = 0.8
#: Words that a packing worker keeps the ids of: memory that earlier stages' executors have left.
WORDS = 174_762


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(docs, NEAR)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), separator=0, with_ids=True, cached=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", packed),
]

#: Learned models, MinHash and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
