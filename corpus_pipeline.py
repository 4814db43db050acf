"""The pipeline from raw documents to token ids, in five stages; counted as part of ``srcatlas.llm``.

Each stage takes what the one before kept, whole, as a written table. All but the last return the columns of
``documents``:

1. quality rules: documents that fail the rules or are anomalous go;
2. near-dedup: the smallest ``doc_id`` of each group of near duplicates stays;
3. substring dedup: passages that a document with a smaller ``doc_id`` has go from the texts, and documents that have no
   word left go;
4. mixing: a document is there as often as its source's weight has it, at least once;
5. encoding: ``ids`` and ``n_tokens`` of each text, and the text that they decode to.

Null texts and texts without words fail the quality rules. An empty table goes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm import bpe, mixing, neardup, quality, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.dedup(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.coded(docs.select("doc_id", "source", "lang", "text"), path, decoded="decoded")
    return rows.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Signatures, forests and merges are not expressible in SQL; see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
