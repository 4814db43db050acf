"""Registered queries against their SQL, and the pipeline against its stages one by one."""

import pytest
from compare import differences
from pyspark.sql import functions as F

import corpus_pipeline
from srcatlas.llm import bpe, mixing, neardup, quality, substrings
from srcatlas.llm.registry import VOCABULARY, oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_altered_input_is_noticed(spark, sf_dir, name, tmp_path):
    for table in ("documents", "conversations"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.withColumn("text", F.concat(F.lit("One more. "), "text")).write.parquet(f"{tmp_path}/{table}.parquet")
    assert differences(spark, sf_dir, lambda s, d: queries()[name](s, str(tmp_path)), oracle_sql()[name]) is not None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_pipeline_is_its_stages(spark, sf_dir, documents, labels):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "mixing", "encoding"]
    rows = documents
    kept = {r.doc_id for r in quality.judge(rows, labels).filter("kept").collect()}
    rows = rows.filter(F.col("doc_id").isin(kept))
    first = {r.doc_id for r in neardup.near_duplicates(rows).filter("kept").collect()}
    rows = rows.filter(F.col("doc_id").isin(first))
    rows = mixing.draw(substrings.dedup(rows))
    want = bpe.coded(rows, VOCABULARY, decoded="decoded").select("doc_id", "ids", "decoded").collect()
    got = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, list(r.ids), r.decoded)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark, sf_dir, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf_dir).columns == documents.columns


def test_pipeline_of_an_empty_table_and_of_emptied_texts(spark, sf_dir, documents):
    rows = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
        assert rows.collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    twice = spark.createDataFrame([(1, text, "en", "s", 9), (2, text, "en", "s", 9), (3, None, "en", "s", 9)], documents.schema)
    assert [r.doc_id for r in corpus_pipeline.substring_dedup(spark, twice, sf_dir).collect()] == [1]


def test_clashing_columns_pass_through(spark, documents):
    more = documents.limit(50).selectExpr("*", "1 as `a.b`", "'x' as Ids", "'y' as component_id")
    assert neardup.keep_first(more).columns == more.columns
    got = bpe.coded(more, VOCABULARY)
    assert got.columns == [*documents.columns, "a.b", "component_id", "ids"] and len(got.collect()) == 50
