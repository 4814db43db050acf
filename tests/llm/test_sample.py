from pyspark.sql import functions as F

from srcatlas.llm import sample, toxicity


def test_smallest_rows_whatever_the_partitions(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = sorted(r.h for r in rows.collect())[:300]
    for parts in (1, 37):
        got = sample.smallest(rows.repartition(parts), F.col("h"), 300, ["id"])
        assert sorted(r.h for r in got.collect()) == want
    assert sample.smallest(rows, F.col("h"), 300, ["id"]).count() == 300
    assert sample.smallest(rows.limit(0), F.col("h"), 300, ["id"]).count() == 0


def test_hardly_more_rows_are_ordered_than_wanted(spark):
    rows = spark.range(0, 200_000, 1, 64).withColumn("h", F.xxhash64("id"))
    bound = (sample.MARGIN * 500 + sample.MORE) / 200_000
    passed = rows.filter(F.col("h") <= int(bound * (1 << 64)) - (1 << 63)).count()
    assert 500 < passed < 2 * sample.MARGIN * 500


def test_equal_rows_count_once(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    got = sample.smallest(rows, F.xxhash64("k"), 200, ["k"])
    assert got.count() == 101


def test_learned_texts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", 5_000)
    rows = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    rows = rows.union(spark.createDataFrame([(9, "some words 0"), (9, None), (None, "x")], "doc_id long, text string"))
    known = spark.createDataFrame([(7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    texts, _ = toxicity.sample(rows, known)
    assert 0 < sum(len(t.encode()) for t in texts) <= 5_000
    both = spark.createDataFrame([(7, "same"), (9, "same")], "doc_id long, text string")
    texts, toxic = toxicity.sample(both, known)
    assert texts == ["same"] and toxic.tolist() == [True]
