import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from ids and texts; further columns as given."""

    def make(rows, schema=SCHEMA):
        full = [(*r, "en", f"s{(r[0] or 0) % 3}", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()

