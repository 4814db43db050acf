"""Parsers of further kinds."""

import json

import pytest
from pyspark.sql import functions as F

from srcatlas.operators.entities import class_records
from srcatlas.operators.orm import detect_orm
from srcatlas.plans import catalogue
from srcatlas.plans.parsers import Parser, markers, with_parser

FILES = [
    ("a", "src/x.ts", "@Entity()\nclass X {\n  @Column()\n  id: number;\n}\n"),
    ("b", "src/y.ts", "interface IY {\n  z: string;\n}\n"),
    ("c", "src/z.ts", "class Z {\n}\nclass W {\n}\n"),
    ("d", "src/w.ts", "class V {\n}\n"),
]
MANIFESTS = [("a", '{"typeorm": 1}'), ("b", '{"mongoose": 1, "knexlib": 2}'), ("c", '{"knexlib": 1}'), ("d", "{}"), ("e", '{"knexlib": 1}'), ("f", None)]


def table_classes(sources):
    """Names of a file's classes, as entities without members."""
    named = class_records(sources).groupBy("project", "path").agg(F.sort_array(F.collect_list("name")).alias("names"))
    entity = F.transform(
        "names",
        lambda n: F.struct(
            n.alias("name"), F.col("path").alias("filePath"), F.lit("").alias("docs"),
            F.array().cast(f"array<{catalogue.METHOD}>").alias("methods"), F.array().cast(f"array<{catalogue.PROPERTY}>").alias("properties"),
        ),
    )
    rest = [F.array().cast(f"array<{t}>").alias(n) for n, t in catalogue.LISTS.items() if n != "entities"]
    return named.select("project", "path", entity.alias("entities"), *rest, F.lit(1).alias("kind"))


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(FILES, "project string, path string, content string"),
        spark.createDataFrame(MANIFESTS, "project string, content string"),
    )


def found(rows):
    return {(r.project, r.path): [e["name"] for e in json.loads(r.json)["entities"]] for r in rows.collect()}


def test_a_third_kind(tables):
    before = found(catalogue.project_json(*tables))
    assert before == {("a", ""): [], ("a", "src/x.ts"): ["X"], ("b", ""): [], ("b", "src/y.ts"): ["IY"]}
    parsers = with_parser(catalogue.PARSERS, Parser("knex", table_classes, marker="knexlib"))
    after = found(catalogue.project_json(*tables, parsers))
    # fixed markers come first, so that b stays what it was
    assert after == before | {("c", ""): [], ("c", "src/z.ts"): ["W", "Z"], ("e", ""): []}
    assert "knex" not in catalogue.PARSERS


def test_a_kind_read_another_way(tables):
    parsers = with_parser(catalogue.PARSERS, Parser("mongoose", table_classes))
    assert found(catalogue.project_json(*tables, parsers))["a", "src/x.ts"] == ["X"]
    assert ("b", "src/y.ts") not in found(catalogue.project_json(*tables, parsers))


def test_kinds_without_parsers(tables):
    assert set(found(catalogue.project_json(*tables, {}))) == {("a", ""), ("b", "")}
    kinds = {r.project: r.kind for r in detect_orm(tables[1], markers(with_parser({}, Parser("knex", table_classes, marker="knexlib")))).collect()}
    assert kinds == {"a": "typeorm", "b": "mongoose", "c": "knex", "d": None, "e": "knex", "f": None}
    with pytest.raises(ValueError):
        Parser("x", table_classes, scope="everything")
