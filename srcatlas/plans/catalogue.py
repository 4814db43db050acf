"""Catalogue records as JSON, written and read back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.operators.entities import class_records, routes
from srcatlas.operators.orm import supported_projects
from srcatlas.operators.types import interface_records, property_refs
from srcatlas.plans.parsers import Parser, facts, markers, with_parser

METHOD = "struct<name:string,docs:string,returnType:string>"
PROPERTY = "struct<name:string,type:string,decorators:array<string>>"
CLASS = (
    f"struct<name:string,filePath:string,docs:string,methods:array<{METHOD}>,"
    f"properties:array<{PROPERTY}>>"
)
FUNCTION = "struct<name:string,method:string,route:string,docs:string,returnType:string>"
EDGE = "struct<from:string,to:string,type:string>"
SCHEMA = (
    f"struct<entities:array<{CLASS}>,classes:array<{CLASS}>,"
    f"functions:array<{FUNCTION}>,relationships:array<{EDGE}>>"
)
LISTS = {"entities": CLASS, "classes": CLASS, "functions": FUNCTION, "relationships": EDGE}


def _empty(item: str) -> Column:
    return F.array().cast(f"array<{item}>")


def _class_json(properties: Column, methods: Column) -> Column:
    return F.struct(
        "name",
        F.col("file_path").alias("filePath"),
        "docs",
        methods.cast(f"array<{METHOD}>").alias("methods"),
        properties.cast(f"array<{PROPERTY}>").alias("properties"),
    ).cast(CLASS)


def _typeorm_files(sources: DataFrame) -> DataFrame:
    """One record per file that has classes or routes.

    Grouping is by file: no group is larger than what one file holds.
    """
    methods = F.transform(
        "methods",
        lambda m: F.struct(m["name"], m["docs"], m["return_type"].alias("returnType")),
    )
    properties = F.transform(
        "properties", lambda p: F.struct(p["name"], p["type"], p["decorators"])
    )
    edges = F.flatten(
        F.transform(
            "properties",
            lambda p: F.transform(
                p["edges"],
                lambda e: F.struct(
                    F.col("name").alias("from"), e["to"].alias("to"), e["type"].alias("type")
                ),
            ),
        )
    )
    is_entity = F.col("kind") == "entity"
    record = _class_json(properties, methods)
    no_class, no_function = F.lit(None).cast(CLASS), F.lit(None).cast(FUNCTION)
    classes = class_records(sources).select(
        "project",
        "path",
        F.col("class_pos").alias("pos"),
        F.when(is_entity, record).otherwise(no_class).alias("entity"),
        F.when(is_entity, no_class).otherwise(record).alias("class"),
        no_function.alias("function"),
        F.when(is_entity, edges).otherwise(_empty(EDGE)).cast(f"array<{EDGE}>").alias("edges"),
    )
    functions = routes(sources).select(
        "project",
        "path",
        "pos",
        no_class.alias("entity"),
        no_class.alias("class"),
        F.struct("name", "method", "route", "docs", F.col("return_type").alias("returnType"))
        .cast(FUNCTION)
        .alias("function"),
        _empty(EDGE).alias("edges"),
    )
    in_order = F.array_sort(
        F.collect_list(F.struct("pos", "entity", "class", "function", "edges")),
        lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0),
    )
    pick = lambda f: F.filter(F.transform("facts", lambda x: x[f]), lambda x: x.isNotNull())
    return (
        classes.unionByName(functions)
        .groupBy("project", "path")
        .agg(in_order.alias("facts"))
        .select(
            "project",
            "path",
            pick("entity").alias("entities"),
            pick("class").alias("classes"),
            pick("function").alias("functions"),
            F.flatten(F.transform("facts", lambda x: x["edges"])).alias("relationships"),
        )
    )


def _mongoose_files(sources: DataFrame) -> DataFrame:
    properties = F.transform(
        "properties",
        lambda p: F.struct(p["name"], p["type"], F.array().cast("array<string>").alias("d")),
    )
    edges = F.flatten(
        F.transform(
            "properties",
            lambda p: F.transform(
                property_refs(p["type"]),
                lambda r: F.struct(
                    F.col("name").alias("from"), r["to"].alias("to"), r["type"].alias("type")
                ),
            ),
        )
    )
    no_methods = F.array().cast(f"array<{METHOD}>")
    return (
        interface_records(sources)
        .select(
            "project",
            "path",
            F.struct(
                F.col("type_pos").alias("pos"),
                _class_json(properties, no_methods).alias("entity"),
                edges.cast(f"array<{EDGE}>").alias("edges"),
            ).alias("i"),
        )
        .groupBy("project", "path")
        .agg(
            F.array_sort(
                F.collect_list("i"),
                lambda a, b: F.when(a["pos"] < b["pos"], -1)
                .when(a["pos"] > b["pos"], 1)
                .otherwise(0),
            ).alias("facts")
        )
        .select(
            "project",
            "path",
            F.transform("facts", lambda x: x["entity"]).alias("entities"),
            _empty(CLASS).alias("classes"),
            _empty(FUNCTION).alias("functions"),
            F.flatten(F.transform("facts", lambda x: x["edges"])).alias("relationships"),
        )
    )


#: The parsers there are; ``with_parser`` adds further kinds.
PARSERS = with_parser(
    {},
    Parser("typeorm", _typeorm_files),
    Parser("mongoose", _mongoose_files, scope="src"),
)


def project_json(files: DataFrame, manifests: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """Catalogue documents: (project, path, json), from the files of all projects.

    Every document is a whole catalogue record of one file; a project's catalogue is
    the concatenation of its documents' lists in ``path`` order.  Each supported
    project also has an empty document under path '', so projects without facts (and
    kinds whose extraction yields nothing) are there too.
    """
    empty = supported_projects(manifests, markers(parsers)).select(
        "project", F.lit("").alias("path"), *[_empty(t).alias(n) for n, t in LISTS.items()]
    )
    rows = empty.unionByName(facts(files, manifests, parsers, ["project", "path", *LISTS])) if parsers else empty
    record = F.struct(*[F.col(n).cast(f"array<{t}>").alias(n) for n, t in LISTS.items()])
    return rows.select(
        "project", "path", F.to_json(record, {"ignoreNullFields": "false"}).alias("json")
    )


def parse_project_json(documents: DataFrame) -> DataFrame:
    """Catalogue documents as columns, with ``valid`` and empty lists for missing ones.

    A document is valid if it has the keys entities, classes and functions, whatever
    their values; relationships may be missing.
    """
    keys = F.json_object_keys("json")
    needed = ["entities", "classes", "functions"]
    valid = F.array_contains(keys, needed[0])
    for key in needed[1:]:
        valid = valid & F.array_contains(keys, key)
    parsed = F.from_json("json", SCHEMA)
    return documents.select(
        "project",
        "path",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        *[F.coalesce(parsed[n], _empty(t)).alias(n) for n, t in LISTS.items()],
    )
