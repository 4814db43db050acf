"""Registered queries: each reads the tables below ``sf_dir`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import text as X
from srcatlas.functions.storage import checkpointed, fresh_dir
from srcatlas.functions.typetext import classify_types, type_arguments, unwrap_types
from srcatlas.operators import api, closure, entities, imports, modules, orm, shared, types
from srcatlas.operators.tree import folder_tree
from srcatlas.plans import catalogue, diagram, document
from srcatlas.sources import scan, sinks
from workload import corpus

RUN_DATE = "2024-01-31"
RAW = {"scope": "file", "decorators": "last", "arguments": "raw", "targets": "strict"}
Query = Callable[[SparkSession, str], DataFrame]


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return scan.filter_sources(corpus.sources(spark, d))


def _src(spark: SparkSession, d: str) -> DataFrame:
    return scan.src_only(corpus.sources(spark, d))


def _dotted(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


def _on_scanned(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(_scanned(spark, d))


def _on_src(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(_src(spark, d))


def _on_endpoints(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(api.endpoints(_src(spark, d)))


def _joined(column: str, sep: str = ",") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(column, F.array_join(column, sep))


def _has_prisma(spark: SparkSession, d: str) -> DataFrame:
    return scan.has_prisma_schema(corpus.files(spark, d))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    tree = folder_tree(corpus.files(spark, d))
    return tree.select("project", F.array_join("node", "/").alias("node"), "depth", "name", "line")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    projects = corpus.manifests(spark, d).select("project")
    return scan.validate_requests(corpus.requests(spark, d), projects)


def _unsupported(spark: SparkSession, d: str) -> DataFrame:
    return orm.unsupported_projects(corpus.files(spark, d), corpus.manifests(spark, d))


def _class_records(spark: SparkSession, d: str) -> DataFrame:
    rows = entities.class_records(_scanned(spark, d))
    methods = F.transform(
        "methods", lambda m: F.concat(m["name"], F.lit(":"), m["return_type"])
    )
    properties = F.transform(
        "properties",
        lambda p: F.concat(
            p["name"], F.lit(":"), p["type"], F.lit("@"), F.array_join(p["decorators"], "@")
        ),
    )
    return rows.select(
        "project",
        "path",
        "class_pos",
        "name",
        "kind",
        "file_path",
        "docs",
        F.array_join(methods, ";").alias("methods"),
        F.array_join(properties, ";").alias("properties"),
    )


def _param_map(rows: DataFrame) -> DataFrame:
    m = api.endpoint_param_map(rows)
    text = F.transform(
        F.array_sort(F.map_keys("params")),
        lambda k: F.concat(
            k, F.lit("="), F.element_at("params", k)["name"], F.lit(":"), F.element_at("params", k)["type"]
        ),
    )
    return m.withColumn("params", F.array_join(text, ";"))


def _graph_types(spark: SparkSession, d: str) -> DataFrame:
    rows = types.type_fields(_src(spark, d)).select("project", "path", "type_name", "name", "type")
    return rows


def _classify(spark: SparkSession, d: str) -> DataFrame:
    return classify_types(_graph_types(spark, d), "type")


def _unwrap(spark: SparkSession, d: str) -> DataFrame:
    return unwrap_types(_graph_types(spark, d), "type")


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(
        *closure.TREE,
        _dotted("node").alias("node"),
        "depth",
        "field",
        "type_text",
        "kind",
        F.coalesce("type_name", F.lit("")).alias("type_name"),
        "is_array",
    )


def _tree_lines(spark: SparkSession, d: str, only: str | None = None, **style: str) -> DataFrame:
    printed = closure.printed_types(closure.Types(_src(spark, d), of_endpoints=True))
    made = closure.enum_lines(printed) if only else closure.tree_lines(printed, **style)
    return made.withColumn("node", _dotted("node"))


def _handing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sources whose files hand names on, and their configurations."""
    files = corpus.handing_files(spark, d)
    return scan.src_only(files.filter(F.col("path").endswith(".ts"))), modules.config_files(files)


def _module_tree(spark: SparkSession, d: str) -> DataFrame:
    printed = closure.printed_types(closure.Types(*_handing(spark, d), of_endpoints=True))
    return closure.tree_lines(printed).withColumn("node", _dotted("node"))


def _ringed(spark: SparkSession, d: str) -> closure.Types:
    return closure.Types(scan.src_only(corpus.ringed_files(spark, d)))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(diagram.project_edges(_scanned(spark, d), corpus.manifests(spark, d)))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return orm.supported_projects(corpus.manifests(spark, d)).select("project")


def _erd_edges(spark: SparkSession, d: str) -> DataFrame:
    return diagram.erd_edges(_edges(spark, d))


def _erd_text(spark: SparkSession, d: str) -> DataFrame:
    return diagram.erd_text(_edges(spark, d), _projects(spark, d))


def _write_erd(spark: SparkSession, d: str) -> DataFrame:
    target = fresh_dir(spark, "erd")
    edges = _edges(spark, d)
    sinks.write_erd(diagram.erd_text(edges, _projects(spark, d)), edges, target)
    return spark.read.parquet(target).select("project", "path", "text")


def _ord(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", _dotted("ord"))


def _entity_tables(spark: SparkSession, d: str) -> DataFrame:
    records = document.entity_records(_scanned(spark, d), _src(spark, d), corpus.manifests(spark, d))
    return _ord(document.entity_table_rows(records))


def _class_docs(sources: DataFrame) -> DataFrame:
    return _ord(document.class_doc_lines(document._plain_class_records(sources)))


def _function_docs(sources: DataFrame) -> DataFrame:
    return _ord(document.function_doc_lines(entities.routes(sources)))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return document.document_lines(corpus.files(spark, d), corpus.manifests(spark, d), RUN_DATE)


def _readable(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.translate("path", "\u0001", "/"))


def _write_documents(spark: SparkSession, d: str) -> DataFrame:
    target = fresh_dir(spark, "documents")
    sinks.write_documents(_lines(spark, d), target)
    return _readable(_ord(spark.read.parquet(target)))


def _erd_lines(spark: SparkSession, d: str) -> DataFrame:
    return _ord(document.diagram_lines(_edges(spark, d), _projects(spark, d)))


def _project_json(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.project_json(corpus.files(spark, d), corpus.manifests(spark, d))


def _parse_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = catalogue.parse_project_json(_project_json(spark, d))
    sizes = [F.size(n).alias(f"n_{n}") for n in catalogue.LISTS]
    names = F.array_join(F.transform("entities", lambda e: e["name"]), ",")
    again = F.to_json(F.struct(*catalogue.LISTS), {"ignoreNullFields": "false"})
    return parsed.select(
        "project", "path", "valid", *sizes, names.alias("entity_names"), again.alias("again")
    )


def _text_functions(spark: SparkSession, d: str) -> DataFrame:
    part = corpus.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    name, type_ = F.col("p_name"), F.col("p_type")
    padded = F.concat(F.lit(" \t"), name, F.lit("\r\n "))
    return part.select(
        "p_partkey",
        F.contains(name, F.lit("a")).alias("has_a"),
        name.startswith("p").alias("starts_p"),
        type_.endswith("L").alias("ends_l"),
        X.trim_ws(padded).alias("trimmed"),
        F.upper(name).alias("upper_name"),
        F.lower(type_).alias("lower_type"),
        F.size(F.split(name, " ")).alias("n_words"),
        F.concat_ws("\n", F.split(name, " ")).alias("on_lines"),
        X.unquote(F.concat(F.lit("'"), name, F.lit('"'))).alias("unquoted"),
        X.slash_path(F.concat(F.lit("a\\"), "p_brand")).alias("as_path"),
        X.base_name(F.concat(F.lit("/x/"), "p_brand", F.lit("/"))).alias("base"),
        F.format_string("%s (%s)", name, type_).alias("formatted"),
        F.repeat(F.lit("  "), (F.col("p_partkey") % 4).cast("int")).alias("indent"),
        F.coalesce(F.nullif(type_, F.lit("")), F.lit("unknown")).alias("or_unknown"),
        F.regexp_extract(name, r"(\w+)", 1).alias("first_word"),
        F.size(F.regexp_extract_all(name, F.lit(r"\w+"), F.lit(0))).alias("n_found"),
        name.rlike("^[a-z]").alias("starts_lower"),
        F.date_format(F.to_date(F.lit(RUN_DATE)), "yyyy-MM-dd").alias("stamp"),
        F.col("p_partkey").cast("string").alias("key_text"),
        X.normalize_newlines(padded).alias("newlines"),
    )


def _text_functions_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same helpers on long texts in four languages, and on names of countries."""
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    nations = corpus.table(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("k"), F.col("n_name").alias("t"))
    t = F.col("t")
    return docs.union(nations).select(
        F.col("k").cast("long").alias("k"),
        F.md5(X.trim_ws(F.concat(F.lit(" \t"), t, F.lit("\r\n ")))).alias("trimmed"),
        F.md5(X.normalize_newlines(F.replace(t, F.lit("\n"), F.lit("\r\n")))).alias("newlines"),
        F.md5(X.unquote(F.concat(F.lit('"'), t, F.lit("'")))).alias("unquoted"),
        F.md5(X.slash_path(F.concat(F.lit("a\\"), t))).alias("as_path"),
        F.size(F.split(t, "\n")).alias("n_lines"),
        F.contains(t, F.lit("the")).alias("has_the"),
    )


def _read_tree(spark: SparkSession, d: str) -> DataFrame:
    """A project tree written as files and read back: every customer's file."""
    target = fresh_dir(spark, "tree")
    rows = corpus.customer_files(spark, d, corpus.n_projects(spark, d))
    # one folder for each file; the writer names the file itself
    sinks.write_texts(rows.select(F.concat_ws("/", "project", "path").alias("where"), F.col("content").alias("value")), target)
    read = scan.read_tree(spark, target, "*.txt")
    inside = F.url_decode(F.replace(F.regexp_extract("project", "^where=(.*)$", 1), F.lit("+"), F.lit("%2B")))
    return read.select(
        F.substring_index(inside, "/", 1).alias("project"),
        F.regexp_replace(inside, "^[^/]*/", "").alias("path"),
        F.md5(X.trim_ws(F.col("content"))).alias("content"),
    )


def queries() -> dict[str, Query]:
    return {
        # scans
        "scan_sources": _on_scanned(lambda s: s.select("project", "path")),
        "scan_src_only": _on_src(lambda s: s.select("project", "path")),
        "detect_orm": lambda spark, d: orm.detect_orm(corpus.manifests(spark, d)),
        "has_prisma_schema": _has_prisma,
        "validate_requests": _validated,
        "unsupported_projects": _unsupported,
        "folder_tree": _tree,
        # classes, members, edges
        "classes": _on_scanned(entities.classes),
        "entities": _on_scanned(entities.entities),
        "plain_classes": _on_scanned(entities.plain_classes),
        "methods": _on_scanned(entities.methods),
        "routes": _on_scanned(entities.routes),
        "routes_lazy": _on_scanned(lambda s: entities.routes(s, "lazy")),
        "decorated_statements": _on_scanned(entities.decorated_statements),
        "properties": _on_scanned(lambda s: _joined("decorators")(entities.class_properties(s))),
        "class_properties": _on_scanned(
            lambda s: _joined("decorators")(entities.class_properties(s, **RAW))
        ),
        "property_decorators": _on_scanned(entities.property_decorators),
        "class_methods": _on_scanned(entities.class_methods),
        "class_methods_by_file": _on_scanned(lambda s: entities.class_methods(s, scope="file")),
        "class_records": _class_records,
        "relationships": _on_scanned(entities.relationships),
        "relationships_by_file": _on_scanned(lambda s: entities.relationships(s, **RAW)),
        "rejects": _on_scanned(entities.rejects),
        # interfaces
        "interfaces": _on_src(types.interfaces),
        "interface_properties": _on_src(types.interface_properties),
        "interface_refs": _on_src(types.interface_refs),
        # endpoints
        "controllers": _on_src(api.controllers),
        "endpoints": _on_endpoints(
            lambda e: e.select("project", "path", "pos", "controller", "route", "method_name", "return_type")
        ),
        "endpoint_params": _on_endpoints(api.endpoint_params),
        "endpoint_param_map": _on_endpoints(_param_map),
        "endpoint_responses": _on_endpoints(api.endpoint_responses),
        # types
        "enums": _on_src(types.enums),
        "type_fields": _on_src(types.type_fields),
        "imports": _on_src(imports.imports),
        "classify_types": _classify,
        "unwrap_types": _unwrap,
        "resolve_types": _on_src(types.resolve_types),
        "type_closure": _on_src(lambda s: _nodes(closure.type_closure(s))),
        "circular_types": _on_src(lambda s: _nodes(closure.circular_types(s))),
        "field_lines": _tree_lines,
        "field_lines_json": lambda spark, d: _tree_lines(spark, d, circular_style="json"),
        "enum_lines": lambda spark, d: _tree_lines(spark, d, "enum"),
        "type_cycles": lambda spark, d: shared.type_cycles(_ringed(spark, d)),
        "shared_types": lambda spark, d: shared.shared_types(_ringed(spark, d)),
        # names handed on by modules
        "exports": lambda spark, d: modules.exports(*_handing(spark, d)),
        "module_targets": lambda spark, d: modules.Modules(*_handing(spark, d)).targets,
        "resolve_types_modules": lambda spark, d: types.resolve_types(*_handing(spark, d)),
        "field_lines_modules": _module_tree,
        # diagrams and catalogues
        "erd_edges": _erd_edges,
        "erd_text": _erd_text,
        "erd_lines": _erd_lines,
        "write_erd": _write_erd,
        "project_json": _project_json,
        "parse_project_json": _parse_json,
        # documents
        "entity_table_rows": _entity_tables,
        "class_doc_lines": _on_scanned(_class_docs),
        "function_doc_lines": _on_scanned(_function_docs),
        "endpoint_doc_lines": _on_src(lambda s: _ord(document.endpoint_doc_lines(s))),
        "document_lines": lambda spark, d: _readable(_ord(_lines(spark, d))),
        "documents_text": lambda spark, d: _readable(document.documents_text(_lines(spark, d))),
        "toc": lambda spark, d: _readable(_ord(document.contents(corpus.files(spark, d), corpus.manifests(spark, d), RUN_DATE))),
        "write_documents": _write_documents,
        "text_functions": _text_functions,
        "text_functions_documents": _text_functions_documents,
        "read_tree": _read_tree,
    }
