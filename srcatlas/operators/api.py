"""Controllers, endpoints, their parameters and responses.

Read from the outline of a file, so parameter lists with decorators, nested generics
and string arguments are taken whole.  All of it stays in the file's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.outline import argument, body, narrow, unfold_fields, with_outline
from srcatlas.functions.rows import each
from srcatlas.functions.text import trim_ws, unquote
from srcatlas.functions.typetext import type_arguments
from srcatlas.operators.imports import with_imports

_STACK = r"((?:@[\w.]+(?:«p\d+»)?\s*)+)"
_CONTROLLER_CLASS = (
    _STACK + r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
    r"[^;{}«]*(?:«[aps]\d+»[^;{}«]*)*«b(\d+)»"
)
_CONTROLLER = r"@Controller\b(?:«p(\d+)»)?"
_HANDLER = (
    _STACK + r"(?:(?:public|private|protected|static|async|override)\s+)*"
    r"(\w+)(?:«a\d+»)?\s*«p(\d+)»(?:\s*:\s*([^;\n]*?))?\s*«b\d+»"
    r"(?=[ \t]*(?:\n|$|;|@|\w))"
)
_VERB = r"@(" + "|".join(P.HTTP_DECORATORS) + r")\b(?:«p(\d+)»)?"
_PARAMETER = (
    r"^\s*" + _STACK + r"(?:(?:public|private|protected|readonly)\s+)*"
    r"(\w+|«[bs]\d+»)\??\s*(?::\s*([^=]+?))?\s*(?:=[\s\S]*)?$"
)
_FIRST_DECORATOR = r"^@(?:\w+\.)*(\w+)"


def _controller_outlines(sources: DataFrame, imported: bool = False) -> DataFrame:
    """Outline and first controller class of every file that may hold one.

    The text test runs before the outline, which most files then never need.
    """
    o = F.col("o")
    marked = sources.filter(F.col("content").contains("@Controller"))
    found = F.filter(
        F.regexp_extract_all(o["top"], F.lit(_CONTROLLER_CLASS), F.lit(0)),
        lambda c: F.regexp_extract(c, _CONTROLLER_CLASS, 1).rlike(_CONTROLLER),
    )
    rows = with_outline(narrow(marked))
    if imported:
        rows = with_imports(rows)
    return rows.withColumn("classes", F.slice(found, 1, 1)).withColumn(
        "base", _base_route(o)
    )


def _base_route(o: Column) -> Column:
    """array(struct(name, base_route, text)) of the controller found: one or none."""

    def read(c: Column) -> Column:
        stack = F.regexp_extract(c, _CONTROLLER_CLASS, 1)
        return F.struct(
            F.regexp_extract(c, _CONTROLLER_CLASS, 2).alias("name"),
            argument(o, F.regexp_extract(stack, _CONTROLLER, 1)).alias("base_route"),
            body(o, F.regexp_extract(c, _CONTROLLER_CLASS, 3)).alias("text"),
        )

    return F.transform("classes", read)


def controllers(sources: DataFrame) -> DataFrame:
    """First controller class of every file that has one."""
    rows = unfold_fields(_controller_outlines(sources), "base", "base_route")
    return rows.select("project", "path", F.explode(each("base")).alias("c")).select(
        "project",
        "path",
        F.col("c.name").alias("controller"),
        unquote(F.col("c.base_route")).alias("base_route"),
    )


def file_endpoints(rows: DataFrame) -> DataFrame:
    """Add ``handlers`` and ``params`` to controller outlines.

    ``handlers``: array(struct(verb, method_name, route, return_type)).
    ``params``: array(struct(handler, key, name, type)) of the decorated parameters
    of all handlers.  Texts are still folded.
    """
    o = F.col("o")
    text = F.get(F.col("base"), F.lit(0))["text"]
    found = F.coalesce(
        F.filter(
            F.regexp_extract_all(text, F.lit(_HANDLER), F.lit(0)),
            lambda h: F.regexp_extract(h, _HANDLER, 1).rlike(_VERB),
        ),
        F.array().cast("array<string>"),
    )

    def handler(h: Column) -> Column:
        stack = F.regexp_extract(h, _HANDLER, 1)
        return F.struct(
            F.regexp_extract(stack, _VERB, 1).alias("verb"),
            F.regexp_extract(h, _HANDLER, 2).alias("method_name"),
            argument(o, F.regexp_extract(stack, _VERB, 2)).alias("route"),
            F.regexp_extract(h, _HANDLER, 4).alias("return_type"),
            F.split(body(o, F.regexp_extract(h, _HANDLER, 3)), ",").alias("pieces"),
        )

    def parameter(p: Column, i: Column) -> Column:
        type_ = trim_ws(F.regexp_extract(p, _PARAMETER, 3))
        return F.struct(
            i.alias("handler"),
            F.lower(F.regexp_extract(trim_ws(p), _FIRST_DECORATOR, 1)).alias("key"),
            F.regexp_extract(p, _PARAMETER, 2).alias("name"),
            F.when(type_ == "", "any").otherwise(type_).alias("type"),
        )

    params = F.flatten(
        F.transform(
            "handlers",
            lambda h, i: F.transform(
                F.filter(h["pieces"], lambda p: p.rlike(_PARAMETER)),
                lambda p: parameter(p, i),
            ),
        )
    )
    return (
        rows.withColumn("found", found)
        .withColumn("handlers", F.transform("found", handler))
        .withColumn("params", params)
    )


def _params_of(pos: Column) -> Column:
    """Parameters of one handler; a later one replaces an earlier one of its key.

    A key keeps the place of its first parameter.
    """
    own = F.filter("params", lambda p: p["handler"] == pos)
    keys = F.array_distinct(F.transform(own, lambda p: p["key"]))
    return F.transform(
        keys,
        lambda k: F.element_at(
            F.filter("params", lambda p: (p["handler"] == pos) & (p["key"] == k)), -1
        ),
    )


def endpoints(sources: DataFrame, imported: bool = False) -> DataFrame:
    """One row per endpoint, with its parameters as an ordered array.

    ``imported`` adds the imports of its file.
    """
    keep = ["imported"] if imported else []
    rows = file_endpoints(_controller_outlines(sources, imported))
    rows = unfold_fields(rows, "base", "base_route")
    rows = unfold_fields(rows, "handlers", "route", "return_type")
    rows = unfold_fields(rows, "params", "name", "type")
    base = F.get(F.col("base"), F.lit(0))
    flat = rows.select(
        "project",
        "path",
        *keep,
        base["name"].alias("controller"),
        unquote(base["base_route"]).alias("base_route"),
        "params",
        F.posexplode(each("handlers")).alias("pos", "h"),
    )
    route = unquote(F.col("h.route"))
    full = F.concat(
        F.upper("h.verb"),
        F.lit(" "),
        "base_route",
        F.when(route.startswith("/"), "").otherwise("/"),
        route,
    )
    named = flat.select(
        "project",
        "path",
        *keep,
        "pos",
        "controller",
        full.alias("route"),
        F.col("h.method_name").alias("method_name"),
        _params_of(F.col("pos")).alias("params"),
        trim_ws(F.col("h.return_type")).alias("return_type"),
    )
    return type_arguments(named, "return_type", "response")


def endpoint_params(endpoint_rows: DataFrame) -> DataFrame:
    return endpoint_rows.select(
        "project",
        "path",
        "pos",
        "method_name",
        F.posexplode(each("params")).alias("param_pos", "p"),
    ).select(
        "project", "path", "pos", "method_name", "param_pos", "p.key", "p.name", "p.type"
    )


def endpoint_param_map(endpoint_rows: DataFrame) -> DataFrame:
    """Parameters of each endpoint as a map from key to struct(name, type)."""
    entries = F.transform(
        "params", lambda p: F.struct(p["key"], F.struct(p["name"], p["type"]))
    )
    return endpoint_rows.select(
        "project", "path", "pos", "method_name", F.map_from_entries(entries).alias("params")
    )


def endpoint_responses(endpoint_rows: DataFrame) -> DataFrame:
    return endpoint_rows.select(
        "project", "path", "pos", "method_name", "return_type", "response"
    )
