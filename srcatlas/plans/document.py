"""Documentation of every project as ordered lines.

Lines have the columns project, section, part, path, ord, line, style, text.  Sorting
by (section, part, path, ord, line) inside a project gives the document.  There is no
running line number: it would need one task to see a whole project.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.outline import stored_outline
from srcatlas.functions.rows import each
from srcatlas.functions.storage import checkpointed
from srcatlas.operators.api import endpoints
from srcatlas.operators.closure import OBJECT_KINDS, Types, printed_types, tree_lines
from srcatlas.operators.entities import class_records, classes, routes
from srcatlas.operators.modules import config_files
from srcatlas.operators.orm import for_kind, of_projects, supported_projects
from srcatlas.operators.tree import folder_tree
from srcatlas.operators.types import interface_records
from srcatlas.plans.diagram import erd_lines, project_edges
from srcatlas.sources.scan import code_files, filter_sources, src_only

# --- fixed values: document wording -------------------------------------------
TITLE = "📘 Project Documentation"
PROJECT_LINE = "Project: Project Documentation"
DATE_LINE = "Generated on: "
CONTENTS = "Table of Contents"
FOLDERS = "Folder Structure"
SCHEMA = "Database Schema"
DETAILS = "Class & Function Details"
ENDPOINTS = "API Endpoints"
ERD_HEADING = "Mermaid ER Diagram Syntax"
ERD_HINT = "(Paste into https://mermaid.live to visualize)"
TABLE_HEADER = "Column | Type | Decorators"
# --- end of fixed values -------------------------------------------------------

_PROPERTIES = "array<struct<name:string,type:string,decorators:array<string>>>"
ORDER = ["project", "section", "part", "path", "ord", "line"]
COLUMNS = [*ORDER, "style", "text"]


def _lines(
    df: DataFrame, section: int, part: int, ord_: Column, lines: Column, path: str | None = "path"
) -> DataFrame:
    """Document lines out of an array(struct(style, text)) column."""
    return df.select(
        "project",
        F.lit(section).alias("section"),
        F.lit(part).alias("part"),
        (F.lit("") if path is None else F.col(path)).alias("path"),
        ord_.cast("array<int>").alias("ord"),
        F.posexplode(each(lines)).alias("line", "l"),
    ).select(*ORDER, "l.style", "l.text")


def _line(style: str | Column, text: Column | str) -> Column:
    style = F.lit(style) if isinstance(style, str) else style
    return F.struct(
        style.alias("style"), (F.lit(text) if isinstance(text, str) else text).alias("text")
    )


def _docs_lines(docs: Column) -> Column:
    """Lines of a docs text: fences dropped, JSON-looking lines in courier."""
    kept = F.filter(F.split(docs, "\n"), lambda x: ~x.startswith("```"))
    code = lambda x: x.startswith("{") | x.startswith("  ") | x.startswith("}")
    return F.transform(kept, lambda x: _line(F.when(code(x), "courier").otherwise("normal"), x))


def entity_table_rows(records: DataFrame) -> DataFrame:
    """Heading, header and one table row per property of every entity."""
    row = lambda p: _line(
        "table",
        F.concat_ws(" | ", p["name"], p["type"], F.array_join(p["decorators"], ", ")),
    )
    lines = F.concat(
        F.array(
            _line("heading2", F.concat(F.lit("Entity: "), "name")),
            _line("table", TABLE_HEADER),
        ),
        F.transform("properties", row),
    )
    return _lines(records, 4, 2, F.array("pos"), lines)


def class_doc_lines(records: DataFrame) -> DataFrame:
    """Name, docs, and each method with its docs."""
    of_method = lambda m: F.concat(
        F.array(_line("heading3", F.concat(F.lit("Method: "), m["name"]))),
        _docs_lines(m["docs"]),
    )
    lines = F.concat(
        F.array(_line("heading2", F.concat(F.lit("Class: "), "name"))),
        _docs_lines(F.col("docs")),
        F.flatten(F.transform("methods", of_method)),
    )
    return _lines(records, 5, 1, F.array("class_pos"), lines)


def function_doc_lines(route_rows: DataFrame) -> DataFrame:
    lines = F.concat(
        F.array(_line("heading2", F.concat(F.lit("Function: "), "name"))),
        _docs_lines(F.col("docs")),
    )
    return _lines(route_rows, 5, 2, F.array("pos"), lines)


def entity_records(sources: DataFrame, src_sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project, path, pos, name, properties) of entities and, for some kinds, interfaces."""

    def of_entities(s: DataFrame) -> DataFrame:
        marked = s.filter(F.col("content").contains("@Entity"))
        properties = F.transform(
            "properties", lambda p: F.struct(p["name"], p["type"], p["decorators"])
        )
        return class_records(marked, ("properties",)).select(
            "project", "path", F.col("class_pos").alias("pos"), "name", properties.alias("properties")
        )

    def of_interfaces(s: DataFrame) -> DataFrame:
        properties = F.transform(
            "properties",
            lambda p: F.struct(
                p["name"], p["type"], F.array().cast("array<string>").alias("decorators")
            ),
        )
        return interface_records(s).select(
            "project", "path", F.col("type_pos").alias("pos"), "name", properties.alias("properties")
        )

    return for_kind(sources, manifests, "typeorm", of_entities).unionByName(
        for_kind(src_sources, manifests, "mongoose", of_interfaces)
    )


def _plain_class_records(sources: DataFrame) -> DataFrame:
    plain = sources.filter(~F.col("content").contains("@Entity"))
    return class_records(plain, ("methods",))


def endpoint_heads(sources: DataFrame) -> DataFrame:
    """The first lines of every endpoint: heading, controller and method."""
    heads = endpoints(sources).select("project", "path", "pos", "route", "controller", "method_name", "params")
    head_lines = F.array(
        _line("heading2", F.concat(F.lit("Endpoint: "), "route")),
        _line(
            "quote",
            F.concat(F.lit("Controller: "), "controller", F.lit(" → Method: "), "method_name"),
        ),
    )
    request = F.when(
        F.size("params") > 0, F.array(_line("normal", "Request Params:"))
    ).otherwise(F.array().cast("array<struct<style:string,text:string>>"))
    return _lines(heads, 6, 1, F.array("pos", F.lit(0)), F.concat(head_lines, request))


def endpoint_doc_lines(sources: DataFrame, circular_style: str = "mark", configs: DataFrame | None = None) -> DataFrame:
    """Endpoint headings, parameters with their fields, response fields, blank line.

    ``ord`` is (endpoint, part, slot, place in the type tree...).
    """
    types = Types(sources, configs, of_endpoints=True)
    used = types.used
    heads = endpoints(sources).select("project", "path", "pos")
    start = endpoint_heads(sources)
    end = _lines(heads, 6, 1, F.array("pos", F.lit(3)), F.array(_line("normal", "")))

    is_object = F.col("declared").isin(OBJECT_KINDS)
    shown = (
        F.when(is_object, F.col("type_name"))
        .when(F.col("declared") == "enum", F.concat("type_name", F.lit(" (enum)")))
        .when(F.col("type_kind") == "literal", F.concat("base", F.lit(" (literal)")))
        .when(F.col("type_kind").isin("date", "opaque"), F.concat("base", F.lit(" (primitive)")))
        .otherwise(F.concat("name", F.lit(" ("), "type", F.lit(")")))
    )
    is_param = F.col("slot") >= 0
    params = _lines(
        used.filter(is_param),
        6,
        1,
        F.array("pos", F.lit(1), "slot"),
        F.array(_line("courier", F.concat(F.lit("- "), "key", F.lit(": "), shown))),
    )
    objects = used.filter(is_object)
    response = _lines(
        objects.filter(~is_param),
        6,
        1,
        F.array("pos", F.lit(2)),
        F.array(_line("normal", "Response:")),
    )
    trees = tree_lines(printed_types(types), circular_style).select(
        "project",
        F.col("root_path").alias("ref_path"),
        F.col("root_name").alias("ref_name"),
        "node",
        "line",
        "indent",
        F.col("text").alias("tree_text"),
    )
    first = F.when(is_param, 2).otherwise(1)
    part = F.when(is_param, F.array(F.lit(1), F.col("slot"))).otherwise(
        F.array(F.lit(2), F.lit(0))
    )
    fields = (
        objects.select("project", "path", "pos", "slot", "ref_path", "ref_name")
        .join(trees, ["project", "ref_path", "ref_name"])
        .select(
            "project",
            F.lit(6).alias("section"),
            F.lit(1).alias("part"),
            "path",
            F.concat(F.array("pos"), part, "node").alias("ord"),
            "line",
            F.lit("courier").alias("style"),
            F.concat(F.repeat(F.lit("  "), first + F.col("indent")), "tree_text").alias("text"),
        )
    )
    return reduce(DataFrame.unionByName, [start, params, response, fields, end])


def _headings(projects: DataFrame, run_date: str) -> DataFrame:
    """What every document has: cover, section headings, diagram heading and hint."""
    none = F.array().cast("array<int>")
    date = F.date_format(F.to_date(F.lit(run_date)), "yyyy-MM-dd")
    cover = F.array(
        _line("title", TITLE),
        _line("quote", PROJECT_LINE),
        _line("quote", F.concat(F.lit(DATE_LINE), date)),
    )
    parts = [_lines(projects, 1, 0, none, cover, None)]
    for section, text in enumerate([CONTENTS, FOLDERS, SCHEMA, DETAILS, ENDPOINTS], 2):
        lines = [_line("heading1", text)]
        if text == SCHEMA:
            lines.append(_line("heading2", ERD_HEADING))
        parts.append(_lines(projects, section, 0, none, F.array(*lines), None))
    return reduce(DataFrame.unionByName, parts)


def diagram_lines(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Diagram block after its heading: text lines, then the hint."""
    body = erd_lines(edges, projects).select(
        "project",
        F.lit(4).alias("section"),
        F.lit(0).alias("part"),
        "path",
        # behind the headings, which have no ord
        F.concat(F.array(F.lit(1)), "ord").alias("ord"),
        "line",
        F.lit("courier").alias("style"),
        "text",
    )
    hint = _lines(
        projects, 4, 1, F.array().cast("array<int>"), F.array(_line("quote", ERD_HINT)), None
    )
    return body.unionByName(hint)


def tree_section(files: DataFrame, projects: DataFrame) -> DataFrame:
    known = folder_tree(files).join(projects, "project", "left_semi")
    return known.select(
        "project",
        F.lit(3).alias("section"),
        F.lit(1).alias("part"),
        # chr(1) sorts before every sign a name can hold, so parents come first
        F.array_join("node", "\u0001").alias("path"),
        F.array().cast("array<int>").alias("ord"),
        F.lit(0).alias("line"),
        F.lit("courier").alias("style"),
        F.col("line").alias("text"),
    )


def toc(lines: DataFrame) -> DataFrame:
    """Headings of levels 1 to 3 among document lines, by document order."""
    return lines.filter(F.col("style").isin("heading1", "heading2", "heading3")).select(
        *ORDER, F.regexp_extract("style", r"\d", 0).try_cast("int").alias("level"), "text"
    )


def document_lines(files: DataFrame, manifests: DataFrame, run_date: str, **reading: str) -> DataFrame:
    """All lines of the documents of all supported projects.

    Source texts are folded once; every section projects from that.
    """
    projects = supported_projects(manifests).select("project")
    code = stored_outline(of_projects(code_files(files), projects))
    sources, src_sources = filter_sources(code), src_only(code)
    typeorm = lambda extract: for_kind(sources, manifests, "typeorm", extract)
    edges = checkpointed(project_edges(sources, manifests, **reading))
    sections = [
        _headings(projects, run_date),
        tree_section(files, projects),
        diagram_lines(edges, projects),
        entity_table_rows(entity_records(sources, src_sources, manifests)),
        class_doc_lines(typeorm(_plain_class_records)),
        function_doc_lines(typeorm(routes)),
        endpoint_doc_lines(src_sources, configs=config_files(of_projects(files, projects))),
    ]
    return reduce(DataFrame.unionByName, [s.select(*COLUMNS) for s in sections])


def contents(files: DataFrame, manifests: DataFrame, run_date: str) -> DataFrame:
    """Headings of the documents of all supported projects: the lines ``toc`` finds in them, without making the others.

    Neither type trees, properties, folder trees nor diagrams are made for it.
    """
    projects = supported_projects(manifests).select("project")
    content = F.col("content")
    code = of_projects(code_files(files), projects)
    # names of classes and routes are read from the text; what else gives a heading is folded
    folded = (content.contains("class") & ~content.contains("@Entity")) | content.contains("interface") | content.contains("@Controller")
    outlined = stored_outline(code.filter(folded))
    sources = filter_sources(code)
    typeorm = lambda rows, extract: for_kind(rows, manifests, "typeorm", extract)
    bare = lambda rows, pos: rows.select(
        "project", "path", F.col(pos).alias("pos"), "name", F.array().cast(_PROPERTIES).alias("properties")
    )
    entity_names = typeorm(sources, lambda s: bare(classes(s.filter(content.contains("@Entity"))), "class_pos"))
    interface_names = for_kind(src_only(outlined), manifests, "mongoose", lambda s: bare(interface_records(s), "type_pos"))
    sections = [
        _headings(projects, run_date),
        entity_table_rows(entity_names.unionByName(interface_names)),
        class_doc_lines(typeorm(filter_sources(outlined), _plain_class_records)),
        function_doc_lines(typeorm(sources, routes)),
        endpoint_heads(src_only(outlined)),
    ]
    return reduce(DataFrame.unionByName, [toc(s) for s in sections])


def documents_text(lines: DataFrame) -> DataFrame:
    """Document text in pieces: (project, section, part, path, text).

    One piece per file and section part; in order, joined by line ends, the pieces are
    the whole document.  A piece is bounded by one file's lines, so the size of a
    project does not matter.
    """
    return (
        lines.groupBy("project", "section", "part", "path")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "line", "text"))).alias("ls"))
        .select(
            "project",
            "section",
            "part",
            "path",
            F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"),
        )
    )
