"""Classes, methods, decorated properties, relations and routes.

Every fact comes out of its own file's row, so a class is put together with its
methods, properties and edges without a join: the extractors are Column expressions
on the text, evaluated once per file or per class body, and exploded at the end.
No operator here shuffles.

Two readings are offered:

* ``scope='class'`` (default) takes members from the class's own body;
  ``scope='file'`` gives every class all members found anywhere in its file.
* ``decorators='all'`` (default) keeps the whole decorator stack of a property;
  ``'last'`` only the decorator next to it.
* ``arguments='strip'`` (default) sets decorator arguments aside before looking for
  the property; ``'raw'`` searches the statement as it stands, so that an option
  object's first key is taken for the property.
* ``targets='any'`` (default) takes the target from the relation's own first
  argument in any of its usual forms; ``'strict'`` takes the first ``(() => X`` of
  the whole statement for every relation in it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import lines as L
from srcatlas.functions import patterns as P
from srcatlas.functions.folding import outline
from srcatlas.functions.members import Reader, class_names
from srcatlas.functions.outline import body, let, narrow, unfold_array, with_outline
from srcatlas.functions.rows import each, settle
from srcatlas.functions.shipping import ship
from srcatlas.functions.text import io_docs, slash_path, trim_ws

_MODIFIERS = "public|private|protected|readonly|static|declare|override|abstract"
_DECORATOR_STACK = r"(?:@[\w.]+(?:«p\d+»)?\s*)+"

# Patterns on folded bodies.
_MEMBER_METHOD = (
    r"(?md)^[ \t\f\r]*(?:(?:public|private|protected)\s*)?(?:async\s+)?"
    r"(\w+)\s*«p(\d+)»\s*:\s*([^\n]+)"
)
_MEMBER_PROPERTY = (
    "(" + _DECORATOR_STACK + r")(?:(?:" + _MODIFIERS + r")\s+)*"
    r"(\w+)\s*[?!]?\s*:\s*([^;]+);"
)
_STACKED = r"@(?:\w+\.)*(\w+)(?:«p(\d+)»)?"
_CLASS_BODY = r"\bclass\s+(\w+)[^;{}«]*(?:«[aps]\d+»[^;{}«]*)*«b(\d+)»"
_RAW_HEAD = (
    r"@\w+\s*(?:\(\s*(?:(?:\([^()]*\)|\w+)\s*=>\s*[\w.]+|['\"]\w+['\"]))?"
)
_TARGET = r"^\(\s*(?:(?:\([^()]*\)|\w+)\s*=>\s*(?:\w+\.)*(\w+)|['\"](\w+)['\"])"
# The same on a folded argument list: an arrow function's parameters are a group.
_FOLDED_TARGET = r"^\(\s*(?:«p(\d+)»|\w+)\s*⇒\s*(?:\w+\.)*(\w+)"
# Parameters that hold neither a group with parentheses nor a literal.
_BARE_PARAMETERS = r"^\([^()«‹]*\)$"


def _find(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _with_bodies(rows: DataFrame) -> DataFrame:
    """Add ``bodies``: for each of ``names`` the folded body of the first class of that
    name, at any nesting level; '' if there is none."""
    o = F.col("o")
    levels = F.concat(F.array(o["top"]), F.filter(o["blocks"], lambda b: b.startswith("{")))
    found = _find(F.array_join(levels, "\n"), _CLASS_BODY)
    heads = F.transform(
        "_found",
        lambda h: F.struct(
            F.regexp_extract(h, _CLASS_BODY, 1).alias("name"), F.regexp_extract(h, _CLASS_BODY, 2).alias("token")
        ),
    )

    def bodies(heads: Column) -> Column:
        def one_body(name: Column) -> Column:
            # array_position is 0 for a name without a body, and an index of -1 gives NULL
            place = F.array_position(heads["name"], name).cast("int") - 1
            return F.coalesce(body(o, F.get(heads["token"], place)), F.lit(""))

        return F.transform("names", one_body)

    return (
        rows.withColumn("_found", found)
        .withColumn("bodies", let(F.struct(heads["name"].alias("name"), heads["token"].alias("token")), bodies))
        .drop("_found")
    )


# --- methods -------------------------------------------------------------------


def _method(name: Column, params: Column, returns: Column) -> Column:
    return F.struct(
        name.alias("name"),
        params.alias("params"),
        returns.alias("return_type"),
        io_docs(params, returns).alias("docs"),
    )


def file_methods(text: Column) -> Column:
    """Annotated methods of a whole text, in order."""
    return F.transform(L.methods(text), lambda m: _method(m["name"], m["params"], m["return_type"]))


# --- properties and edges --------------------------------------------------------


def _edges(decorators: Column) -> Column:
    """array(struct(to, type)) of the relations among (name, target) pairs."""
    relations = F.filter(
        decorators, lambda d: d["name"].isin(P.RELATION_DECORATORS) & (d["target"] != "")
    )
    return F.transform(
        relations, lambda d: F.struct(d["target"].alias("to"), d["name"].alias("type"))
    )


def _own_target(argument: Column) -> Column:
    return F.concat(
        F.regexp_extract(argument, _TARGET, 1), F.regexp_extract(argument, _TARGET, 2)
    )


def _property(name: Column, type_: Column, decorators: Column) -> Column:
    return F.struct(
        name.alias("name"),
        type_.alias("type"),
        F.transform(decorators, lambda d: d["name"]).alias("decorators"),
        _edges(decorators).alias("edges"),
    )


def raw_properties(text: Column, decorators: str, targets: str) -> Column:
    """Properties of the decorated statements of a text, searched as they stand."""

    def read(s: Column) -> Column:
        return F.struct(s["found"]["name"], s["found"]["type"], heads(s).alias("heads"))

    def heads(s: Column) -> Column:
        found = F.transform(
            _find(s["found"]["prefix"], _RAW_HEAD),
            lambda h: F.struct(
                F.regexp_extract(h, r"^@(\w+)", 1).alias("name"),
                (
                    _own_target(F.regexp_extract(h, r"^@\w+\s*(.*)$", 1))
                    if targets == "any"
                    else L.arrow_target(s["statement"])
                ).alias("target"),
            ),
        )
        return F.slice(found, F.greatest(F.size(found), F.lit(1)), F.lit(1)) if decorators == "last" else found

    searched = F.transform(
        L.statements(text), lambda s: F.struct(s.alias("statement"), L.property_of(s).alias("found"))
    )
    made = F.transform(F.filter(searched, lambda s: s["found"].isNotNull()), read)
    return F.transform(made, lambda p: _property(p["name"], p["type"], p["heads"]))


# --- members of class bodies --------------------------------------------------------

_PATTERNS = {
    "class_body": _CLASS_BODY,
    "method": _MEMBER_METHOD,
    "property": _MEMBER_PROPERTY,
    "stacked": _STACKED,
    "target": _TARGET,
    "folded_target": _FOLDED_TARGET,
    "bare": _BARE_PARAMETERS,
}
_MEMBERS = (
    "struct<whole:boolean,names:array<string>,methods:array<struct<owner:int,name:string,params:string,return_type:string>>,"
    "properties:array<struct<name:string,type:string,decorators:array<string>,edges:array<struct<to:string,type:string>>,owner:int>>>"
)
_STRINGS = pa.list_(pa.string())
_ARROW = pa.struct(
    [
        ("whole", pa.bool_()),
        ("names", _STRINGS),
        ("methods", pa.list_(pa.struct([("owner", pa.int32()), ("name", pa.string()), ("params", pa.string()), ("return_type", pa.string())]))),
        (
            "properties",
            pa.list_(
                pa.struct(
                    [("name", pa.string()), ("type", pa.string()), ("decorators", _STRINGS)]
                    + [("edges", pa.list_(pa.struct([("to", pa.string()), ("type", pa.string())]))), ("owner", pa.int32())]
                )
            ),
        ),
    ]
)


def _with_members(rows: DataFrame, wanted: list[str], decorators: str, targets: str) -> DataFrame:
    """Set ``names`` (of the classes) and ``whole``; add, as wanted, ``methods`` and ``properties`` of the class bodies.

    As in a whole text, a parameter list ends at its first closing parenthesis, so methods with parentheses among the
    parameters are left out, and the return type ends at the first opening brace. A text is folded and read in one go, in
    Arrow batches, so that no outline leaves the task; rows that bring their outline along are read from that.
    """
    reader = Reader(_PATTERNS, wanted, decorators, targets)
    ship(rows.sparkSession)

    def of_text(text: str) -> dict:
        names = class_names(text)
        return reader.read(outline(text), names) if names else _NONE

    def of_texts(texts: pa.Array) -> pa.Array:
        # texts may hold what cannot be decoded
        return pa.array([of_text(t.decode("utf-8", "replace")) if t is not None else _NONE for t in texts.cast(pa.binary()).to_pylist()], _ARROW)

    def of_outlines(outlines: pa.Array, names: pa.Array) -> pa.Array:
        pairs = zip(outlines.to_pylist(), names.to_pylist())
        return pa.array([reader.read(o, n) if o is not None and o["top"] is not None and n else _NONE for o, n in pairs], _ARROW)

    if "o" in rows.columns:
        rows = rows.withColumn("_members", F.arrow_udf(of_outlines, _MEMBERS)("o", "names"))
    else:
        rows = rows.withColumn("_members", F.arrow_udf(of_texts, _MEMBERS)("content"))
    names = F.col("_members.names")
    return rows.withColumns({"names": names, "whole": F.col("_members.whole"), **{m: F.col(f"_members.{m}") for m in wanted}}).drop("_members")


_NONE: dict = {"whole": True, "names": [], "methods": [], "properties": []}


# --- files whose brackets do not close --------------------------------------------------


def _section_methods(text: Column) -> Column:
    return F.transform(
        file_methods(text), lambda m: F.struct(m["name"], m["params"], m["return_type"])
    )


def _recovered(rows: DataFrame, member: str, read: Callable[[Column], Column]) -> DataFrame:
    """``member`` read line by line, from each class declaration to the next, where the outline is not whole."""
    fields = [f.name for f in rows.schema[member].dataType.elementType.fields]
    by_lines = F.flatten(
        F.transform(
            L.class_sections(F.col("text")),
            lambda t, i: F.transform(read(t), lambda m: m.withField("owner", i)),
        )
    )
    made = F.transform(by_lines, lambda m: F.struct(*(m[f].alias(f) for f in fields)))
    kind = rows.schema[member].dataType
    return rows.withColumn(member, F.when(F.col("whole"), F.col(member)).otherwise(made.cast(kind)))


def rejects(sources: DataFrame) -> DataFrame:
    """Files that are not read by their brackets but line by line, and why: (project, path, reason).

    Of these files, classes keep the members that line by line reading gives; declared types, interfaces,
    controllers and imports that stand before the fault or behind it are found, those around it are not.
    """
    rows = settle(with_outline(narrow(sources)).select("project", "path", "o.whole"), lambda r: ~r["whole"])
    return rows.select("project", "path", F.lit("brackets do not close").alias("reason"))


# --- per-class records --------------------------------------------------------------


def class_records(
    sources: DataFrame,
    members: tuple[str, ...] = ("methods", "properties"),
    scope: str = "class",
    decorators: str = "all",
    arguments: str = "strip",
    targets: str = "any",
) -> DataFrame:
    """One row per class with the wanted member arrays, in source order.

    Columns: project, path, class_pos, name, kind, file_path, docs and, as wanted,
    ``methods`` and ``properties`` (each property carries its edges).
    """
    content = F.col("content")
    wanted = [m for m in ("methods", "properties") if m in members]
    kind = F.when(content.contains(P.ENTITY_MARKER), "entity").otherwise("class")
    raw = "properties" in wanted and arguments == "raw"
    own_file = scope == "file"
    # files without a class declaration have no rows; the test reaches the scan
    rows = sources.filter(content.contains("class")).select(
        "project",
        "path",
        kind.alias("kind"),
        L.class_names(content).alias("names"),
        content.alias("text"),
        content,
        *(["o"] if "o" in sources.columns else []),
    )
    of_bodies = [m for m in wanted if not (own_file and m == "methods") and not (raw and m == "properties")]
    if raw and not own_file:
        rows = _with_bodies(with_outline(rows.withColumn("_content", F.col("content")), "_content"))
    if of_bodies:
        rows = _with_members(rows, of_bodies, decorators, targets)
    if "methods" in wanted:
        if own_file:
            rows = rows.withColumn("methods", file_methods(F.col("text")))
        else:
            rows = _recovered(rows, "methods", _section_methods)
    if "properties" in wanted:
        if not raw:
            rows = _recovered(
                rows, "properties", lambda t: raw_properties(t, decorators, targets)
            )
        elif own_file:
            rows = rows.withColumn(
                "properties", raw_properties(F.col("text"), decorators, targets)
            )
        else:
            rows = rows.withColumn("bodies", unfold_array(F.col("o"), F.col("bodies")))
            found = F.transform(
                "bodies",
                lambda t, i: F.transform(
                    raw_properties(t, decorators, targets), lambda p: p.withField("owner", i)
                ),
            )
            rows = rows.withColumn("properties", F.flatten(found))

    def own(members: Column, member: str, pos: Column) -> Column:
        made = members[member] if own_file else F.filter(members[member], lambda m: m["owner"] == pos)
        if member == "properties":
            fields = ("name", "type", "decorators", "edges")
            return F.transform(made, lambda m: F.struct(*[m[f].alias(f) for f in fields]))
        return F.transform(made, lambda m: _method(m["name"], m["params"], m["return_type"]))

    # members are put into their class before classes become rows, so that no row carries those of others
    nested = let(
        F.struct(F.col("names").alias("names"), *wanted),
        lambda all_: F.transform(
            all_["names"],
            lambda name, i: F.struct(name.alias("name"), *[own(all_, m, i).alias(m) for m in wanted]),
        ),
    )
    per_class = rows.select(
        "project", "path", "kind", F.posexplode(each(nested)).alias("class_pos", "c")
    )
    return per_class.select(
        "project",
        "path",
        "class_pos",
        F.col("c.name").alias("name"),
        "kind",
        slash_path(F.col("path")).alias("file_path"),
        F.lit(P.CLASS_DOCS).alias("docs"),
        *[F.col(f"c.{m}").alias(m) for m in wanted],
    )


def classes(sources: DataFrame) -> DataFrame:
    return class_records(sources, members=())


def entities(sources: DataFrame) -> DataFrame:
    return classes(sources).filter(F.col("kind") == "entity")


def plain_classes(sources: DataFrame) -> DataFrame:
    return classes(sources).filter(F.col("kind") == "class")


def _exploded(records: DataFrame, column: str) -> DataFrame:
    return records.select(
        "project",
        "path",
        "class_pos",
        F.col("name").alias("class"),
        "kind",
        F.posexplode(each(column)).alias("pos", "m"),
    )


def class_methods(sources: DataFrame, **reading: str) -> DataFrame:
    rows = _exploded(class_records(sources, ("methods",), **reading), "methods")
    return rows.select("project", "path", "class_pos", "class", "kind", "pos", "m.*")


def class_properties(sources: DataFrame, **reading: str) -> DataFrame:
    rows = _exploded(class_records(sources, ("properties",), **reading), "properties")
    return rows.select(
        "project", "path", "class_pos", "class", "kind", "pos", "m.name", "m.type", "m.decorators"
    )


def property_decorators(sources: DataFrame, **reading: str) -> DataFrame:
    rows = class_properties(sources, **reading)
    return rows.select(
        "project",
        "path",
        "class_pos",
        "class",
        F.col("pos").alias("property_pos"),
        F.col("name").alias("property"),
        F.posexplode(each("decorators")).alias("pos", "decorator"),
    )


def relationships(sources: DataFrame, **reading: str) -> DataFrame:
    """Edges of entity classes, in (path, class, property, decorator) order."""
    content = F.col("content")
    # the names of all relations end with one of these two words
    related = content.contains("ToOne") | content.contains("ToMany")
    entity_files = sources.filter(content.contains(P.ENTITY_MARKER) & related)
    rows = _exploded(
        class_records(entity_files, ("properties",), **reading), "properties"
    )
    return rows.select(
        "project",
        "path",
        "class_pos",
        F.col("pos").alias("property_pos"),
        "class",
        F.posexplode(each("m.edges")).alias("pos", "e"),
    ).select(
        "project",
        "path",
        "class_pos",
        "property_pos",
        "pos",
        F.col("class").alias("from"),
        F.col("e.to").alias("to"),
        F.col("e.type").alias("type"),
    )


# --- per-file facts -------------------------------------------------------------------


def methods(sources: DataFrame) -> DataFrame:
    """Annotated methods of every file."""
    return sources.select(
        "project", "path", F.posexplode(file_methods(F.col("content"))).alias("pos", "m")
    ).select("project", "path", "pos", "m.*")


def decorated_statements(sources: DataFrame) -> DataFrame:
    return sources.select(
        "project",
        "path",
        F.posexplode(L.statements(F.col("content"))).alias("pos", "statement"),
    )


def file_routes(text: Column, search: str = "nearest") -> Column:
    """Routes of a text.

    ``search='nearest'`` looks for the handler only up to the next route decorator;
    ``'lazy'`` goes on past it, so a handler may get an earlier decorator's route.
    """

    def read(m: Column) -> Column:
        params, returns = m["found"]["params"], m["found"]["return_type"]
        return F.struct(
            m["found"]["name"].alias("name"),
            F.upper(m["verb"]).alias("method"),
            m["route"].alias("route"),
            params.alias("params"),
            returns.alias("return_type"),
            io_docs(params, returns).alias("docs"),
        )

    return F.transform(L.routes(text, search), read)


def routes(sources: DataFrame, search: str = "nearest") -> DataFrame:
    return sources.select(
        "project",
        "path",
        F.posexplode(file_routes(F.col("content"), search)).alias("pos", "r"),
    ).select("project", "path", "pos", "r.*")
