"""Declared types, enums, interfaces, imports, and which declaration a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.outline import block, body, let, narrow, stored_outline, unfold_fields, with_outline
from srcatlas.functions.rows import each, settle
from srcatlas.functions.storage import checkpointed
from srcatlas.functions.text import slash_path, trim_ws, unquote
from srcatlas.functions.typetext import kind_of_base, unwrap_types
from srcatlas.operators.api import endpoints
from srcatlas.operators.imports import with_imports
from srcatlas.operators.modules import KEY, Modules, chain_ends, handed_on

_DECLARATION = (
    r"\b(?:(class|interface|enum)\s+(\w+)[^;{}«]*(?:«[aps]\d+»[^;{}«]*)*"
    r"|(type)\s+(\w+)\s*(?:«a\d+»\s*)?=\s*(?=«b\d+»(?!\s*[|&\[])))«b(\d+)»"
)
# A type that stands for another one: its text ends with a semicolon, a blank line or the next statement.
_ALIAS = (
    r"\btype\s+(\w+)\s*(?:«a(\d+)»\s*)?=\s*([^;=]+?)\s*"
    r"(?=;|\z|\n\s*\n|\n\s*(?:export|declare|abstract|import|type|class|interface|enum|const|let|var|function|async)\b|\n\s*@)"
)
_OBJECT = r"^«b\d+»$"
_STANDS_FOR = r"\btype\s+\w+\s*(?:<[^=;]*>\s*)?="
_FIELD = (
    r"(?md)(?:^|[;,])[ \t\f\r]*(?:@[\w.]+(?:«p\d+»)?\s*)*"
    r"(?:(?:public|private|protected|readonly|static|declare|override|abstract)\s+)*"
    r"(\w+|‹\d+›)[?!]?\s*:\s*([^;,\n=]+(?:\n[ \t]*[|&][^;,\n=]+)*)"
)
_MEMBER = r"^\s*([\w$]+|‹\d+›)"
_TOKEN_ID = r"«[bpas](\d+)»"
_IDS = "struct<all:array<string>,new:array<string>>"


# --- declarations of one file -------------------------------------------------------


def _file_declarations(o: Column) -> Column:
    """array(struct(name, kind, text)) of top-level classes, interfaces, enums and types that are one object."""
    return F.transform(
        F.regexp_extract_all(o["top"], F.lit(_DECLARATION), F.lit(0)),
        lambda d: F.struct(
            F.concat(F.regexp_extract(d, _DECLARATION, 2), F.regexp_extract(d, _DECLARATION, 4)).alias("name"),
            F.concat(F.regexp_extract(d, _DECLARATION, 1), F.regexp_extract(d, _DECLARATION, 3)).alias("kind"),
            body(o, F.regexp_extract(d, _DECLARATION, 5)).alias("text"),
        ),
    )


def _declared_fields(declared: Column) -> Column:
    """array(struct(owner, name, type)) of all declarations; owner is their index."""

    def of_one(d: Column, i: Column) -> Column:
        text = F.when(d["kind"] == "enum", "").otherwise(d["text"])
        return F.transform(
            F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0)),
            lambda m: F.struct(
                i.alias("owner"),
                F.regexp_extract(m, _FIELD, 1).alias("name"),
                F.regexp_extract(m, _FIELD, 2).alias("type"),
            ),
        )

    return F.flatten(F.transform(declared, of_one))


def _declared_members(declared: Column) -> Column:
    """array(struct(owner, name)) of all enum members."""

    def of_one(d: Column, i: Column) -> Column:
        pieces = F.filter(F.split(d["text"], ","), lambda p: p.rlike(_MEMBER))
        return F.transform(
            F.when(d["kind"] == "enum", pieces).otherwise(F.array().cast("array<string>")),
            lambda p: F.struct(
                i.alias("owner"), F.regexp_extract(p, _MEMBER, 1).alias("name")
            ),
        )

    return F.flatten(F.transform(declared, of_one))


def _declaring(sources: DataFrame) -> DataFrame:
    """Files that may declare a class, an interface or an object type; the test reaches the scan."""
    content = F.col("content")
    return sources.filter(content.contains("class") | content.contains("interface") | content.contains("type "))


def _with_declarations(sources: DataFrame) -> DataFrame:
    return with_outline(narrow(sources)).withColumn(
        "declared", _file_declarations(F.col("o"))
    )


def _nested(declared: str, parts: str) -> Column:
    """array(struct(name, kind, own)): each declaration with its own parts, so that no row carries those of others."""
    return let(
        F.struct(F.col(declared).alias("d"), F.col(parts).alias("p")),
        lambda all_: F.transform(
            all_["d"],
            lambda d, i: F.struct(
                d["name"].alias("name"),
                d["kind"].alias("kind"),
                F.filter(all_["p"], lambda p: p["owner"] == i).alias("own"),
            ),
        ),
    )


def type_fields(sources: DataFrame) -> DataFrame:
    """Declared fields of every class, interface and object type."""
    rows = _with_declarations(_declaring(sources)).withColumn(
        "fields", _declared_fields(F.col("declared"))
    )
    rows = unfold_fields(rows, "fields", "name", "type")
    per_type = rows.select(
        "project", "path", F.posexplode(each(_nested("declared", "fields"))).alias("type_pos", "d")
    )
    return per_type.select(
        "project",
        "path",
        "type_pos",
        F.col("d.name").alias("type_name"),
        F.col("d.kind").alias("kind"),
        F.posexplode(each("d.own")).alias("pos", "f"),
    ).select(
        "project",
        "path",
        "type_pos",
        "type_name",
        "kind",
        "pos",
        unquote(F.col("f.name")).alias("name"),
        trim_ws(F.col("f.type")).alias("type"),
    )


def enums(sources: DataFrame) -> DataFrame:
    """Members of every enum."""
    marked = sources.filter(F.col("content").contains("enum"))
    rows = _with_declarations(marked)
    rows = rows.withColumn("declared", F.filter("declared", lambda d: d["kind"] == "enum"))
    rows = rows.withColumn("members", _declared_members(F.col("declared")))
    rows = unfold_fields(rows, "members", "name").select(
        "project", "path", F.explode(each(_nested("declared", "members"))).alias("d")
    )
    return rows.select(
        "project", "path", F.col("d.name").alias("enum"), F.posexplode(each("d.own")).alias("pos", "m")
    ).select("project", "path", "enum", "pos", F.col("m.name").alias("member"))


# --- interfaces -----------------------------------------------------------------------


def interface_records(sources: DataFrame) -> DataFrame:
    """One row per top-level interface with its properties as an ordered array."""
    marked = sources.filter(F.col("content").contains("interface"))
    rows = _with_declarations(marked)
    rows = rows.withColumn("fields", _declared_fields(F.col("declared")))
    rows = unfold_fields(rows, "fields", "name", "type").select(
        "project", "path", F.posexplode(each(_nested("declared", "fields"))).alias("type_pos", "d")
    )
    properties = F.transform(
        "d.own",
        lambda f: F.struct(
            unquote(f["name"]).alias("name"), trim_ws(f["type"]).alias("type")
        ),
    )
    return rows.filter(F.col("d.kind") == "interface").select(
        "project",
        "path",
        "type_pos",
        F.col("d.name").alias("name"),
        slash_path(F.col("path")).alias("file_path"),
        F.lit(P.INTERFACE_DOCS).alias("docs"),
        properties.alias("properties"),
    )


def interfaces(sources: DataFrame) -> DataFrame:
    return interface_records(sources).drop("properties")


def interface_properties(sources: DataFrame) -> DataFrame:
    return (
        interface_records(sources)
        .select(
            "project",
            "path",
            "type_pos",
            F.col("name").alias("interface"),
            F.posexplode(each("properties")).alias("pos", "p"),
        )
        .select("project", "path", "type_pos", "interface", "pos", "p.name", "p.type")
    )


def property_refs(type_: Column) -> Column:
    """array(struct(to, type)) of the interfaces a property type refers to."""
    plain = F.regexp_extract(type_, P.INTERFACE_REF, 1)
    in_tuple = F.when(
        type_.startswith("["), F.regexp_extract(type_, P.INTERFACE_TUPLE_REF, 1)
    ).otherwise("")
    refs = F.array(
        F.struct(plain.alias("to"), F.lit("Ref").alias("type")),
        F.struct(in_tuple.alias("to"), F.lit("RefArray").alias("type")),
    )
    return F.filter(refs, lambda r: r["to"] != "")


def interface_refs(sources: DataFrame) -> DataFrame:
    """Edges between interfaces, in (path, interface, property) order."""
    rows = interface_properties(sources)
    return rows.select(
        "project",
        "path",
        "type_pos",
        F.col("pos").alias("property_pos"),
        "interface",
        F.posexplode(property_refs(F.col("type"))).alias("pos", "r"),
    ).select(
        "project",
        "path",
        "type_pos",
        "property_pos",
        "pos",
        F.col("interface").alias("from"),
        F.col("r.to").alias("to"),
        F.col("r.type").alias("type"),
    )


# --- what a type text refers to ------------------------------------------------------------


def describe(rows: DataFrame, text: str) -> DataFrame:
    """Add base, is_array, type_kind, ref_path and ref_name of a type written in a file.

    Needs ``path`` and ``imported``.  A name means its import if there is one, else a
    declaration of the same file.  An inline object type is its own declaration, named
    by its text.  ``ref_module`` is the module path of an import and ``ref_member`` what is named inside a
    namespace; ``generic`` is a struct of the same for a generic type whose first argument ``base`` is.
    """
    base, kind, path = F.col("base"), F.col("type_kind"), F.col("path")
    # names of the language's own generic types need no look-up
    outer = F.when(~F.col("_generic").isin(P.BUILT_IN_GENERICS), F.col("_generic"))
    named = unwrap_types(rows, text, "_generic").withColumn("type_kind", kind_of_base(base))
    named = named.withColumn("_meant", _meant(base)).withColumn("generic", _meant(outer))
    is_ref = kind == "ref"
    return named.withColumns(
        {
            "ref_path": F.when(kind == "inline", path).when(is_ref, F.col("_meant.ref_path")),
            "ref_name": F.when(kind == "inline", base).when(is_ref, F.col("_meant.ref_name")),
            "ref_module": F.when(is_ref, F.col("_meant.ref_module")),
            "ref_member": F.when(is_ref, F.col("_meant.ref_member")),
        }
    ).drop("_meant", "_generic")


def _meant(name: Column) -> Column:
    """struct(ref_module, ref_path, ref_name, ref_member) of a name in a file; NULL for none."""
    head = F.substring_index(name, ".", 1)
    dotted = F.contains(name, F.lit("."))
    hit = F.get(F.filter("imported", lambda i: (i["local"] == name) | (dotted & (i["local"] == head))), F.lit(0))
    found = hit.isNotNull()
    inner = F.when(found & dotted & (hit["local"] == head), F.substring(name, F.length(head) + 2, F.length(name)))
    meant = F.struct(
        hit["module"].alias("ref_module"),
        F.when(found, hit["target"]).otherwise(F.col("path")).alias("ref_path"),
        F.when(found, hit["name"]).otherwise(name).alias("ref_name"),
        inner.alias("ref_member"),
    )
    return F.when(name.isNotNull(), meant)


def _groups_below(texts: Column) -> Column:
    """Ids of all groups reachable from the tokens in the given folded texts.

    Inner groups have lower ids than the group around them, so every step goes down
    and the number of groups bounds the steps.
    """
    blocks = F.col("o")["blocks"]

    def tokens(ts: Column) -> Column:
        return F.array_distinct(
            F.regexp_extract_all(F.array_join(ts, ""), F.lit(_TOKEN_ID), F.lit(1))
        )

    def step(acc: Column, _: Column) -> Column:
        inside = F.transform(acc["new"], lambda i: F.get(blocks, i.try_cast("int")))
        new = F.array_except(tokens(inside), acc["all"])
        more = F.struct(F.concat(acc["all"], new).alias("all"), new.alias("new"))
        return F.when(F.size(acc["new"]) == 0, acc).otherwise(more).cast(_IDS)

    def below(first: Column) -> Column:
        start = F.struct(first.alias("all"), first.alias("new")).cast(_IDS)
        found = F.aggregate(F.sequence(F.lit(0), F.size(blocks)), start, step, lambda acc: acc["all"])
        return F.when(F.size(first) == 0, first).otherwise(found)

    return let(tokens(texts), below)


def _inline_declarations(ids: Column) -> Column:
    """Brace groups among the given ids, as declarations named by their token."""
    o = F.col("o")
    braces = F.filter(ids, lambda i: block(o, i).startswith("{"))
    return F.transform(
        braces,
        lambda i: F.struct(
            F.concat(F.lit("«b"), i, F.lit("»")).alias("name"),
            F.lit("inline").alias("kind"),
            body(o, i).alias("text"),
        ),
    )


# What stands after the colon of a field, a parameter or a method head, without the
# body that may follow a return type.
_ANNOTATION = (
    r"(?:«p\d+»|\w)\??\s*:\s*"
    r"(«b\d+»|[^;\n=,«]*(?:«[aps]\d+»[^;\n=,«]*)*(?:[|&]\s*«b\d+»)?)"
)


def type_graph(sources: DataFrame) -> DataFrame:
    """Fields of every declared or inline type, each with what it refers to.

    Columns: project, path, name, kind, shown_name, members, pos, field, type_text and
    the ``describe`` columns; one row per field, and one with a NULL ``pos`` for a
    type without fields.  (project, path, name) is the key of a type; together
    with (ref_path, ref_name) one join per level walks the graph.  A class goes
    before an interface of the same name.
    """
    o = F.col("o")

    def by_kind(a: Column, b: Column) -> Column:
        return (
            F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)
        )

    # inline types can stand in fields, parameters and return types; what looks like
    # a type annotation anywhere in a top-level body or a parameter list is a root
    bodies = F.transform("declared", lambda d: d["text"])
    lists = F.filter(o["blocks"], lambda b: b.startswith("("))
    roots = F.regexp_extract_all(
        F.array_join(F.concat(bodies, lists), "\n"), F.lit(_ANNOTATION), F.lit(1)
    )
    meant = F.regexp_extract_all(o["top"], F.lit(_ALIAS), F.lit(3))
    roots = F.concat(roots, F.filter(meant, lambda t: ~t.rlike(_OBJECT)))
    rows = (
        with_imports(_with_declarations(sources))
        .withColumn("_roots", F.filter(roots, lambda t: t.contains("«")))
        .withColumn("_ids", _groups_below(F.col("_roots")))
        .withColumn(
            "declared",
            # sorting is stable, so equal kinds stay in source order
            F.array_sort(F.concat("declared", _inline_declarations(F.col("_ids"))), by_kind),
        )
        .withColumn("fields", _declared_fields(F.col("declared")))
        .withColumn("members", _declared_members(F.col("declared")))
        .drop("_ids", "_roots")
    )
    rows = unfold_fields(rows, "declared", "name")
    rows = unfold_fields(rows, "fields", "name", "type")
    rows = unfold_fields(rows, "members", "name")
    rows = rows.withColumn(
        "owners",
        F.transform("declared", lambda d, i: F.struct(i.alias("owner"), d["name"], d["kind"])),
    ).withColumn("names", F.transform("declared", lambda d: d["name"]))
    # the first declaration of a name is the one that counts
    firsts = F.filter(
        "owners", lambda d: F.array_position("names", d["name"]) == d["owner"] + 1
    )
    owner = F.col("d.owner")
    per_type = (
        rows.select(
            "project", "path", "imported", "fields", "members", F.explode(each(firsts)).alias("d")
        )
        .select(
            "project",
            "path",
            "imported",
            F.col("d.name").alias("name"),
            F.col("d.kind").alias("kind"),
            F.transform(
                F.filter("members", lambda m: m["owner"] == owner), lambda m: m["name"]
            ).alias("members"),
            F.posexplode_outer(F.filter("fields", lambda f: f["owner"] == owner)).alias(
                "pos", "f"
            ),
        )
    )
    flat = per_type.select(
        "project",
        "path",
        "imported",
        "name",
        "kind",
        F.when(F.col("kind") == "inline", "__type").otherwise(F.col("name")).alias("shown_name"),
        "members",
        "pos",
        unquote(F.col("f.name")).alias("field"),
        trim_ws(F.col("f.type")).alias("type_text"),
    )
    return describe(flat, "type_text").drop("imported")


def endpoint_types(sources: DataFrame) -> DataFrame:
    """Described parameter and response types of every endpoint.

    ``slot`` is the parameter's place, or -1 for the response; a handler without a
    return annotation has no response row.
    """
    rows = endpoints(sources, imported=True)
    no_key = F.lit(None).cast("string")
    slots = F.concat(
        F.transform(
            "params",
            lambda p, i: F.struct(
                i.alias("slot"),
                p["key"].alias("key"),
                p["name"].alias("name"),
                p["type"].alias("type"),
            ),
        ),
        F.when(
            F.col("return_type") != "",
            F.array(
                F.struct(
                    F.lit(-1).alias("slot"),
                    no_key.alias("key"),
                    no_key.alias("name"),
                    F.col("response").alias("type"),
                )
            ),
        ).otherwise(
            F.array().cast("array<struct<slot:int,key:string,name:string,type:string>>")
        ),
    )
    keep = ["project", "path", "pos", "route", "controller", "method_name"]
    flat = rows.select(*keep, "imported", F.explode(each(slots)).alias("s")).select(
        *keep, "imported", "s.*"
    )
    return describe(flat, "type").drop("imported")


def type_references(sources: DataFrame) -> DataFrame:
    """Every field and endpoint type that names another type, with the key it names."""
    described = ["base", "is_array", *_REFERENCE]
    fields = type_graph(sources).select(
        "project",
        "path",
        F.col("name").alias("owner"),
        F.col("field").alias("place"),
        *described,
    )
    api = endpoint_types(sources).select(
        "project",
        "path",
        F.col("method_name").alias("owner"),
        F.coalesce("key", F.lit("response")).alias("place"),
        *described,
    )
    is_ref = lambda r: r["type_kind"] == "ref"
    return settle(fields, is_ref).unionByName(settle(api, is_ref))


# --- types that stand for others ----------------------------------------------------------------


_REFERENCE = ["type_kind", "ref_path", "ref_name", "ref_module", "ref_member", "generic"]


def type_aliases(sources: DataFrame) -> DataFrame:
    """Each ``type`` that is not one object: project, path, name, params, text, ``param`` and the ``describe`` columns.

    ``param`` is the place of the type parameter that the type boils down to, -1 for none.
    """
    o = F.col("o")

    def read(m: Column) -> Column:
        params = F.split(body(o, F.regexp_extract(m, _ALIAS, 2)), ",")
        return F.struct(
            F.regexp_extract(m, _ALIAS, 1).alias("name"),
            F.transform(params, lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1)).alias("params"),
            F.regexp_extract(m, _ALIAS, 3).alias("text"),
        )

    rows = with_imports(with_outline(narrow(sources.filter(F.col("content").rlike(_STANDS_FOR)))))
    found = F.transform(F.regexp_extract_all(o["top"], F.lit(_ALIAS), F.lit(0)), read)
    rows = rows.withColumn("aliases", F.filter(found, lambda a: ~a["text"].rlike(_OBJECT)))
    rows = unfold_fields(rows, "aliases", "text").select("project", "path", "imported", F.explode(each("aliases")).alias("a"))
    described = describe(rows.select("project", "path", "imported", "a.*"), "text").drop("imported")
    place = F.coalesce(F.array_position("params", F.col("base")) - 1, F.lit(-1))
    return described.withColumn("param", F.when(F.col("ref_module").isNull(), place).otherwise(-1).cast("int"))


class Names:
    """What names mean across the files of a project: modules, and types that stand for others.

    ``aliases``: ``(project, path, name) -> (to_path, to_name)`` with type_kind, base, is_array and param of what a chain
    of types ends in; a chain that runs into a cycle has none.

    Where no text hands names on, and no text lets a type stand for another, there is nothing to look up.
    """

    def __init__(self, sources: DataFrame, configs: DataFrame | None = None):
        self.modules = Modules(sources, configs) if handed_on(sources, configs) else None
        self.aliases = None
        if sources.filter(F.col("content").rlike(_STANDS_FOR)).isEmpty():
            return
        self.objects = checkpointed(
            settle(_with_declarations(sources.filter(F.col("content").rlike(_STANDS_FOR))).select("project", "path", F.explode(each("declared")).alias("d")))
            .filter("d.kind = 'type'")
            .select("project", "path", "d.name")
            .distinct()
        )
        raw = self._followed(type_aliases(sources))
        # a name declared twice would be an error; the first text counts
        raw = raw.groupBy("project", "path", "name").agg(F.min_by(F.struct(*(c for c in raw.columns if c not in KEY)), "text").alias("a"))
        raw = checkpointed(raw.select(*KEY, "a.*"))
        written = raw.select(*KEY, "is_array", "param", "type_kind", "base", F.col("ref_path").alias("to_path"), F.col("ref_name").alias("to_name"))
        self.aliases = written
        if not raw.isEmpty():
            led = self._through_generics(raw, written)
            edges = led.select(*KEY, F.col("ref_path").alias("to_path"), F.col("ref_name").alias("to_name"), "type_kind", "base", "is_array", "param")
            self.aliases = chain_ends(edges, ("type_kind", "base", "param"), ("is_array",))

    def meant(self, rows: DataFrame) -> DataFrame:
        """Described rows with ref_path, ref_name, base, is_array and type_kind of what their names stand for."""
        rows = self._followed(rows)
        if self.aliases is None:
            return rows.drop("generic")
        return self._through_aliases(self._through_generics(rows, self.aliases))

    def _followed(self, rows: DataFrame) -> DataFrame:
        return self.modules.follow(rows) if self.modules else rows.drop("ref_module", "ref_member")

    def _through_aliases(self, rows: DataFrame) -> DataFrame:
        refers = F.col("ref_name").isNotNull() & F.col("ref_path").isNotNull()
        ends = self.aliases.filter("param < 0").select(
            "project",
            F.col("path").alias("ref_path"),
            F.col("name").alias("ref_name"),
            F.struct("to_path", "to_name", "type_kind", "base", "is_array").alias("_end"),
        )
        end = F.col("_end")
        led = rows.filter(refers).join(ends, ["project", "ref_path", "ref_name"], "left")
        led = led.withColumns(
            {
                "ref_path": F.when(end.isNotNull(), end["to_path"]).otherwise(F.col("ref_path")),
                "ref_name": F.when(end.isNotNull(), end["to_name"]).otherwise(F.col("ref_name")),
                "type_kind": F.coalesce(end["type_kind"], "type_kind"),
                "base": F.coalesce(end["base"], "base"),
                "is_array": F.col("is_array") | F.coalesce(end["is_array"], F.lit(False)),
            }
        ).drop("_end")
        return rows.filter(~refers).unionByName(led)

    def _through_generics(self, rows: DataFrame, aliases: DataFrame) -> DataFrame:
        """Rows whose generic type stands for another one, rewritten; without ``generic``.

        A type that boils down to its first parameter leaves the argument, as an array if it is one; one that boils down to
        something else stands for that; an object type stands for itself. Other generic types leave their first argument.
        """
        rows = checkpointed(rows)
        names = ("ref_module", "ref_path", "ref_name", "ref_member")
        uses = rows.filter("generic is not null").select("project", "path", *(F.col(f"generic.{n}").alias(n) for n in names))
        uses = uses.distinct().withColumn("_generic", F.struct(*names))
        targets = self._followed(uses)
        ends = aliases.select(
            "project", F.col("path").alias("ref_path"), F.col("name").alias("ref_name"),
            F.struct("to_path", "to_name", "type_kind", "base", "is_array", "param").alias("_end"),
        )
        own = self.objects.select("project", F.col("path").alias("ref_path"), F.col("name").alias("ref_name"), F.lit(True).alias("_object"))
        found = targets.join(ends, ["project", "ref_path", "ref_name"], "left").join(own, ["project", "ref_path", "ref_name"], "left")
        itself = F.struct(
            F.col("ref_path").alias("to_path"), F.col("ref_name").alias("to_name"), F.lit("ref").alias("type_kind"),
            F.col("ref_name").alias("base"), F.lit(False).alias("is_array"), F.lit(-1).alias("param"),
        )
        found = found.select("project", "path", F.col("_generic").alias("generic"), F.coalesce(F.when(F.col("_object"), itself), "_end").alias("_end"))
        found = found.filter("_end is not null").select("project", "path", *(F.col(f"generic.{n}").alias(f"_{n}") for n in names), "_end")
        some = rows.filter("generic is not null")
        test = (some["project"] == found["project"]) & (some["path"] == found["path"])
        for n in names:
            test &= some["generic"][n].eqNullSafe(found[f"_{n}"])
        end = F.col("_end")
        replaced = end.isNotNull() & (end["param"] != 0)
        led = some.join(found, test, "left").select(*(some[c] for c in some.columns), "_end")
        led = led.withColumns(
            {
                "ref_path": F.when(replaced, end["to_path"]).otherwise(F.col("ref_path")),
                "ref_name": F.when(replaced, end["to_name"]).otherwise(F.col("ref_name")),
                "type_kind": F.when(replaced, end["type_kind"]).otherwise(F.col("type_kind")),
                "base": F.when(replaced, end["base"]).otherwise(F.col("base")),
                "is_array": F.col("is_array") | F.coalesce(end["is_array"], F.lit(False)),
            }
        )
        return rows.filter("generic is null").unionByName(led.drop("_end")).drop("generic")


def declared_types(sources: DataFrame) -> DataFrame:
    """One row per type that can be referred to: (project, path, name, kind, members)."""
    return (
        type_graph(sources)
        .filter(F.col("pos").isNull() | (F.col("pos") == 0))
        .select("project", "path", "name", "kind", "shown_name", "members")
    )


def with_declaration(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """References with the declaration they mean; its columns are NULL if there is none.

    ``declared`` is unique on the join key, so a name that a large share of all
    references carries only lengthens the left side, whose partition can be split.
    """
    found = declared.select(
        "project",
        F.col("path").alias("ref_path"),
        F.col("name").alias("ref_name"),
        F.col("kind").alias("declared"),
        F.col("shown_name").alias("type_name"),
        "members",
    )
    return refs.join(found, ["project", "ref_path", "ref_name"], "left")


def resolve_types(sources: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Type names with the kind of the declaration they mean, NULL if there is none.

    Names are followed through modules and types that stand for others; ``configs``: the projects' ``tsconfig.json``.
    """
    if "o" not in sources.columns:
        sources = stored_outline(sources)
    led = Names(sources, configs).meant(type_references(sources))
    refs = led.select("project", "path", "owner", "place", "base", "ref_path", "ref_name")
    return with_declaration(refs, declared_types(sources)).drop("type_name", "members")
