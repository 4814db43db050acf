"""Which file a module path means, what files export, and where an imported name is declared.

Module paths are looked up as the compiler does with a project's ``tsconfig.json``: relative to the importing file, through the alias
whose pattern fits (an exact one before others, then the longest prefix), or below ``baseUrl``; ``x.ts`` goes before
``x/index.ts``. Whether a file exists is a join on the paths of the project; contents are not moved.

Exports form a graph ``(file, name) -> (file, name)``. Chains of exports by name are shortened by pointer jumping, two steps by
four and so on, so their length counts only by its logarithm. ``export *`` hands on what a file exports, names
``default`` and names that the file exports itself excepted; each round carries over only what is new. Cycles add nothing new.
A name that ``export *`` brings from two declarations is not exported, as in the language.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.outline import body, narrow, with_outline
from srcatlas.functions.rows import each
from srcatlas.functions.storage import checkpointed
from srcatlas.operators.imports import DEFAULT, NAMESPACE, beside, module_text, walked, with_imports

_LIST = r"\bexport\s+(?:type\s+)?«b(\d+)»(?:\s*from\s*‹(\d+)›)?"
_STAR = r"\bexport\s*(?:type\s+)?\*\s*(?:as\s+([\w$]+)\s*)?from\s*‹(\d+)›"
_DEFAULT = (
    r"\bexport\s+default\s+(?:(?:abstract|async)\s+)*(?:(?:class|interface|enum|function)\s+)?"
    r"(?!(?:extends|implements|new|function|class)\b)([A-Za-z_$][\w$]*)"
)
_DECLARED = (
    r"\bexport\s+(?:(?:declare|abstract|const)\s+)*(?:class|interface|enum|type)\s+([A-Za-z_$][\w$]*)"
)
_ITEM = r"^\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$"
_EXPORTED = "array<struct<name:string,local:string,module:string>>"
_CONFIG = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
_ALIASES = "array<struct<exact:boolean,prefix:string,suffix:string,targets:array<string>>>"
KEY = ["project", "path", "name"]
ENDS = ["to_path", "to_name"]


# --- what a file writes ---------------------------------------------------------------------


def _file_exports(o: Column) -> Column:
    """array(struct(name, local, module)) of the export statements of a file.

    ``name`` is NULL for ``export *``; ``local`` is ``*`` for it and for ``export * as name``. ``module`` is NULL for what the file
    itself has.
    """
    none = F.lit(None).cast("string")

    def made(name: Column, local: Column, module: Column = none) -> Column:
        return F.struct(name.alias("name"), local.alias("local"), module.alias("module"))

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(o["top"], F.lit(pattern), F.lit(0))

    def of_list(m: Column) -> Column:
        slot = F.regexp_extract(m, _LIST, 2)
        items = F.filter(F.split(body(o, F.regexp_extract(m, _LIST, 1)), ","), lambda i: i.rlike(_ITEM))
        module = F.when(slot != "", module_text(o, slot))
        local = lambda i: F.regexp_extract(i, _ITEM, 1)
        return F.transform(items, lambda i: made(F.coalesce(F.nullif(F.regexp_extract(i, _ITEM, 2), F.lit("")), local(i)), local(i), module))

    def of_star(m: Column) -> Column:
        return made(F.nullif(F.regexp_extract(m, _STAR, 1), F.lit("")), F.lit(NAMESPACE), module_text(o, F.regexp_extract(m, _STAR, 2)))

    return F.concat(
        F.flatten(F.transform(all_of(_LIST), of_list)).cast(_EXPORTED),
        F.transform(all_of(_STAR), of_star).cast(_EXPORTED),
        F.transform(all_of(_DEFAULT), lambda m: made(F.lit(DEFAULT), F.regexp_extract(m, _DEFAULT, 1))).cast(_EXPORTED),
        F.transform(all_of(_DECLARED), lambda m: made(F.regexp_extract(m, _DECLARED, 1), F.regexp_extract(m, _DECLARED, 1))).cast(_EXPORTED),
    )


def file_modules(sources: DataFrame) -> DataFrame:
    """``project, path, imported, exported`` of the files that import or export anything.

    An exported name that the file has imported is an export from where it was imported.
    """
    text = F.col("content")
    rows = with_imports(with_outline(narrow(sources.filter(text.contains("import") | text.contains("export")))))
    rows = rows.select("project", "path", "imported", _file_exports(F.col("o")).alias("exported"))

    def through_import(e: Column) -> Column:
        hit = F.get(F.filter("imported", lambda i: e["module"].isNull() & (i["local"] == e["local"])), F.lit(0))
        return F.struct(
            e["name"],
            F.coalesce(hit["name"], e["local"]).alias("local"),
            F.coalesce(e["module"], hit["module"]).alias("module"),
        )

    return rows.withColumn("exported", F.transform("exported", through_import))


# --- which file a module path means ------------------------------------------------------------


def config_files(files: DataFrame) -> DataFrame:
    """``project, content`` of the projects' ``tsconfig.json``."""
    return files.filter(F.col("path") == "tsconfig.json").select("project", "content")


def path_aliases(configs: DataFrame) -> DataFrame:
    """``project, base_url, aliases`` of each project; base_url is NULL where none is set.

    ``aliases``: array(struct(exact, prefix, suffix, targets)). Comments and commas before a closing bracket are allowed.
    Another file that a configuration extends is not read.
    """
    plain = F.regexp_replace("content", r",(\s*[}\]])", "$1")
    options = F.from_json(plain, _CONFIG, {"allowComments": "true"})["compilerOptions"]
    star = F.lit("*")
    pairs = F.coalesce(F.map_entries(F.col("_o.paths")), F.array().cast("array<struct<key:string,value:array<string>>>"))
    aliases = F.transform(
        pairs,
        lambda e: F.struct(
            (~F.contains(e["key"], star)).alias("exact"),
            F.substring_index(e["key"], "*", 1).alias("prefix"),
            F.when(F.contains(e["key"], star), F.substring_index(e["key"], "*", -1)).otherwise("").alias("suffix"),
            e["value"].alias("targets"),
        ),
    )
    rows = configs.dropDuplicates(["project"]).withColumn("_o", options)
    return rows.select("project", walked(F.col("_o.baseUrl")).alias("base_url"), aliases.alias("aliases"))


def _bases() -> Column:
    """Paths without suffix that a module path may mean, the first one first; none for packages."""
    module, base_url = F.col("module"), F.col("base_url")

    def fits(a: Column) -> Column:
        long = F.length(module) >= F.length(a["prefix"]) + F.length(a["suffix"])
        return F.when(a["exact"], module == a["prefix"]).otherwise(module.startswith(a["prefix"]) & module.endswith(a["suffix"]) & long)

    ranked = F.transform(
        F.filter("aliases", fits),
        lambda a, i: F.struct(a["exact"], F.length(a["prefix"]).alias("long"), (-i).alias("place"), a["prefix"], a["suffix"], a["targets"]),
    )
    best = F.array_max(ranked)
    inside = F.length(module) - F.length(best["prefix"]) - F.length(best["suffix"])
    star = F.substring(module, F.length(best["prefix"]) + 1, inside)
    from_alias = F.transform(best["targets"], lambda t: walked(F.concat_ws("/", base_url, F.replace(t, F.lit("*"), star))))
    below = F.array(
        F.when(base_url.isNotNull(), walked(F.concat_ws("/", base_url, module))),
        F.when(module.startswith("src/"), walked(module)),
    )
    relative = F.array(beside(F.col("path"), module))
    return (
        F.when(module.rlike(r"^\.\.?(?:/|$)"), relative)
        .when(best.isNotNull(), from_alias)
        .otherwise(F.filter(below, lambda b: b.isNotNull()))
    )


def _files_of(base: Column) -> Column:
    return (
        F.when(base == "", F.array(F.lit("index.ts")))
        .when(base.endswith(".ts"), F.array(base))
        .when(base.rlike(r"\.[cm]?js$"), F.array(F.regexp_replace(base, r"\.([cm]?)js$", r".$1ts")))
        .otherwise(F.array(F.concat(base, F.lit(".ts")), F.concat(base, F.lit("/index.ts"))))
    )


def module_targets(uses: DataFrame, paths: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """``project, path, module, target, found`` for each distinct module path that a file uses.

    ``target`` is the first file there is, with ``found``; else the first that might be, NULL for packages. A project's
    aliases come as one array, so the join with them has one row on its side; a hot project only lengthens the other.
    """
    uses = uses.select("project", "path", "module").distinct()
    if configs is None:
        known = uses.withColumn("base_url", F.lit(None).cast("string")).withColumn(
            "aliases", F.array().cast(_ALIASES)
        )
    else:
        known = uses.join(path_aliases(configs), "project", "left")
        known = known.withColumn("aliases", F.coalesce("aliases", F.array().cast(_ALIASES)))
    candidates = F.flatten(F.transform(F.col("bases"), _files_of))
    rows = known.withColumn("bases", _bases()).select("project", "path", "module", candidates.alias("candidates"))
    rows = checkpointed(rows)
    some = rows.select("project", "path", "module", F.posexplode(each("candidates")).alias("place", "target"))
    there = paths.select("project", F.col("path").alias("target"), F.lit(True).alias("there"))
    # a path that may as well be a package's names a file only if there is one
    kept = ~F.col("t.missing") | F.col("module").rlike(r"^(?:\.\.?(?:/|$)|src/)")
    first = (
        some.join(there, ["project", "target"], "left")
        .groupBy("project", "path", "module")
        .agg(F.min(F.struct(F.col("there").isNull().alias("missing"), "place", "target")).alias("t"))
        .select("project", "path", "module", F.when(kept, F.col("t.target")).alias("target"), (~F.col("t.missing")).alias("found"))
    )
    packages = rows.filter(F.coalesce(F.size("candidates"), F.lit(0)) < 1)
    return first.unionByName(
        packages.select("project", "path", "module", F.lit(None).cast("string").alias("target"), F.lit(False).alias("found"))
    )


# --- chains -----------------------------------------------------------------------------------------


def chain_ends(edges: DataFrame, taken: tuple[str, ...] = (), either: tuple[str, ...] = ()) -> DataFrame:
    """Edges ``(project, path, name) -> (to_path, to_name)``, one for each key, led on to the ends of their chains.

    Columns ``taken`` come from the last edge of a chain, those of ``either`` hold if they hold on any. Chains that run into a
    cycle have no end and are left out.
    """
    columns = edges.columns
    edges = checkpointed(edges)
    keys = edges.select("project", F.col("path").alias("to_path"), F.col("name").alias("to_name"))
    to = ["project", *ENDS]
    open_ = checkpointed(edges.join(keys, to, "left_semi").select(*columns))
    if open_.isEmpty():
        return edges
    ended = [checkpointed(edges.join(keys, to, "left_anti").select(*columns))]
    # each round doubles the steps taken, and a chain without a cycle has no more edges than are open
    for _ in range(math.ceil(math.log2(max(open_.count(), 1))) + 1):
        if open_.isEmpty():
            break
        known = reduce(DataFrame.union, [e.withColumn("_ended", F.lit(True)) for e in ended], open_.withColumn("_ended", F.lit(False)))
        then = known.select(
            "project",
            F.col("path").alias("to_path"),
            F.col("name").alias("to_name"),
            F.struct(*(c for c in columns if c not in KEY), "_ended").alias("_then"),
        )
        new = {c: F.col(f"_then.{c}") for c in (*ENDS, *taken)}
        new |= {c: F.col(c) | F.coalesce(F.col(f"_then.{c}"), F.lit(False)) for c in either}
        led = open_.join(then, to).select(*(new[c].alias(c) if c in new else c for c in columns), "_then._ended")
        # an edge that leads to itself is part of a cycle; what leads to it meets nothing in the next round
        itself = (F.col("to_path") == F.col("path")) & (F.col("to_name") == F.col("name"))
        led = checkpointed(led.filter(F.col("_ended") | ~itself))
        ended.append(led.filter("_ended").drop("_ended"))
        open_ = led.filter(~F.col("_ended")).drop("_ended")
    return reduce(DataFrame.union, ended)


#: Texts that make a name of one file mean a declaration of another under another name or through a third file.
_HANDED_ON = r"\bexport\s*(?:type\s+)?[*{]|\bexport\s+default\b|\*\s*as\s+[\w$]+\s+from\b|from\s*['\"][^'\"\n]*\.[cm]?js['\"]"


def handed_on(sources: DataFrame, configs: DataFrame | None = None) -> bool:
    """Whether any module path or name can mean something else than what it says; one pass over paths and texts."""
    if configs is not None and not configs.isEmpty():
        return True
    index = F.col("path").rlike(r"(?:^|/)index\.ts$")
    return bool(sources.agg(F.max(index | F.col("content").rlike(_HANDED_ON)).alias("any")).first()["any"])


# --- modules of a set of sources -----------------------------------------------------------------


class Modules:
    """Module paths and exports of the sources, written down: ``targets`` and, once asked for, ``exports``.

    ``exports``: project, path, name, decl_path, decl_name of each name that a file exports and that leads to a
    declaration (or to a namespace, then ``decl_name`` is ``*``).
    """

    def __init__(self, sources: DataFrame, configs: DataFrame | None = None):
        # of imports only the module paths are kept, each once in a file
        modules = F.array_distinct(F.transform("imported", lambda i: i["module"])).alias("used")
        files = checkpointed(file_modules(sources).select("project", "path", modules, F.array_distinct("exported").alias("exported")))
        exported = files.select("project", "path", F.explode(each("exported")).alias("e")).select("project", "path", "e.*")
        used = files.select("project", "path", F.explode(each("used")).alias("module"))
        used = used.union(exported.filter("module is not null").select("project", "path", "module"))
        self.targets = checkpointed(module_targets(used, sources.select("project", "path"), configs))
        self._exported = exported

    @cached_property
    def exports(self) -> DataFrame:
        return self._exports(self._exported)

    @property
    def moved(self) -> DataFrame:
        here = (F.col("decl_path") == F.col("path")) & (F.col("decl_name") == F.col("name"))
        return self.exports.filter(~here)

    def _exports(self, exported: DataFrame) -> DataFrame:
        at_home = exported.filter("module is null").select(*KEY, F.col("path").alias("decl_path"), F.col("local").alias("decl_name"))
        linked = exported.filter("module is not null").join(self.targets.filter("target is not null"), ["project", "path", "module"])
        linked = checkpointed(linked)
        spaces = linked.filter(F.col("name").isNotNull() & (F.col("local") == NAMESPACE))
        spaces = spaces.select(*KEY, F.col("target").alias("decl_path"), F.col("local").alias("decl_name"))
        stars = linked.filter("name is null").select("project", "path", F.col("target").alias("to_path")).distinct()
        edges = linked.filter(F.col("name").isNotNull() & (F.col("local") != NAMESPACE))
        # a name exported twice would be an error; the smaller target counts
        edges = edges.groupBy(*KEY).agg(F.min(F.struct(F.col("target").alias("to_path"), F.col("local").alias("to_name"))).alias("t"))
        edges = chain_ends(edges.select(*KEY, "t.to_path", "t.to_name"))
        own = exported.filter("name is not null").select(*KEY)
        found = [checkpointed(at_home.union(spaces).distinct())]
        by_stars: list[DataFrame] = []
        last = found[0]
        while True:
            by_name = edges.join(last.select("project", F.col("path").alias("to_path"), F.col("name").alias("to_name"), "decl_path", "decl_name"), ["project", *ENDS])
            by_star = stars.join(last.filter(F.col("name") != DEFAULT).withColumnRenamed("path", "to_path"), ["project", "to_path"])
            # a file's own names come by no star: what came by stars before is all that can come again. By name, each comes once,
            # as a key has one edge
            by_star = by_star.select(*last.columns).join(own, KEY, "left_anti").distinct()
            for known in by_stars:
                by_star = by_star.join(known.filter("by_star"), last.columns, "left_anti")
            kind = lambda df, star: df.select(*last.columns, F.lit(star).alias("by_star"))
            fresh = checkpointed(kind(by_name, False).union(kind(by_star, True)))
            if fresh.isEmpty():
                break
            by_stars.append(fresh)
            last = fresh.drop("by_star")
            found.append(last)
        every = reduce(DataFrame.union, found)
        meant = F.struct("decl_path", "decl_name")
        alone = every.groupBy(*KEY).agg(F.min(meant).alias("d"), F.max(meant).alias("other")).filter("d = other")
        return checkpointed(alone.select(*KEY, "d.decl_path", "d.decl_name"))

    def follow(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``ref_path`` and ``ref_name`` led on to the declaring file; without ref_module and ref_member.

        Rows that do not refer to another module are not joined.
        """
        rows = checkpointed(rows)
        outside = F.col("ref_module").isNotNull() & F.col("ref_name").isNotNull()
        targets = self.targets.filter("target is not null").select("project", "path", F.col("module").alias("ref_module"), "target")
        located = rows.filter(outside).join(targets, ["project", "path", "ref_module"], "left")
        located = located.withColumn("ref_path", F.coalesce("target", "ref_path")).drop("target")
        plain = self._declared(located.filter("ref_member is null"))
        space = self._declared(located.filter("ref_member is not null"))
        inner = F.when(F.col("ref_name") == NAMESPACE, F.col("ref_member")).otherwise(F.concat_ws(".", "ref_name", "ref_member"))
        space = self._declared(space.withColumn("ref_name", inner))
        return reduce(DataFrame.unionByName, [rows.filter(~outside), plain, space]).drop("ref_module", "ref_member")

    def _declared(self, rows: DataFrame) -> DataFrame:
        moved = self.moved.select("project", F.col("path").alias("ref_path"), F.col("name").alias("ref_name"), "decl_path", "decl_name")
        led = rows.join(moved, ["project", "ref_path", "ref_name"], "left")
        for end in ("path", "name"):
            led = led.withColumn(f"ref_{end}", F.coalesce(f"decl_{end}", f"ref_{end}"))
        return led.drop("decl_path", "decl_name")


def exports(sources: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Each exported name with the file and name it is declared by."""
    return Modules(sources, configs).exports
