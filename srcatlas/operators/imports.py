"""Imports of a file, and the paths that they point to as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.outline import body, literal, narrow, with_outline
from srcatlas.functions.rows import each

_IMPORT = (
    r"\bimport\b\s*(?:type\s+(?!from\b))?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?"
    r"(?:\*\s*as\s+([\w$]+)\s*|«b(\d+)»\s*)?\bfrom\s*‹(\d+)›"
)
#: What default and namespace imports are called; no declaration can have these names.
DEFAULT, NAMESPACE = "default", "*"
_IMPORTED = r"^\s*(?:type\s+)?(\w+)(?:\s+as\s+(\w+))?\s*$"

# What may be a module path in a text that is not folded: a quoted text, up to the same quote. Only the quote is consumed.
_QUOTED_PATH = r"(['\"`])(?=((?:\.|src/)(?:(?!\1)[^\n])*+))"
#: Bits that tell which files are imported.
_BITS = 1 << 26


def walked(path: Column) -> Column:
    """The path without empty, ``.`` and ``..`` parts."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(parts, "/")


def beside(importer: Column, module: Column) -> Column:
    """A relative module path, seen from the folder of the importing file."""
    return walked(F.concat(F.regexp_replace(importer, r"[^/]*$", ""), module))


def module_path(importer: Column, module: Column) -> Column:
    """File a module path names, seen from the importing file; NULL for packages."""
    target = F.when(module.startswith("."), beside(importer, module)).otherwise(walked(module))
    with_suffix = F.when(target.endswith(".ts"), target).otherwise(
        F.concat(target, F.lit(".ts"))
    )
    return F.when(module.startswith(".") | module.startswith("src/"), with_suffix)


def module_text(o: Column, slot: Column) -> Column:
    return F.translate(literal(o, slot), "'\"`", "")


def files_met(sources: DataFrame) -> DataFrame:
    """The sources that hold a controller or that a file may import by their path; more files, never fewer.

    Module paths are found in texts that are not folded yet. The files that they mean set bits of one field, of a size that does
    not depend on the data (8 MB at most), which is broadcast: file contents stay where they are.
    """
    content = F.col("content")
    quoted = F.regexp_extract_all("content", F.lit(_QUOTED_PATH), F.lit(2))
    used = sources.filter(content.contains("import")).select("project", "path", F.explode(each(F.array_distinct(quoted))).alias("module"))
    target = module_path(F.col("path"), F.translate("module", "'\"`", ""))
    place = lambda path: F.pmod(F.xxhash64("project", path), F.lit(_BITS)) + 1
    bits = (
        used.select(place(target).alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    )
    marked = sources.withColumn("_place", place(F.col("path"))).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    rows = marked.join(F.broadcast(bits), "_bucket", "left")
    return rows.filter(content.contains("@Controller") | met).select(*sources.columns)


def _file_imports(o: Column) -> Column:
    """array(struct(name, local, module)) of the imports of a file: in each statement the default one, then the
    namespace, then those by name."""

    def of_statement(m: Column) -> Column:
        whole, space = (F.regexp_extract(m, _IMPORT, g) for g in (1, 2))
        names = F.split(body(o, F.regexp_extract(m, _IMPORT, 3)), ",")
        module = module_text(o, F.regexp_extract(m, _IMPORT, 4))

        def made(name: Column, local: Column) -> Column:
            return F.struct(name.alias("name"), local.alias("local"), module.alias("module"))

        def one_name(n: Column) -> Column:
            name, alias = (F.regexp_extract(n, _IMPORTED, g) for g in (1, 2))
            return made(name, F.when(alias == "", name).otherwise(alias))

        first = F.filter(F.array(made(F.lit(DEFAULT), whole), made(F.lit(NAMESPACE), space)), lambda i: i["local"] != "")
        named = F.transform(F.filter(names, lambda n: n.rlike(_IMPORTED)), one_name)
        return F.concat(first, F.coalesce(named, F.filter(first, lambda _: F.lit(False))))

    found = F.regexp_extract_all(o["top"], F.lit(_IMPORT), F.lit(0))
    return F.flatten(F.transform(found, of_statement))


def with_imports(rows: DataFrame) -> DataFrame:
    """Add ``imported``: array(struct(name, local, module, target))."""
    targets = F.transform(
        "_named",
        lambda i: i.withField("target", module_path(F.col("path"), i["module"])),
    )
    return (
        rows.withColumn("_named", _file_imports(F.col("o")))
        .withColumn("imported", targets)
        .drop("_named")
    )


def imports(sources: DataFrame) -> DataFrame:
    """One row for each imported name; ``name`` is ``default`` or ``*`` where no name is."""
    marked = sources.filter(F.col("content").contains("import"))
    rows = with_imports(with_outline(narrow(marked)))
    return rows.select("project", "path", F.posexplode(each("imported")).alias("pos", "i")).select(
        "project", "path", "pos", "i.*"
    )
