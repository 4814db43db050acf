"""Rules on the text of a type: what kind it is and which type it boils down to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.outline import argument, body, unfold, with_outline
from srcatlas.functions.text import trim_ws

_LITERAL = r"^(?:‹\d+›|-?\d[\w.]*|true|false)$"
_LITERAL_TEXT = r"^(?:'[^']*'|\"[^\"]*\"|`[^`]*`|-?\d[\w.]*|true|false)$"
_NAME = r"^[A-Za-z_$][\w$]*(?:\.[\w$]+)*$"
_GENERIC = r"^[\w.]+«a(\d+)»$"
_ARRAY = r"^Array«a(\d+)»$"
_GENERIC_NAME = r"^([\w.]+)«a\d+»$"
_UNWRAPPED = "struct<base:string,is_array:boolean,generic:string>"


def kind_of_base(t: Column) -> Column:
    """Kind of a type that is no union, array or generic any more."""
    return (
        F.when(t.rlike(_LITERAL_TEXT), "literal")
        .when(t == "Date", "date")
        .when(t.isin(P.OPAQUE_TYPES), "opaque")
        .when(
            t.isin(P.SCALAR_TYPES) | t.contains("Express.") | t.startswith('import("node:'),
            "scalar",
        )
        .when(t.startswith("{"), "inline")
        .when(t.rlike(_NAME), "ref")
        .otherwise("other")
    )


def classify_types(df: DataFrame, text: str) -> DataFrame:
    """Add ``type_kind``: union, array, generic or a kind of ``kind_of_base``."""
    t = trim_ws(F.col(text))
    top = F.col("_t.top")
    kind = (
        F.when(top.contains("|"), "union")
        .when(top.endswith("[]") | top.rlike(_ARRAY), "array")
        .when(top.rlike(_GENERIC), "generic")
        .otherwise(kind_of_base(t))
    )
    return (
        with_outline(df.withColumn("_text", t), "_text", "_t")
        .withColumn("type_kind", kind)
        .drop("_t")
    )


def _has_symbol(member: Column) -> Column:
    """Whether a union member names something that can be looked up."""
    plain = member.isin(P.SCALAR_TYPES + P.OPAQUE_TYPES) | member.rlike(_LITERAL)
    return member.rlike(r"^[A-Za-z_$«]") & ~plain


def unwrap_types(df: DataFrame, text: str, generic: str | None = None) -> DataFrame:
    """Add ``base`` and ``is_array``: the type that is left to look up.

    ``generic`` names a column for the outermost generic type whose first argument was taken, NULL if none was.

    A union stands for its first member with a symbol ('' if there is none), an array
    for its element, a generic for its first argument; repeated until nothing is left
    to unwrap.  Every step removes a bracket pair, a bar or a keyword, so the number
    of those in the text bounds the steps.
    """
    o = F.col("_t")

    def step(acc: Column, _: Column) -> Column:
        t = acc["base"]

        def to(base: Column, is_array: Column = acc["is_array"], outer: Column = acc["generic"]) -> Column:
            return F.struct(base.alias("base"), is_array.alias("is_array"), outer.alias("generic"))

        members = F.transform(F.split(t, r"\|"), trim_ws)
        member = F.coalesce(F.get(F.filter(members, _has_symbol), F.lit(0)), F.lit(""))
        array = F.lit(True)
        return (
            F.when(t.contains("|"), to(member))
            .when(t.rlike(r"^«p\d+»$"), to(trim_ws(body(o, F.regexp_extract(t, r"\d+", 0)))))
            .when(t.startswith("readonly "), to(trim_ws(F.replace(t, F.lit("readonly "), F.lit("")))))
            .when(t.endswith("[]"), to(trim_ws(F.regexp_replace(t, r"\[\]$", "")), array))
            .when(t.rlike(_ARRAY), to(argument(o, F.regexp_extract(t, _ARRAY, 1)), array))
            .when(
                t.rlike(_GENERIC),
                to(
                    argument(o, F.regexp_extract(t, _GENERIC, 1)),
                    outer=F.coalesce(acc["generic"], F.regexp_extract(t, _GENERIC_NAME, 1)),
                ),
            )
            .otherwise(acc)
            .cast(_UNWRAPPED)
        )

    trimmed = df.withColumn("_text", trim_ws(F.col(text)))
    passes = F.sequence(F.lit(0), F.regexp_count(F.col(text), F.lit(r"[|(<\[]|readonly ")))
    none = F.lit(None).cast("string")
    start = F.struct(o["top"].alias("base"), F.lit(False).alias("is_array"), none.alias("generic"))
    made = (
        with_outline(trimmed, "_text", "_t")
        .withColumn("_u", F.aggregate(passes, start.cast(_UNWRAPPED), step))
        .withColumn("base", trim_ws(unfold(o, F.col("_u.base"))))
        .withColumn("is_array", F.col("_u.is_array"))
    )
    return (made.withColumn(generic, F.col("_u.generic")) if generic else made).drop("_t", "_u")


def type_arguments(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the first type argument of a type, or the type itself.

    ``Promise<T>`` gives ``T``, ``T[]`` gives ``T``.
    """
    o, t = F.col("_t"), trim_ws(F.col(text))
    top = F.col("_t.top")
    picked = (
        F.when(top.rlike(_GENERIC), argument(o, F.regexp_extract(top, _GENERIC, 1)))
        .when(
            top.endswith("[]") & ~top.contains("|"), F.regexp_replace(top, r"\[\]$", "")
        )
        .otherwise(top)
    )
    return (
        with_outline(df.withColumn("_text", t), "_text", "_t")
        .withColumn(name, unfold(o, picked))
        .drop("_t")
    )
