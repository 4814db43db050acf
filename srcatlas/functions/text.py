"""Small text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas.functions.patterns import METHOD_DOCS


def trim_ws(c: Column) -> Column:
    """Strip blanks, tabs and line ends on both sides (``trim`` strips spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "").cast("string")


def normalize_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def slash_path(c: Column) -> Column:
    """Forward slashes and one leading slash: the form shown in catalogues."""
    return F.concat(F.lit("/"), F.replace(c, F.lit("\\"), F.lit("/")))


def base_name(c: Column) -> Column:
    """Last part of a path; a trailing slash does not count."""
    parts = F.split(F.regexp_replace(c, r"/+$", ""), "/")
    return F.element_at(parts, -1)


def unquote(c: Column) -> Column:
    return F.translate(c, "'\"", "")


def io_docs(params: Column, return_type: Column) -> Column:
    """The two-line docs text of methods and routes."""
    before, between = METHOD_DOCS
    return F.concat(F.lit(before), params, F.lit(between), return_type)
