"""Declarations read off the lines of a source text, as it stands.

Nothing here knows about nesting: a text is cut at line ends, parentheses or colons, and each
piece is looked at by itself.  The cost is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.outline import let
from srcatlas.functions.text import trim_ws

_BLANK = " \t\f\r"
_CUT = "\u0002"
_VERB = "|".join(P.HTTP_DECORATORS)


def _only(words: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(words, F.array(*map(F.lit, allowed)))) == 0


def class_names(text: Column) -> Column:
    """Names of classes declared at the start of a line, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("class")))

    def name(line: Column) -> Column:
        def read(words: Column) -> Column:
            at = F.array_position(words, "class").cast("int")
            declared = (at > 0) & _only(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0))), P.CLASS_WORDS)
            return F.when(declared, F.regexp_extract(F.get(words, at), r"^\w+", 0))

        return let(F.split(trim_ws(line), r"\s+"), read)

    return F.filter(F.transform(lines, name), lambda n: n != "")


def class_sections(text: Column) -> Column:
    """The text from each line-start class declaration up to the next one."""
    words = "|".join(P.CLASS_WORDS)
    start = rf"(?m)^(?=[{_BLANK}]*+(?:(?:{words})[{_BLANK}]++)*+class[{_BLANK}]++\w)"
    pieces = F.split(F.regexp_replace(text, start, _CUT), _CUT, -1)
    return let(pieces, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))


def _signatures(text: Column, at_line_start: bool) -> Column:
    """array(struct(name, params, return_type)) of names with a parameter list and a return annotation.

    A parameter list ends at its first closing parenthesis, so one that holds parentheses is none; the return
    type ends at the end of its line or before an opening brace.
    """

    def read(pieces: Column) -> Column:
        def one(head: Column, i: Column) -> Column:
            line = F.substring_index(head, "\n", -1)
            name = F.regexp_extract(head, r"(\w+)\s*$", 1)
            tail = F.get(pieces, i + 1)
            params = F.substring_index(tail, ")", 1)
            after = F.regexp_extract(F.substring(tail, F.length(params) + 2, F.length(tail)), r"^\s*+:\s*+([^{\n]++)", 1)
            closed = F.contains(tail, F.lit(")"))
            if at_line_start:
                words = F.filter(F.split(F.regexp_extract(line, r"^(.*?)\w+\s*$", 1), rf"[{_BLANK}]+"), lambda w: w != "")
                fits = line.rlike(r"\w\s*$") & _only(words, P.METHOD_WORDS)
            else:
                fits = name != ""
            made = F.struct(name.alias("name"), params.alias("params"), trim_ws(after).alias("return_type"))
            return F.when(fits & closed & (after != ""), made)

        heads = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.filter(F.transform(heads, one), lambda x: x.isNotNull())

    return let(F.split(text, r"\("), read)


def methods(text: Column) -> Column:
    """Methods with a return annotation, declared at the start of a line."""
    return _signatures(text, at_line_start=True)


def routes(text: Column, search: str) -> Column:
    """array(struct(verb, route, name, params, return_type)) of verb decorators with a quoted path, each with the next
    signature: the next one before another verb decorator (``nearest``), or the next one at all (``lazy``)."""
    pieces = F.filter(F.split(text, rf"(?=@(?:{_VERB})\()", -1), lambda p: p.rlike(rf"^@(?:{_VERB})\("))

    def part(piece: Column) -> Column:
        verb = F.regexp_extract(piece, r"^@(\w+)", 1)
        path = F.regexp_extract(piece, r"^@\w+\(['\"]([^'\"]++)['\"]\)", 1)
        found = F.get(_signatures(F.substring(piece, F.length(verb) + 3, F.length(piece)), at_line_start=False), F.lit(0))
        return F.struct(verb.alias("verb"), path.alias("route"), found.alias("found"))

    parts = F.transform(pieces, part)
    if search == "nearest":
        own = F.filter(parts, lambda p: (p["route"] != "") & p["found"].isNotNull())
        return F.transform(own, lambda p: F.struct(p["verb"], p["route"], p["found"].alias("found")))
    state = "struct<verb:string,route:string,out:array<struct<verb:string,route:string,found:struct<name:string,params:string,return_type:string>>>>"
    start = F.expr(f"cast(named_struct('verb', null, 'route', null, 'out', array()) as {state})")

    def step(acc: Column, p: Column) -> Column:
        fresh = acc["route"].isNull() & (p["route"] != "")
        verb = F.when(fresh, p["verb"]).otherwise(acc["verb"])
        route = F.when(fresh, p["route"]).otherwise(acc["route"])
        taken = route.isNotNull() & p["found"].isNotNull()
        made = F.array(F.struct(verb.alias("verb"), route.alias("route"), p["found"].alias("found")))
        return F.struct(
            F.when(~taken, verb).alias("verb"),
            F.when(~taken, route).alias("route"),
            F.when(taken, F.concat(acc["out"], made)).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def statements(text: Column) -> Column:
    """Decorated statements as one line each.

    A statement starts at a line that begins with ``@`` and closes with the first line that holds a semicolon;
    its lines are trimmed and joined with blanks.  Without a semicolon there is no statement.
    """
    # every part but the last ends with the one line of it that holds a semicolon
    parts = F.split(F.regexp_replace(text, r"(;[^\n]*+)\n", rf"$1{_CUT}"), _CUT, -1)
    started = F.transform(parts, lambda s: F.regexp_extract(s, rf"(?m)^[{_BLANK}]*+(@[\s\S]*+)", 1))
    closed = F.filter(started, lambda s: F.contains(s, F.lit(";")))
    return F.transform(
        closed,
        lambda s: F.concat(
            F.regexp_replace(F.regexp_replace(s, rf"[{_BLANK}]*\n[{_BLANK}]*", " "), r"\s+$", ""), F.lit(" ")
        ),
    )


def property_of(statement: Column) -> Column:
    """struct(prefix, name, type) of a one-line statement: the first word with a colon behind it, what stands in front of
    it, and what follows up to the semicolon.  NULL if there is none."""

    def read(parts: Column) -> Column:
        ends = F.transform(parts, lambda p, i: F.when(p.rlike(r"\w\s*$"), i))
        at = F.get(F.filter(ends, lambda i: i.isNotNull()), F.lit(0))
        head = F.array_join(F.slice(parts, F.lit(1), at + 1), ":")
        rest = F.array_join(F.slice(parts, at + 2, F.size(parts)), ":")
        name = F.regexp_extract(head, r"(\w+)\s*$", 1)
        type_ = F.substring_index(rest, ";", 1)
        fits = head.rlike(r"^@\w") & F.contains(rest, F.lit(";")) & (trim_ws(type_) != "")
        made = F.struct(F.regexp_extract(head, r"^(.*?)\w+\s*$", 1).alias("prefix"), name.alias("name"), trim_ws(type_).alias("type"))
        return F.when(at.isNotNull() & fits, made)

    return let(F.split(statement, ":", -1), read)


def arrow_target(statement: Column) -> Column:
    """The name behind the first arrow without parameters that opens an argument list; '' if there is none."""
    dense = F.regexp_replace(statement, r"\s+", "")
    opened = F.instr(dense, "(()=>")
    return F.when(opened > 0, F.regexp_extract(F.substring(dense, opened + 5, F.length(dense)), r"^\w+", 0)).otherwise("")
