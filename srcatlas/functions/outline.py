"""Bracket-aware view of one source text, built inside its row.

``with_outline(df)`` removes comments, sets string literals aside and then folds
bracket groups from the inside out.  Every group is replaced with a token such as
``«b12»`` and kept in an array, so what is left at each level holds no nested
structure and simple patterns can read it at any nesting depth:

    export class P «b9»            top level
    {                              block 9
      @Get«p3»
      one«p4»: Promise«a5» «b8»
    }

Token letters: ``b`` braces, ``p`` parentheses, ``a`` angle brackets, ``s`` square
brackets that hold a comma.  String literals become ``‹n›`` (the n-th of
``pieces``, odd ones) and ``=>`` becomes ``⇒`` so that it does not close an angle bracket.

One text is folded by plain Python (``folding``), in Arrow batches; all that reads the outline is Column expressions on
the row. The work is linear in the text times its nesting depth, nothing is exploded and nothing is shuffled.

Steps are columns of their own rather than one nested expression: the optimizer
normalizes a higher-order function together with everything below it, at a cost
that doubles with every level of nesting.  For the same reason texts are unfolded
many at a time (``unfold_fields``), not inside further lambdas.

String, template and regular-expression literals are told apart from code and comments
in one left-to-right scan; templates may nest ``folding.TEMPLATE_DEPTH`` deep.  A text whose brackets
still do not close (``whole`` is false) is read line by line instead, and listed by
``operators.entities.rejects``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from srcatlas.functions.folding import ESCAPES, outline
from srcatlas.functions.shipping import ship
from srcatlas.functions.storage import stored

_OUTLINE = (
    StructType()
    .add("top", StringType())
    .add("blocks", ArrayType(StringType()))
    .add("pieces", ArrayType(StringType()))
    .add("whole", BooleanType())
)
_ARROW = pa.struct(
    [("top", pa.string()), ("blocks", pa.list_(pa.string())), ("pieces", pa.list_(pa.string())), ("whole", pa.bool_())]
)
_SEPARATOR = "\u0003"  # between texts that are unfolded together

#: Tokens, slots and signs that unfolding puts back; a text without any of them is as it was written.
_HELD = "[«‹⇒" + "".join(private for _, private in ESCAPES) + "]"
#: Unfolding passes that are tried before the state is looked at again.
_GROUPED = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Lambda bodies are interpreted without common-subexpression elimination, so a
    costly expression used twice would run twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# a type, not its text: workers import this module too, and have no session that could read the text
@F.arrow_udf(_OUTLINE)
def _outline(texts: pa.Array) -> pa.Array:
    made = (outline(t.decode("utf-8", "replace")) if t is not None else {} for t in texts.cast(pa.binary()).to_pylist())
    return pa.array(made, _ARROW)


def with_outline(df: DataFrame, text: str = "content", name: str = "o") -> DataFrame:
    """Replace a text column with its outline, struct(top, blocks, pieces, whole).

    ``whole``: every bracket has been folded.  Rows that bring an outline along keep it.
    """
    kept = [c for c in df.columns if c != text]
    if name in kept:
        return df.select(*kept)
    ship(df.sparkSession)
    return df.select(*kept, _outline(text).alias(name))


def narrow(sources: DataFrame) -> DataFrame:
    """What extraction reads of a sources table, the outline included if it is there."""
    return sources.select("project", "path", "content", *(["o"] if "o" in sources.columns else []))


def stored_outline(sources: DataFrame) -> DataFrame:
    """``sources`` with their outline ``o``, folded once and written down: for plans that read it many times."""
    copied = narrow(sources).withColumn("_folded_text", F.col("content"))
    return stored(with_outline(copied, "_folded_text"), "outline")


def block(o: Column, token_id: Column) -> Column:
    """Content of a folded group with its brackets, inner groups still folded."""
    return F.get(o["blocks"], token_id.try_cast("int"))


def body(o: Column, token_id: Column) -> Column:
    """Content of a folded group without its brackets."""
    return F.regexp_replace(block(o, token_id), r"^.|.$", "")


def argument(o: Column, token_id: Column) -> Column:
    """First of the comma-separated parts of a group, folded; NULL if no such group."""
    first = F.regexp_extract(body(o, token_id), r"^\s*([^,]*)", 1)
    return F.regexp_replace(first, r"\s+$", "")


def literal(o: Column, slot: Column) -> Column:
    """String literal of a slot, with its quotes."""
    return F.get(o["pieces"], slot.try_cast("int") * 2 + 1)


def _put_back(t: Column, opener: str, closer: str, letters: int, look_up) -> Column:
    # every piece after the first starts with a token's letter and number
    def fill(piece: Column, i: Column) -> Column:
        end = F.instr(piece, closer)
        token_id = F.substring(piece, F.lit(letters + 1), end - letters - 1)
        return F.when(i == 0, piece).otherwise(
            F.coalesce(
                F.concat(
                    look_up(token_id),
                    F.substring(piece, end + 1, F.length(piece)),
                ),
                F.concat(F.lit(opener), piece),
            )
        )

    return F.array_join(F.transform(F.split(t, opener, -1), fill), "")


def unfold(o: Column, text: Column) -> Column:
    """Text with all tokens and literal slots put back as they were written."""

    def one_pass(acc: Column, _: Column) -> Column:
        opened = _put_back(acc, "«", "»", 1, lambda i: block(o, i))
        return F.when(F.contains(acc, F.lit("«")), opened).otherwise(acc).cast("string")

    # inner groups have lower numbers, so every pass lowers the highest one left; whether one is left is looked at
    # once for each group of passes
    group = F.sequence(F.lit(1), F.lit(_GROUPED))

    def passes(acc: Column, _: Column) -> Column:
        more = F.aggregate(group, acc, one_pass)
        return F.when(F.contains(acc, F.lit("«")), more).otherwise(acc).cast("string")

    plain = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(o["blocks"]) / _GROUPED)), text, passes)
    code = _put_back(plain, "‹", "›", 0, lambda i: literal(o, i))
    out = F.replace(code, F.lit("⇒"), F.lit("=>"))
    for plain_sign, private in ESCAPES:
        out = F.replace(out, F.lit(private), F.lit(plain_sign))
    return F.when(text.rlike(_HELD), out).otherwise(text).cast("string")


def unfold_array(o: Column, texts: Column) -> Column:
    """Unfold all texts of an array in one go (NULL elements count as '')."""
    joined = F.array_join(texts, _SEPARATOR, "")
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(
        F.split(unfold(o, joined), _SEPARATOR, -1)
    )


def unfold_fields(df: DataFrame, column: str, *fields: str, o: str = "o") -> DataFrame:
    """Unfold the given string fields of an array-of-structs column."""

    def written(field: str) -> Column:
        return F.transform(column, lambda x: F.coalesce(x[field], F.lit("")))

    def put(field: str, texts: Column) -> Column:
        # zipped, not looked up in a lambda: the texts are made once per row
        return F.zip_with(column, texts, lambda x, t: x.withField(field, t))

    # the texts of all fields are unfolded together, each field's behind those of the one before
    df = df.withColumn("_texts", F.concat(*map(written, fields))).withColumn("_texts", unfold_array(F.col(o), F.col("_texts")))
    n = F.size(column)
    for k, field in enumerate(fields):
        own = F.slice("_texts", n * k + 1, n) if len(fields) > 1 else F.col("_texts")
        df = df.withColumn(column, put(field, own))
    return df.drop("_texts")
