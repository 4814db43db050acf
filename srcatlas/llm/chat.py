"""Chat formatting of conversations whose turns hold typed content parts.

A part is ``struct<kind, text, ref, size>``. A visitor turns each part into text: ``text`` parts are escaped; ``image``,
``audio`` and ``document`` parts become a placeholder ``<|kind_N|>``, numbered through the conversation, and are recorded as
attachments with their reference, position and the tokens that they expand to (``EXPANDS``: so many units of ``size`` make a
token, at least one). Parts of other kinds are refused.

A turn is ``<|im_start|>role``, a new line, the parts, ``<|im_end|>`` and a new line. A text cannot hold a control string:
in every ``<`` followed by backslashes and ``|`` one more backslash is put before the ``|``; to read, one is taken away. Roles
have ``%``, ``<`` and new lines as ``%25``, ``%3C`` and ``%0A``.

The loss mask has the spans of the text parts of assistant turns, in code points.

Defined results: rows are turns, ordered by ``turn`` (nulls first), then role and text, so equal rows are turns of their own;
null roles and texts are empty; a null ``conv_id`` is one conversation. A conversation is one value of the result, so one
that is large is made by one task; its work is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Units of ``size`` for each token: pixels, milliseconds, characters.
EXPANDS = {"image": 784, "audio": 40, "document": 4}
PART = "struct<kind:string,text:string,ref:string,size:long>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def role_escaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A turn's text as its only part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))


def _is_attached(part: Column) -> Column:
    return part["kind"] != "text"


def _visited(part: Column, before: Column) -> Column:
    """A part as text; ``before``: the attachments before it."""
    name = F.concat(F.lit("<|"), part["kind"], F.lit("_"), before.cast("string"), F.lit("|>"))
    refused = F.raise_error(F.concat(F.lit("no such kind of content part: "), F.coalesce(part["kind"], F.lit("null"))))
    return (
        F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit(""))))
        .when(part["kind"].isin(*EXPANDS), name)
        .otherwise(refused.cast("string"))
    )


def _tokens(part: Column) -> Column:
    units = F.create_map(*(F.lit(x) for pair in EXPANDS.items() for x in pair))
    return F.greatest(F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / units[part["kind"]])).cast("long")


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss, attachments`` of ``(conv_id, turn, role, parts)``.

    ``loss`` has ``turn`` (its number from 0), ``start`` and ``end`` in the conversation and ``turn_start``; ``attachments``
    has ``number, kind, ref, turn, start, tokens``.
    """
    parts = F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    attached = F.size(F.filter("parts", _is_attached))
    rows = rows.select("*", F.row_number().over(order).alias("k"), F.coalesce(F.sum(attached).over(before), F.lit(0)).alias("n_before"))
    # attachments before a part: those of the turns before, and those of the parts before
    numbered = F.transform(
        "parts", lambda p, i: _visited(p, F.col("n_before") + F.size(F.filter(F.slice("parts", F.lit(1), i), _is_attached)))
    )
    rows = rows.select("conv_id", "turn", "k", "role", "parts", numbered.alias("texts"))
    head = F.concat(F.lit(OPEN), role_escaped(F.col("role")), F.lit("\n"))
    rows = rows.select("*", head.alias("head"), F.array_join("texts", "").alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    begin = F.coalesce(F.sum(F.length("piece").cast("long")).over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("turn_start", begin)
    # where each part begins in its turn
    placed = F.transform(
        "texts",
        lambda t, i: F.struct(
            (F.col("turn_start") + F.length("head") + F.length(F.array_join(F.slice("texts", F.lit(1), i), ""))).alias("start"),
            F.length(t).alias("size"),
            F.get("parts", i).alias("part"),
        ),
    )
    rows = rows.withColumn("placed", placed)
    learned = F.when(F.col("role") == LEARNED, F.filter("placed", lambda x: (x["part"]["kind"] == "text") & (x["size"] > 0)))
    loss = F.transform(
        F.coalesce(learned, F.filter("placed", lambda x: F.lit(False))),
        lambda x: F.struct(
            (F.col("k") - 1).alias("turn"), x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), F.col("turn_start").alias("turn_start")
        ),
    )
    found = F.transform(
        F.filter("placed", lambda x: _is_attached(x["part"])),
        lambda x: F.struct(
            (F.col("k") - 1).alias("turn"),
            x["start"].alias("start"),
            x["part"]["kind"].alias("kind"),
            x["part"]["ref"].alias("ref"),
            _tokens(x["part"]).alias("tokens"),
        ),
    )
    each = F.struct("k", "piece", loss.alias("loss"), found.alias("attachments"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    return whole.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all")["piece"], "").alias("formatted"),
        F.flatten(F.col("all")["loss"]).alias("loss"),
        F.flatten(F.col("all")["attachments"]).alias("attachments"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (``role, text``, placeholders as they are) and ``loss_text``, read from ``formatted`` alone
    and the loss mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.col("n_turns").cast("int"))
    rows = chats.withColumn("pieces", pieces)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        size = F.length(piece) - F.length(role) - 1 - len(CLOSE)
        body = F.substring(piece, F.length(role) + 2, size)
        return F.struct(role_unescaped(role).alias("role"), unescaped(body).alias("text"))

    turns = F.transform("pieces", turn)
    masked = F.transform(
        "loss",
        lambda x: unescaped(
            F.substring(
                F.get("pieces", x["turn"]), (x["start"] - x["turn_start"] - len(OPEN) + 1).cast("int"), (x["end"] - x["start"]).cast("int")
            )
        ),
    )
    return rows.select(*chats.columns, turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
