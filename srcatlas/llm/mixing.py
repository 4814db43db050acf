"""Mixing of sources by temperature, to a target entropy or a limit of repetitions.

A source with the share ``p`` of all tokens gets a weight in proportion to ``p ** alpha``. The exponent lies between 0 (all
alike) and 1 (as they are). It is bisected until the entropy of the weights is ``entropy`` times that of equal weights, and
until no source is repeated more than ``repeats`` times; the larger exponent holds, so that the limit of repetitions comes
first. Every step of the bisection is an aggregate over the sources, with ``POINTS`` exponents tried at once.

The budget is the smallest one at which no source loses a document: the largest source in relation to its weight is used
exactly once, a source ``(p_max / p) ** (1 - alpha)`` times. A source's tokens are dealt in blocks. Each block is a
permutation of the source's documents by a hash of block and ``doc_id``; the last block is cut where the budget ends, so
that a source never exceeds its budget. Because a cut is a value of the hash, a document's draws follow from its
source's row alone, and no text is moved.

Tokens are words, ``[^\\x20\\x09-\\x0D]+``. Defined results: a null source is a source of its own, a null text has no tokens.
Documents without tokens are in every whole block; sources without any token are used once. Rows of one ``doc_id`` are drawn
alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored

ENTROPY = 0.98
REPEATS = 2.0
SEED = "mix-1"
POINTS = 16
ROUNDS = 10
#: Documents of a stretch of the hash that is summed up by one task, about.
STRETCH_ROWS = 4_000


def n_tokens(text: Column) -> Column:
    """The number of words of a text."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def order_hash(block: Column) -> Column:
    """The place of a document in a block's permutation."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(SEED), block.cast("string"), name).cast("binary"))


def _bisect(sources: DataFrame, holds) -> float:
    """The smallest exponent for which ``holds``, a falling condition of exponents, is true; 1 if there is none."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
        # one row comes back
        row = sources.agg(*(holds(a).alias(f"p{k}") for k, a in enumerate(points))).first()
        found = next((k for k in range(POINTS + 1) if row[f"p{k}"]), POINTS)
        if found == 0:
            return points[0]
        low, high = points[found - 1], points[found]
    return high


def exponent(sources: DataFrame, entropy: float, repeats: float) -> float:
    """From ``sources`` with their shares ``p``, rounded to nine places."""
    p = F.col("p")

    def flat_enough(a: float) -> Column:
        total = F.sum(F.pow(p, F.lit(a)))
        spread = F.log(total) - a * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / total
        return spread <= entropy * F.log(F.count(p)) + 1e-12

    def rare_enough(a: float) -> Column:
        return F.pow(F.max(p) / F.min(p), F.lit(1 - a)) <= repeats + 1e-12

    return round(max(_bisect(sources, flat_enough), _bisect(sources, rare_enough)), 9)


def plan(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """``source, weight, blocks, cut`` from ``(doc_id, source, n_tokens)``: whole blocks, and the last hash of the cut one."""
    by_source = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    whole = by_source.agg(F.sum("tokens").alias("t"), F.max("docs").alias("d")).first()
    used = by_source.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(whole["t"] or 1)))
    alpha = exponent(used, entropy, repeats)
    total = used.agg(F.sum(F.pow("p", F.lit(alpha))).alias("w"), F.max("p").alias("p")).first()
    p = F.col("p")
    epochs = F.pow(F.lit(total["p"]) / p, F.lit(1 - alpha))
    budget = F.floor(F.col("tokens") * epochs + 0.5)
    shares = used.select(
        "source",
        F.round(F.pow(p, F.lit(alpha)) / F.lit(total["w"]), 9).alias("weight"),
        F.floor(budget / F.col("tokens")).alias("blocks"),
        F.pmod(budget, F.col("tokens")).alias("rest"),
        epochs.alias("epochs"),
    )
    shares = stored(shares, "shares")
    # running sums of the cut block: inside stretches of the hash, on top of what the stretches before hold
    n = max(1, -(-(whole["d"] or 1) // STRETCH_ROWS))
    named = rows.join(shares.select(F.col("source").alias("s"), "blocks", "rest"), F.col("source").eqNullSafe(F.col("s")))
    marked = named.filter("rest > 0").withColumn("h", order_hash(F.col("blocks")))
    stretch = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32))
    each = marked.groupBy("source", "rest", stretch.alias("stretch"), "h").agg(F.sum("n_tokens").alias("t"))
    each = stored(each, "stretches")
    sums = each.groupBy("source", "stretch").agg(F.sum("t").alias("t"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select(F.col("source").alias("s"), F.col("stretch").alias("k"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start")), "sums")
    inside = Window.partitionBy("source", "stretch").orderBy("h")
    run = each.withColumn("sum", F.sum("t").over(inside))
    run = run.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("k")))
    cuts = run.filter(F.col("start") + F.col("sum") <= F.col("rest")).groupBy("source").agg(F.max("h").alias("cut"))
    cuts = cuts.select(F.col("source").alias("s"), "cut")
    return stored(
        by_source.select("source")
        .join(shares.select(F.col("source").alias("s1"), "weight", "blocks", "epochs"), F.col("source").eqNullSafe(F.col("s1")), "left")
        .join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(
            "source",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("blocks", F.lit(1)).alias("blocks"),
            F.coalesce("epochs", F.lit(1.0)).alias("epochs"),
            F.coalesce("cut", F.lit("")).alias("cut"),
        ),
        "plan",
    )


def _draws(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` with the plan's row of their source as ``_m``, and an array of the blocks they are in as ``_blocks``."""
    held = plan_.select(F.struct("*").alias("_m"))
    joined = rows.join(held, F.col("source").eqNullSafe(F.col("_m.source")))
    blocks = F.col("_m.blocks").cast("int")
    last = F.when(order_hash(blocks) <= F.col("_m.cut"), blocks).otherwise(blocks - 1)
    return joined.withColumn("_blocks", F.when(last >= 0, F.sequence(F.lit(0), last)))


def mixed(documents: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """A row for each draw: ``doc_id, source, n_tokens, weight, block, place``. In the order of ``place``, from 0 to 1,
    every stretch of the mixture has the sources in their weights."""
    rows = documents.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    rows = stored(rows, "tokens")
    drawn = _draws(rows, plan(rows, entropy, repeats)).withColumn("block", F.explode("_blocks"))
    share = F.conv(F.substring(order_hash(F.col("block")), 1, 8), 16, 10).cast("long") / F.lit(1 << 32)
    place = F.round((F.col("block") + share) / F.col("_m.epochs"), 6)
    return drawn.select("doc_id", "source", "n_tokens", F.col("_m.weight").alias("weight"), "block", place.alias("place"))


def draw(documents: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """``documents``, each row as often as the mixture draws it."""
    rows = documents.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    # struct fields: a column of the input may have any name
    whole = documents.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"))
    drawn = _draws(whole, plan(stored(rows, "tokens"), entropy, repeats)).withColumn("_block", F.explode("_blocks"))
    return drawn.select(*(F.col(f"_row.`{c}`").alias(c) for c in documents.columns))
