"""Type trees in their shared form: each type once, however many paths lead to it.

Types that reach each other are one component. Between components there are no cycles, so the number of paths from
the roots into each is a sum along the edges, level by level. The result has a row for each field of each
reached type, where ``type_closure`` has one for each path.

Components come from forward and backward colouring (Fleischer, Hendrickson, Pinar 2000; Orzan 2004): types that nothing
refers to, or that refer to nothing, are taken off first; every other type takes the least mark of those that
reach it, and the types of one mark that reach the type the mark belongs to are a component. Marks are hashes, so
that their order has nothing to do with that of the types. No row grows with a component or a project.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import checkpointed
from srcatlas.operators.closure import OBJECT_KINDS, Types

NODE = ["project", "path", "name"]


def _named(path: str, name: str) -> Column:
    return F.struct(F.col(path).alias("path"), F.col(name).alias("name"))


def _objects(types: Types) -> DataFrame:
    """Fields that lead to object types: ``project, a, b``, from type to type."""
    rows = types.edges.filter(F.col("declared").isin(OBJECT_KINDS))
    return rows.select("project", _named("path", "name").alias("a"), _named("ref_path", "ref_name").alias("b"))


def _trimmed(steps: DataFrame) -> DataFrame:
    """Without steps from types that none leads to, and to types that lead nowhere."""
    left = steps.count()
    while left:
        entered = steps.select("project", F.col("b").alias("a")).distinct()
        leaving = steps.select("project", F.col("a").alias("b")).distinct()
        kept = steps.join(entered, ["project", "a"], "left_semi").join(leaving, ["project", "b"], "left_semi")
        kept = checkpointed(kept)
        before, left, steps = left, kept.count(), kept
        if left == before:
            break
    return steps


def _coloured(steps: DataFrame) -> DataFrame:
    """``project, type, mark``: the least mark of the types that reach each type, itself included."""
    types = steps.select("project", F.col("a").alias("type")).union(steps.select("project", "b")).distinct()
    own = F.struct(F.xxhash64("project", "type").alias("h"), F.col("type").alias("of"))
    state = checkpointed(types.select("*", own.alias("mark"), F.lit(True).alias("fresh")))
    steps = steps.select("project", F.col("a").alias("type"), "b")
    while True:
        passed = state.filter("fresh").join(steps, ["project", "type"])
        passed = passed.groupBy("project", F.col("b").alias("type")).agg(F.min("mark").alias("passed"))
        lower = F.coalesce(F.col("passed") < F.col("mark"), F.lit(False))
        state = state.join(passed, ["project", "type"], "left").select(
            "project", "type", F.when(lower, F.col("passed")).otherwise(F.col("mark")).alias("mark"), lower.alias("fresh")
        )
        state = checkpointed(state)
        if state.filter("fresh").isEmpty():
            return state.select("project", "type", F.col("mark.of").alias("mark"))


def _reaching(steps: DataFrame, marks: DataFrame) -> DataFrame:
    """``project, type, mark``: types of a mark that reach the type the mark belongs to."""
    ends = [marks.select("project", F.col("type").alias(end), F.col("mark").alias("mark")) for end in ("a", "b")]
    same = checkpointed(steps.join(ends[0], ["project", "a"]).join(ends[1], ["project", "b", "mark"]))
    found = [marks.filter(F.col("type") == F.col("mark"))]
    while True:
        back = found[-1].withColumnRenamed("type", "b").join(same, ["project", "b", "mark"])
        back = back.select("project", F.col("a").alias("type"), "mark").distinct()
        known = reduce(DataFrame.union, found)
        fresh = checkpointed(back.join(known, ["project", "type"], "left_anti"))
        if fresh.isEmpty():
            return checkpointed(known)
        found.append(fresh)


def components(steps: DataFrame) -> DataFrame:
    """``project, type, cycle, n_types`` of the types that reach themselves along ``steps`` (``project, a, b``); ``cycle``
    is the smallest type of the component. Repeated steps and steps with a null end change nothing."""
    steps = steps.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    loop = F.col("a") == F.col("b")
    alone = steps.filter(loop).select("project", F.col("a").alias("type"))
    left, found = checkpointed(steps.filter(~loop)), []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        own = _reaching(left, _coloured(left))
        found.append(own)
        for end in ("a", "b"):
            left = left.join(own.select("project", F.col("type").alias(end)), ["project", end], "left_anti")
        left = checkpointed(left)
    alone = alone.select("*", F.col("type").alias("cycle"), F.lit(1).cast("long").alias("n_types"))
    if not found:
        return alone
    members = reduce(DataFrame.union, found)
    named = members.groupBy("project", "mark").agg(F.min("type").alias("cycle"), F.count(F.lit(1)).alias("n_types"))
    # a type by itself is in no cycle
    several = members.join(named.filter("n_types > 1"), ["project", "mark"]).select("project", "type", "cycle", "n_types")
    several = checkpointed(several)
    return several.union(alone.join(several, ["project", "type"], "left_anti"))


def type_cycles(types: Types) -> DataFrame:
    """Types that lead back to themselves: ``project, path, name, cycle_path, cycle_name, n_types``; the cycle is named by
    its smallest type and has so many types."""
    return components(_objects(types)).select(
        "project", "type.*", F.col("cycle.path").alias("cycle_path"), F.col("cycle.name").alias("cycle_name"), "n_types"
    )


def shared_types(types: Types) -> DataFrame:
    """Fields of all types that roots reach, each once: ``project, path, name, pos, field, type_text, kind, ref_path,
    ref_name, n_paths``.

    ``kind``: ``object``, ``cycle`` (leads to a type of the same component), ``enum`` or ``text``. ``n_paths``: ways from all roots into
    the component of the field's type, the root's own included, as a double (exact below 2^53). Where no type is in a
    cycle this is the number of nodes that ``type_closure`` has for the field.
    """
    objects = checkpointed(_objects(types))
    cycles = components(objects).select("project", "type", "cycle")

    def placed(rows: DataFrame, column: str, part: str) -> DataFrame:
        """``rows`` with the component of a type."""
        own = cycles.select("project", F.col("type").alias(column), F.col("cycle").alias(part))
        return rows.join(own, ["project", column], "left").withColumn(part, F.coalesce(part, column))

    ends = placed(placed(objects, "a", "part"), "b", "to").filter(F.col("part") != F.col("to"))
    steps = checkpointed(ends.groupBy("project", "part", "to").agg(F.count(F.lit(1)).alias("n_fields")))
    roots = types.roots.select("project", _named("path", "name").alias("type"))
    level = placed(roots, "type", "part").groupBy("project", "part").agg(F.count(F.lit(1)).cast("double").alias("n"))
    levels = [checkpointed(level)]
    while not levels[-1].isEmpty():
        below = levels[-1].join(steps, ["project", "part"])
        n = F.sum(F.col("n") * F.col("n_fields")).alias("n")
        levels.append(checkpointed(below.groupBy("project", F.col("to").alias("part")).agg(n)))
    paths = reduce(DataFrame.union, levels).groupBy("project", "part").agg(F.sum("n").alias("n_paths"))
    fields = types.edges.withColumn("type", _named("path", "name")).withColumn("below", _named("ref_path", "ref_name"))
    fields = placed(placed(fields, "type", "part"), "below", "to").join(paths, ["project", "part"])
    is_object = F.col("declared").isin(OBJECT_KINDS)
    kind = (
        F.when(is_object & (F.col("part") == F.col("to")), "cycle")
        .when(is_object, "object")
        .when(F.col("declared") == "enum", "enum")
        .otherwise("text")
    )
    return fields.select(*NODE, "pos", "field", "type_text", kind.alias("kind"), "ref_path", "ref_name", "n_paths")
