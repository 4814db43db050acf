"""Folder trees as lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P


def folder_tree(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """One row per folder and file of every project, and one for its root.

    Columns: project, node (path parts; sorting by it gives the printed order), depth,
    name, line.  Only paths are read.  No window runs over a folder or a project: the
    last entry of a folder is a maximum, and joins are on keys that are unique on
    their right side.
    """
    path = F.col("path")
    excluded = reduce(lambda a, b: a | b, [path.contains(x) for x in P.TREE_EXCLUDES])
    kept = files.select("project", "path").filter(~excluded)
    if not show_hidden:
        kept = kept.filter(~path.rlike(r"(^|/)\."))
    parts = F.split("path", "/")
    nodes = (
        kept.select(
            "project",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)),
                    lambda i: F.struct(
                        F.slice(parts, F.lit(1), i).alias("node"),
                        (i < F.size(parts)).alias("is_dir"),
                    ),
                )
            ).alias("n"),
        )
        .groupBy("project", F.col("n.node").alias("node"))
        .agg(F.max("n.is_dir").alias("is_dir"))
        .select(
            "project",
            "node",
            "is_dir",
            F.element_at("node", -1).alias("name"),
            F.slice("node", F.lit(1), F.size("node") - 1).alias("parent"),
        )
    )
    last = (
        nodes.groupBy("project", "parent")
        .agg(F.max("name").alias("name"))
        .select(
            "project",
            F.concat("parent", F.array("name")).alias("node"),
            F.lit(True).alias("is_last"),
        )
    )
    flagged = nodes.join(last, ["project", "node"], "left").withColumn(
        "is_last", F.coalesce("is_last", F.lit(False))
    )
    # what stands in front of the entries of a folder: one mark per folder above them
    folders = flagged.filter("is_dir")
    above = folders.select(
        "project",
        F.col("node").alias("parent"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("node")),
                lambda i: F.slice("node", F.lit(1), i),
            )
        ).alias("node"),
    )
    marks = (
        above.join(folders.select("project", "node", "is_last"), ["project", "node"])
        .groupBy("project", "parent")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.size("node").alias("i"), "is_last"))),
                    lambda m: F.when(m["is_last"], "    ").otherwise("│   "),
                ),
                "",
            ).alias("marks")
        )
    )
    branch = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    entries = flagged.join(marks, ["project", "parent"], "left").select(
        "project",
        "node",
        F.size("node").alias("depth"),
        "name",
        F.concat(F.coalesce("marks", F.lit("")), branch, "name").alias("line"),
    )
    roots = (
        files.select("project")
        .distinct()
        .select(
            "project",
            F.array().cast("array<string>").alias("node"),
            F.lit(0).alias("depth"),
            F.col("project").alias("name"),
            F.col("project").alias("line"),
        )
    )
    return roots.unionByName(entries)
