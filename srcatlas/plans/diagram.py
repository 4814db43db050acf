"""Entity-relationship diagrams as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.rows import settle
from srcatlas.operators.entities import relationships
from srcatlas.operators.orm import for_kind, supported_projects
from srcatlas.operators.types import interface_refs

HEADER = "erDiagram\n"
NO_EDGES = "erDiagram\n    %% No relationships found"
EDGE_KEYS = ["project", "path", "class_pos", "property_pos", "pos"]


def project_edges(sources: DataFrame, manifests: DataFrame, **reading: str) -> DataFrame:
    """Edges of all supported projects, each read the way of its kind."""
    entity = for_kind(
        sources, manifests, "typeorm", lambda s: relationships(s, **reading)
    )
    interface = for_kind(sources, manifests, "mongoose", interface_refs)
    return entity.unionByName(
        interface.withColumnRenamed("type_pos", "class_pos").select(*entity.columns)
    )


def erd_edges(edges: DataFrame) -> DataFrame:
    """Drawable edges with their line; edge types without a symbol are dropped."""
    symbols = edges.sparkSession.createDataFrame(
        list(P.RELATION_SYMBOLS.items()), "type string, symbol string"
    )
    line = F.concat(
        F.lit("    "), "from", F.lit(" "), "symbol", F.lit(" "), "to", F.lit(' : ""')
    )
    # four rows, whatever the data
    return settle(edges).join(F.broadcast(symbols), "type").withColumn("line", line)


def erd_lines(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Lines of every project's diagram: a header, then one line per drawable edge.

    A project with no edge at all gets a note; one whose edges cannot be drawn gets the
    bare header.
    """
    with_edges = edges.select("project").distinct()
    none = F.array().cast("array<int>")
    first = lambda df, *texts: df.select(
        "project",
        F.lit("").alias("path"),
        none.alias("ord"),
        F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("line", "text"),
    )
    empty = first(
        projects.join(with_edges, "project", "left_anti"), *NO_EDGES.split("\n")
    )
    header = first(projects.join(with_edges, "project", "left_semi"), HEADER.rstrip("\n"))
    drawn = erd_edges(edges).select(
        "project",
        "path",
        F.array("class_pos", "property_pos", "pos").alias("ord"),
        F.lit(0).alias("line"),
        F.col("line").alias("text"),
    )
    return empty.unionByName(header).unionByName(drawn)


def erd_text(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Diagram text in pieces: the header, then one piece per file.

    Put together in ``path`` order the pieces are the whole text.  A piece is bounded
    by its file, so a project of any size never has to fit into one row.
    """
    with_edges = edges.select("project").distinct().withColumn("any", F.lit(True))
    head = projects.select("project").join(with_edges, "project", "left").select(
        "project",
        F.lit("").alias("path"),
        F.when(F.col("any"), HEADER).otherwise(NO_EDGES).alias("text"),
    )
    pieces = (
        erd_edges(edges)
        .groupBy("project", "path")
        .agg(F.array_sort(F.collect_list(F.struct("class_pos", "property_pos", "pos", "line"))).alias("ls"))
        .select(
            "project",
            "path",
            F.array_join(F.transform("ls", lambda l: F.concat(l["line"], F.lit("\n"))), "").alias("text"),
        )
    )
    return head.unionByName(pieces)
