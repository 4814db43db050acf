"""Connected components of a table of links, without a link or a component in the driver.

Each task first joins its own links by union-find; what is left is a forest. Then rounds follow: every node is
linked to its smallest neighbour, its other neighbours to that one, until each node has one smaller neighbour that has
none itself. The number of links never grows. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.words import mapped

#: Links that a task holds at once while it joins them.
HELD = 500_000


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node with the smallest node of its group, by union-find with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _local_forests(links: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            pairs = forest(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["node", "up"]
            )

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= HELD:
                yield out()
                held = []
        if held:
            yield out()

    return mapped(links, made, "node long, up long")


def components(links: DataFrame, local: bool = True) -> DataFrame:
    """``node, up``: each linked node but the smallest of its component, with that smallest one.

    ``links`` has two long columns; loops and nulls in them count as no link. Without ``local`` there are only the
    rounds, and no Python runs on the links.
    """
    a, b = (F.col(f"`{n}`") for n in links.columns)
    edges = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("up"))
    edges = edges.filter((a != b) & a.isNotNull() & b.isNotNull())
    edges = stored(_local_forests(edges) if local else edges.distinct(), "links")
    while True:
        # every node's smallest neighbour among the smaller ones; the others are linked to that
        least = edges.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"))
        least = stored(least, "least")
        others = edges.join(least.filter("least < most").select("node", "least"), "node")
        others = others.filter("up > least").select(F.col("up").alias("node"), F.col("least").alias("up"))
        # a node whose smallest neighbour has a smaller one itself goes there
        further = least.select(F.col("node").alias("up"), F.col("least").alias("further"))
        jumped = least.select("node", F.col("least").alias("up")).join(further, "up", "left")
        moved = jumped.select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        open_ = stored(others.withColumn("moved", F.lit(True)).union(moved), "links")
        if not open_.filter("moved").limit(1).count():
            return open_.select("node", "up")
        edges = open_.select("node", "up").distinct()
