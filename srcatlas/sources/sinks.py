"""Writing documents and diagrams, one folder per project.

A run replaces the folders of the projects it has, and leaves those of others; files come into place when the whole
job has ended, so a job that fails leaves what was there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.shipping import ship
from srcatlas.functions.storage import local_path

ORDER = ["project", "section", "part", "path", "ord", "line"]


def _replace_projects(rows: DataFrame, order: list[str], target: str) -> None:
    """Each project's rows into ``target/project=<name>/``, in order within each file.

    Rebalancing deals rows by project and, by the sizes found at run time, splits projects that are large and puts
    small ones together: nothing is sampled or written down before.
    """
    dealt = rows.hint("rebalance", F.col("project")).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("project").parquet(target)


def write_documents(lines: DataFrame, target: str) -> None:
    """Document lines; ``ORDER`` puts the lines of several files of a project in order."""
    _replace_projects(lines, ORDER, target)


def write_erd(erd: DataFrame, edges: DataFrame, target: str) -> None:
    """Diagram pieces of the projects that have edges."""
    with_edges = edges.select("project").distinct()
    kept = erd.join(with_edges, "project", "left_semi").select("project", "path", "text")
    _replace_projects(kept, ["project", "path"], target)


# --- one folder for each text ---------------------------------------------------------------------------

_ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32))))  # as Spark names folders
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_texts(rows: DataFrame, target: str) -> None:
    """Texts (``where``, ``value``) into ``target/where=<where>/``, one file for each folder, one line end behind each text.

    Spark's writer starts a process to set the mode of each file and folder it makes on a local file system, and moves each
    into place; there, tasks write the files themselves. A file comes into place whole, so a task may be run again.
    """
    # the table may come as one split
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.coalesce("where", F.lit("")).alias("where"), "value").repartition(parts, "where")
    root = local_path(rows.sparkSession, target)
    if root is None:
        writer = dealt.write.partitionBy("where")
        # tasks move their own files into place (2), not the driver all of them
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(target)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        n, name = 0, f"part-{TaskContext.get().partitionId():05d}.txt"
        for where, group in groupby(texts, lambda row: row[0]):
            write_text(root, where, name, [value for _, value in group])
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    os.makedirs(root, exist_ok=True)
    ship(rows.sparkSession)
    # binary: a text is written as it is, whether or not it can be decoded
    binary = dealt.sortWithinPartitions("where").select("where", F.col("value").cast("binary"))
    binary.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def write_text(root: str, where: str, name: str, texts: list[bytes | None]) -> None:
    """One folder with its file, which is there whole or not at all."""
    named = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in where) or _NO_NAME
    folder = os.path.join(root, f"where={named}")
    os.makedirs(folder, exist_ok=True)
    # readers pass over names that begin with a dot
    made = os.path.join(folder, f".{name}")
    with open(made, "wb") as file:
        file.writelines((text or b"") + b"\n" for text in texts)
    os.replace(made, os.path.join(folder, name))
