"""Source files, manifests and file lists of many projects."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.shipping import ship
from srcatlas.functions.storage import local_path
from srcatlas.functions.text import base_name, normalize_newlines


#: Patterns that mean the same to Python and to Spark, and whose files are not compressed.
_PLAIN_PATTERN = re.compile(r"[\w.*?-]*\.(?:ts|txt|json|js|prisma|md)")
_TREE = "project string, path string, content binary"
_BATCH_BYTES = 16 << 20


def read_tree(spark: SparkSession, root: str, pattern: str = "*.ts") -> DataFrame:
    """Files below ``<root>/<project>/`` as (project, path, content), one row per file.

    Spark lists all folders before it reads, on the driver or a task for each few, and reads 32 small files in a task; on a local
    file system that tasks can open, they list and read by themselves.
    """
    local = local_path(spark, root) if _PLAIN_PATTERN.fullmatch(pattern) else None
    if local is None or not os.path.isdir(local):
        return _read_by_spark(spark, root, pattern)
    parts = 4 * spark.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                yield from _batches(tree_files(local, pattern, bucket, parts))

    ship(spark)
    files = spark.range(parts, numPartitions=parts).mapInArrow(read, _TREE)
    # a text is taken as it is, as Spark takes it
    return files.withColumn("content", F.col("content").cast("string"))


def _batches(files: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, str, bytes]] = []
    size = 0
    for project, path, file in files:
        with open(file, "rb") as opened:
            text = opened.read()
        if not text:  # Spark has no row for an empty file
            continue
        rows.append((project, path, text))
        size += len(text) + 200
        if size > _BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows)
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["project", "path", "content"])


def _hidden(name: str) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def tree_files(root: str, pattern: str, bucket: int, parts: int) -> Iterator[tuple[str, str, str]]:
    """(project, path, file) of the files of one of ``parts`` buckets below a folder.

    Of many projects each is in one bucket; of few, each file is, so that a large one does not fall to one task.
    """
    names = sorted(n for n in os.listdir(root) if not _hidden(n))
    own = lambda text: zlib.crc32(text.encode("utf-8", "surrogateescape")) % parts == bucket
    many = len(names) >= _MANY * parts
    open_ = [n for n in names if not many or own(n)]
    while open_:
        inside = open_.pop()
        full = os.path.join(root, inside)
        if os.path.isdir(full):
            open_ += [f"{inside}/{n}" for n in os.listdir(full) if not _hidden(n)]
        elif fnmatchcase(os.path.basename(inside), pattern) and (many or own(inside)):
            project, _, path = inside.partition("/")
            yield project, path or project, full


_MANY = 50


def _read_by_spark(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    df = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern
    ).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file"))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    # file paths come URL-encoded; a plus sign there is a plus sign
    decoded = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    return df.select(
        "content", F.substring_index(decoded, base, -1).alias("inside")
    ).select(
        F.substring_index("inside", "/", 1).alias("project"),
        F.expr("substring(inside, instr(inside, '/') + 1)").alias("path"),
        "content",
    )


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    return filter_sources(read_tree(spark, root))


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``package.json`` at the root of every project; deeper ones do not count."""
    df = read_tree(spark, root, "package.json")
    return df.filter(F.col("path") == "package.json").select("project", "content")


def filter_sources(df: DataFrame) -> DataFrame:
    """TypeScript files outside ``node_modules`` that are not declaration files."""
    path = F.col("path")
    return df.filter(
        path.endswith(".ts") & ~path.contains("node_modules") & ~path.endswith(".d.ts")
    ).withColumn("content", normalize_newlines(F.col("content")))


def src_only(df: DataFrame) -> DataFrame:
    """``src/**/*.ts``: what API documents and interfaces are read from.

    Declaration files stay in.
    """
    path = F.col("path")
    return df.filter(path.startswith("src/") & path.endswith(".ts")).withColumn(
        "content", normalize_newlines(F.col("content"))
    )


def code_files(files: DataFrame) -> DataFrame:
    """Every file that ``filter_sources`` or ``src_only`` keeps."""
    path = F.col("path")
    wanted = path.endswith(".ts") & (path.startswith("src/") | ~path.contains("node_modules"))
    return files.filter(wanted).withColumn("content", normalize_newlines(F.col("content")))


def list_paths(files: DataFrame) -> DataFrame:
    """All file paths; file contents are never read."""
    return files.select("project", "path")


def has_prisma_schema(files: DataFrame) -> DataFrame:
    """Projects that hold ``prisma/schema.prisma``."""
    return (
        list_paths(files)
        .filter(F.col("path") == "prisma/schema.prisma")
        .select("project")
        .distinct()
    )


def validate_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests with the project they name, whether accepted, and if not why.

    ``requests`` has a ``project_path``; ``projects`` one row per known project.
    Requests without a path are refused before the join, so they do not meet on one key. Many
    others may name one project: ``projects`` is unique on the join key, so a skewed partition of
    requests can be split without changing the result.
    """
    path = F.col("project_path")
    none = path.isNull() | (F.trim(path) == "")
    named = requests.withColumn("project", base_name(path))
    known = projects.select(F.col("project"), F.lit(True).alias("known"))
    looked_up = named.filter(~none).join(known, "project", "left").select(*named.columns, "known")
    refused = named.filter(none).withColumn("known", F.lit(None).cast("boolean"))
    reason = (
        F.when(path.isNull() | (path == ""), "empty project path")
        .when(F.col("known").isNull(), "project path not found")
    )
    checked = looked_up.unionByName(refused).withColumn("reason", reason)
    return checked.withColumn("accepted", F.col("reason").isNull()).drop("known")
