"""Which kind of project a manifest describes, and routing by kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.rows import settle


def detect_orm(manifests: DataFrame, markers: Mapping[str, str] | None = None) -> DataFrame:
    """(project, kind): the kind of the first marker found in the manifest text, else NULL; ``markers``: of each kind."""
    markers = markers or {m: m for m in P.ORM_MARKERS}
    kind = F.coalesce(
        *[F.when(F.contains("content", F.lit(m)), F.lit(k)) for k, m in markers.items()]
    )
    return manifests.select("project", kind.alias("kind"))


def supported_projects(manifests: DataFrame, markers: Mapping[str, str] | None = None) -> DataFrame:
    return detect_orm(manifests, markers).filter(F.col("kind").isNotNull())


def unsupported_projects(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Projects without a catalogue, and why."""
    no_marker = (
        detect_orm(manifests)
        .filter(F.col("kind").isNull())
        .select("project", F.lit("no supported parser").alias("reason"))
    )
    no_manifest = (
        files.select("project")
        .distinct()
        .join(manifests.select("project"), "project", "left_anti")
        .select("project", F.lit("no readable manifest").alias("reason"))
    )
    return no_marker.unionByName(no_manifest)


def for_kind(
    sources: DataFrame,
    manifests: DataFrame,
    kind: str,
    extract: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Facts of the projects of one kind.

    Texts of other projects are not read for them: the names of the kind's projects, one short text each, are sent to all
    executors, so no file content moves.
    """
    wanted = detect_orm(manifests).filter(F.col("kind") == kind).select("project")
    return settle(extract(of_projects(sources, wanted)))


def of_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of these projects, left where they are."""
    return rows.join(F.broadcast(projects.distinct()), "project", "left_semi")
