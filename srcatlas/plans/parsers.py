"""Parsers by kind of project: what a catalogue is read with.

A parser turns source rows into one catalogue record for each file that has facts. Which kind a project is follows from the
markers in its manifest: the fixed ones in their order, then those of further parsers in the order of registration. A kind
without a parser has projects, but no facts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import patterns as P
from srcatlas.functions.outline import stored_outline
from srcatlas.functions.rows import settle
from srcatlas.operators.orm import detect_orm
from srcatlas.sources.scan import code_files, filter_sources, src_only

#: Source rows a parser may ask for.
SCOPES = {"sources": filter_sources, "src": src_only}


@dataclass(frozen=True)
class Parser:
    """``records``: from source rows (project, path, content, and their outline ``o``) to ``project, path`` and the lists of
    a catalogue record; ``scope``: one of ``SCOPES``; ``marker``: text in the manifests of its projects, by default
    the kind."""

    kind: str
    records: Callable[[DataFrame], DataFrame]
    scope: str = "sources"
    marker: str | None = None

    def __post_init__(self) -> None:
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope {self.scope!r}")


def with_parser(parsers: Mapping[str, Parser], *more: Parser) -> dict[str, Parser]:
    """``parsers`` and further ones; of one kind, the later counts."""
    return dict(parsers) | {p.kind: p for p in more}


def markers(parsers: Mapping[str, Parser]) -> dict[str, str]:
    """Kinds and their markers, in the order in which manifests are tested."""
    own = {kind: p.marker or kind for kind, p in parsers.items()}
    return {kind: own.get(kind, kind) for kind in P.ORM_MARKERS} | own


def facts(files: DataFrame, manifests: DataFrame, parsers: Mapping[str, Parser], columns: list[str]) -> DataFrame:
    """``columns`` of the records of all projects, each read by the parser of its kind.

    Texts are folded once for all parsers. Records are made first and joined with the projects of their kind then; texts never
    move. A record is one file's, so that no group grows with a project.
    """
    code = stored_outline(code_files(files))
    rows = []
    for kind, parser in parsers.items():
        made = parser.records(SCOPES[parser.scope](code)).select(*columns)
        rows.append(settle(made).select(F.lit(kind).alias("kind"), "*"))
    known = detect_orm(manifests, markers(parsers)).filter(F.col("kind").isNotNull())
    return reduce(DataFrame.unionByName, rows).join(known, ["project", "kind"], "left_semi").select(*columns)
