"""Keeping costly columns evaluated once.

The optimizer moves filters below the columns they test, by writing the columns'
definitions into the filter.  For columns read out of source text that would run
the whole extraction a second time inside the filter, and a chain of such columns
would make the filter's expression explode.  These helpers hold such filters back;
filters on stored columns (``path``, ``content``) still reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(array: Column | str) -> Column:
    """Generator input for an array column.

    For a bare column the optimizer adds a filter on its size; it does not for an
    expression.
    """
    return F.flatten(F.array(array))


def settle(df: DataFrame, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows as they are, or those for which ``where`` holds on their struct.

    Filters on the result, those that joins imply on their keys included, stay above.
    """
    row = F.array(F.struct(*df.columns))
    return df.select(F.inline(row if where is None else F.filter(row, where)))
