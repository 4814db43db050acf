"""Bounded samples that are the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many times the wanted rows pass the bound on their hashes, and how many more, so that enough of them do.
MARGIN, MORE = 1.5, 200


def smallest(rows: DataFrame, order: Column, wanted: int, same: list[str]) -> DataFrame:
    """The ``wanted`` rows with the smallest ``order``, a 64-bit hash of the columns ``same``; rows equal in these count once.

    A bound on the hash, from the number of hashes, lets about ``MARGIN * wanted`` rows pass before they are ordered, so
    that what tasks send does not grow with their number.
    """
    n = rows.agg(F.approx_count_distinct(order, 0.02).alias("n")).first()["n"]
    share = (MARGIN * wanted + MORE) / max(n, 1)
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    passed = rows.withColumn("_order", order).filter(F.col("_order") <= bound).dropDuplicates(same)
    return passed.orderBy("_order", *same).limit(wanted).drop("_order")
