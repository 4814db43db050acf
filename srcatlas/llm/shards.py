"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 by ``doc_id``, text checksum and size. The number goes through a Feistel network over
the smallest even number of bits that holds all rows; results outside the table go through it again (cycle
walking) until they are inside, so the network permutes exactly the row numbers. A row at place ``p`` of the
shuffle is in shard ``p mod SHARDS`` at slot ``p div SHARDS``: both follow from the row number, the number of rows and the
key, and ``row_number`` goes back. This is the law ``rows``: counts differ by one at most, slots are gapless.

Numbers come from a range partitioning that is written down once: a row's number is what its partition holds before
it plus what the partitions before hold. Only narrow rows move; no partition is one key's alone, because ties are
parted by a salt.

Defined results: a null text has size 1 and the checksum of no bytes. Null ``doc_id`` come first. Equal rows take
neighbouring numbers in any order, which does not change the result as a set. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.shipping import ship
from srcatlas.functions.storage import stored

SHARDS = 16
LAW = "rows"
#: Fixed round keys: the leading digits of pi.
KEYS = (314159265, 358979323, 846264338, 327950288, 419716939, 937510582)
_FACTOR = 0x9E3779B1
_LOCAL = (1 << 33) - 1


def half_bits(n: int) -> int:
    """Bits of each half of the network for ``n`` rows."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    mixed = (half + np.uint64(key)) * np.uint64(_FACTOR)
    mixed = (mixed ^ (mixed >> np.uint64(16))) * np.uint64(_FACTOR)
    return (mixed >> np.uint64(15)) & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, bits: int, keys: tuple[int, ...], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    if back:
        for key in reversed(keys):
            left, right = right ^ _round(left, key, bits), left
    else:
        for key in keys:
            left, right = right, left ^ _round(right, key, bits)
    return left << shift | right


def permuted(x: np.ndarray, n: int, keys: tuple[int, ...] = KEYS, back: bool = False) -> np.ndarray:
    """The place of each row number below ``n``, or with ``back`` the row number of each place."""
    out = x.astype(np.uint64)
    bits = half_bits(n)
    out = _network(out, bits, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], bits, keys, back)
    return out.astype(np.int64)


def row_number(shard: int, slot: int, n: int, shards: int = SHARDS, keys: tuple[int, ...] = KEYS) -> int:
    """The global row number at ``slot`` of ``shard``."""
    return int(permuted(np.array([slot * shards + shard]), n, keys, back=True)[0])


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with a gapless ``row_number`` in the order of ``by``."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_salt", salt).repartitionByRange(parts, *by, "_salt").sortWithinPartitions(*by, "_salt")
    held = stored(ranged.drop("_salt").withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    # one row for each partition
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_id").bitwiseAND(F.lit(_LOCAL))
    joined = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("row_number", F.col("_start") + own).drop("_id", "_part", "_start")


def _place(number: Column, n: int) -> Column:
    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n))

    return place(number)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot`` of each row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"])
    ship(documents.sparkSession)
    n = rows.count()
    if n == 0:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    place = rows.withColumn("_place", _place(F.col("row_number"), n))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).alias("slot"),
    )

