"""Whitening of vectors: their covariance by polarisation, its eigenvectors, and each vector projected on these.

Entries become integers ``x = floor(64 c) + 1000000``. For every dimension the squares of centred values are summed, and for every
pair of dimensions the squares of the centred sums of two entries. As ``var(a + b) = var(a) + var(b) + 2 cov(a, b)``, the differences
give all covariances. All sums are exact: tasks centre at the mean rounded to an integer, ``m``, and add up Python
or 64-bit integers; what rounding left out, ``S - n m``, goes into the squares as an integer afterwards. The matrix of covariances,
each correctly rounded from a quotient of integers, is decomposed on the driver (``D x D`` numbers, whatever the number of rows).

Tasks send one row for each pair and 32 bits of their sums, which are added by key; no rows of the table are collected.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out; so are rows whose vector
has another length than most have (of equally frequent lengths the larger counts). Entries beyond ``2^62 / 64`` in size
count as that. A null id stays null. Repeated rows count and are returned each. Equal eigenvalues: any orthogonal choice,
the same for all rows. A component without variance (its eigenvalue is not above ``D 2^-52`` of the largest) has no scale:
``whitened`` is null there and the identity error does not count it; it is null if no component has variance.
``explained`` is 0 if there is no variance at all. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.words import listed, mapped

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries are held within this distance from 0 before the shift.
LARGEST = 1 << 62
#: Rows that are worked on at once.
ROWS = 2048
#: Below it in size, sums over a block of squared sums of two entries fit in 64 bits.
_SMALL = 1 << 24
_LIMB = (1 << 32) - 1
_DIGITS = 38


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def fit_list(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """``key`` and ``vector`` of the rows that count, how many these are, and their vectors' length."""
    kept = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kept = kept.filter(usable(F.col("vector")))
    common = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return kept.limit(0), 0, 0
    return kept.filter(F.size("vector") == common["d"]), common["count"], common["d"]


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows as integer matrices without the shift, and where each begins in the batch."""
    flat = batch.column("vector").flatten().to_numpy().reshape(-1, d)
    for at in range(0, len(flat), ROWS):
        whole = np.floor(flat[at : at + ROWS] * SCALE)
        yield at, np.clip(whole, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _sum(values: np.ndarray) -> np.ndarray:
    """Sums over the first axis, of any size, as Python integers."""
    low, high = values & _LIMB, values >> 32
    return low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 32)


def exact_sums(rows: DataFrame, d: int, n_values: int, of_block) -> list[int]:
    """Sums over all rows of the ``n_values`` Python integers that ``of_block`` gives for a block."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_values, object)
        for batch in batches:
            for _, block in _matrices(batch, d):
                total = total + of_block(block)
        place, limb, value = [], [], []
        for i in np.flatnonzero(total).tolist():
            rest, k = int(total[i]), 0
            while rest not in (0, -1):
                place.append(i), limb.append(k), value.append(rest & _LIMB)
                rest, k = rest >> 32, k + 1
            if rest:
                place.append(i), limb.append(k), value.append(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["place", "limb", "value"]
        )

    parts = mapped(rows.select("vector"), made, "place int, limb int, value long")
    out = [0] * n_values
    for row in parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect():
        out[row["place"]] += row["value"] << (32 * row["limb"])
    return out


def squares(block: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For each dimension the sum of squares about ``middle``, then for each pair, row by row of the upper triangle, that of sums."""
    off = block - middle
    if len(off) and (off.max() >= _SMALL or off.min() <= -_SMALL):
        off = block.astype(object) - middle.astype(object)
    columns = np.ascontiguousarray(off.T)
    d = len(columns)
    out = [(columns * columns).sum(axis=1)]
    for i in range(d - 1):
        both = columns[i + 1 :] + columns[i]
        out.append((both * both).sum(axis=1))
    return np.concatenate(out).astype(object)


@dataclass
class Whitening:
    """What is known of the fit list: ``n`` vectors, sums of ``x`` by dimension, components and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """Standard deviations; nan where there is no variance."""
        largest = self.variances.max(initial=0.0)
        there = (self.variances > len(self.sums) * 2.0**-52 * largest) & (self.variances > 0)
        return np.sqrt(np.where(there, self.variances, np.nan))

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.variances, 0) / self.trace if self.trace else np.zeros(len(self.variances))

    def middle(self) -> tuple[np.ndarray, list[int]]:
        """The rounded means without the shift, and what they leave out of the sums."""
        plain = [s - self.n * SHIFT for s in self.sums]
        middle = [(2 * s + self.n) // (2 * self.n) for s in plain]
        return np.array(middle, np.int64), [s - self.n * m for s, m in zip(plain, middle, strict=True)]


def covariance(n: int, left_out: list[int], summed: list[int]) -> np.ndarray:
    """The covariance matrix from sums of squares about rounded means."""
    d = len(left_out)
    # n times each centred sum of squares; with numerators over n * n these are variances
    single = [n * summed[i] - left_out[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    place = d
    for i in range(d):
        out[i, i] = single[i] / (n * n)
        for j in range(i + 1, d):
            pair = n * summed[place] - (left_out[i] + left_out[j]) ** 2
            out[i, j] = out[j, i] = (pair - single[i] - single[j]) / (2 * n * n)
            place += 1
    return out


def fit(rows: DataFrame, n: int, d: int) -> Whitening:
    sums = exact_sums(rows, d, d, _sum)
    model = Whitening(n, [s + n * SHIFT for s in sums], np.zeros((d, 0)), np.zeros(0), 0.0)
    middle, left_out = model.middle()
    summed = exact_sums(rows, d, d * (d + 1) // 2, lambda block: squares(block, middle))
    matrix = covariance(n, left_out, summed)
    value, vector = np.linalg.eigh(matrix)
    model.variances, vector = value[::-1], vector[:, ::-1]
    sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(d)])
    model.components = vector * np.where(sign == 0, 1, sign)
    model.trace = float(sum(n * summed[i] - left_out[i] ** 2 for i in range(d)) / (n * n))
    return model


def _project(model: Whitening, k: int):
    """A function from blocks to their whitened rows."""
    middle, left_out = model.middle()
    rest = np.array([r / model.n for r in left_out])
    turned = model.components[:, :k] / model.scales[:k]
    return lambda block: ((block - middle).astype(float) - rest) @ turned


def identity_error(rows: DataFrame, model: Whitening, k: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    there = np.flatnonzero(~np.isnan(model.scales[:k]))
    if not len(there):
        return None
    project, m = _project(model, k), len(there)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            for _, block in _matrices(batch, len(model.sums)):
                z = project(block)[:, there]
                total[:m] += z.T @ z
                total[m] += z.sum(axis=0)
        place = pa.array(np.arange(total.size), pa.int32())
        yield pa.RecordBatch.from_arrays([place, pa.array(total.ravel())], ["place", "value"])

    total = np.zeros((m + 1) * m)
    parts = mapped(rows.select("vector"), made, "place int, value double")
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row["place"]] = row["value"]
    mean = total[m * m :] / model.n
    return float(np.abs(total[: m * m].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max())


def whitened(rows: DataFrame, key: str, vector: str, k: int = COMPONENTS) -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error`` of each row of the fit list.

    ``whitened`` and ``explained`` have an entry for each of the first ``k`` components; ``deviation`` is the sum of
    ``(n x - S)^2`` over the dimensions as ``decimal(38)``, null if it is longer.
    """
    kept, n, d = fit_list(rows, key, vector)
    kind = rows.schema[key].dataType.simpleString()
    model = fit(kept, n, d) if n else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    error = identity_error(kept, model, k) if n else None
    explained = model.explained[:k].tolist()
    middle, left_out = model.middle() if n else (None, [])
    project = _project(model, k) if n else None
    m = min(k, d)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = Context(prec=_DIGITS + 2)
        for batch in batches:
            for at, block in _matrices(batch, d):
                z = project(block).ravel()
                deviation = [digits.create_decimal(v) if v < 10**_DIGITS else None for v in _deviations(block - middle, n, left_out)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key")[at : at + len(block)],
                        pa.array(deviation, pa.decimal128(_DIGITS, 0)),
                        listed(z, np.full(len(block), m), pa.float64()),
                    ],
                    ["key", "deviation", "whitened"],
                )

    out = mapped(kept, made, f"key {kind}, deviation decimal({_DIGITS},0), whitened array<double>")
    return out.select(
        F.col("key").alias(key),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.transform("whitened", lambda z: F.when(~F.isnan(z), z)).alias("whitened"),
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _deviations(off: np.ndarray, n: int, left_out: list[int]) -> list[int]:
    """For each row the sum of ``(n off - left_out)^2``."""
    rest = np.array(left_out, object)
    if off.max(initial=0) < _SMALL and off.min(initial=0) > -_SMALL and _SMALL * n * len(rest) < 1 << 63:
        square, across = (off * off).sum(axis=1), off @ rest.astype(np.int64)
    else:
        big = off.astype(object)
        square, across = (big * big).sum(axis=1), big @ rest
    constant = sum(r * r for r in left_out)
    return [n * (n * int(a) - 2 * int(b)) + constant for a, b in zip(square, across, strict=True)]
