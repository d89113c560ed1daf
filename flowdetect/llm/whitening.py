"""Whitening of embeddings by polarisation (operator 11).

Every entry c becomes the integer x = floor(64 c) + 1000000. A first pass sums
each dimension; a second one sums the exact squares of the centred values of
every dimension and of every sum of two dimensions. Since
2 cov(i, j) = var(i + j) - var(i) - var(j), these sums of squares alone give
the covariance, as exact integers over n squared; its eigenvectors whiten the
rows, and the covariance of the whitened rows is measured on what was written.

Values are centred at the integer nearest the mean, and the rest of the mean
is taken off exactly. Sums travel as 32-bit limbs in long columns, so no size of
table makes them overflow or round. The driver holds only sums of dimensions and
of their pairs.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries are dropped, and vectors of another length than the commonest (of
equally common lengths, the longest) as well; 64 c is cut to +-2^60; a null
id stays null; repeated rows count each time and are returned each time; extra
columns are not read; an empty table gives an empty result. A component whose
variance is zero (up to rounding) has a null ``whitened`` and takes no part in
``identity_error``; ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import lean, stored
from flowdetect.llm.vectors import blocks, finite_rows, vector_array

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMIT = float(1 << 60)
LIMB = 32
#: Bits of one factor of an exact product: 2048 products of two such numbers fit a long.
PART_BITS = 25
LONG_MAX = (1 << 63) - 1


def to_integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def square_sums(values: np.ndarray) -> np.ndarray:
    """Exact sum of squares of every column (Python integers); at most 2048 rows of numbers below 2^62."""
    top = int(np.abs(values).max(initial=0))
    if top < 1 << PART_BITS:
        return np.einsum("ij,ij->j", values, values).astype(object)
    sign, rest, parts = np.sign(values), np.abs(values), []
    while rest.any():
        parts.append(sign * (rest & ((1 << PART_BITS) - 1)))
        rest = rest >> PART_BITS
    out = np.zeros(values.shape[1], dtype=object)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            out += np.einsum("ij,ij->j", left, right).astype(object) << (PART_BITS * (a + b))
    return out


def column_sums(values: np.ndarray) -> np.ndarray:
    """Exact sum of every column (Python integers)."""
    high = values >> LIMB
    return (high.sum(axis=0).astype(object) << LIMB) + (values - (high << LIMB)).sum(axis=0).astype(object)


def exact_totals(rows: DataFrame, width: int, slots: int, measure) -> list[int]:
    """Exact totals of ``slots`` numbers that ``measure`` (integer block -> Python integers) gives for every block of rows."""

    def run(batches):
        total = np.zeros(slots, dtype=object)
        for batch in batches:
            for _, block in blocks(batch.column(0), width):
                total = total + measure(to_integers(block))
        slot, limb, part = [], [], []
        for k, value in enumerate(total.tolist()):
            sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
            while rest:
                slot.append(k)
                limb.append(at)
                part.append(sign * (rest & ((1 << LIMB) - 1)))
                rest >>= LIMB
                at += 1
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], ["slot", "limb", "part"])

    parts = rows.select("vector").mapInArrow(lean(run), "slot int, limb int, part long")
    out = [0] * slots
    for slot, limb, part in parts.groupBy("slot", "limb").agg(F.sum("part").alias("part")).collect():  # a few rows a slot
        out[slot] += part << (LIMB * limb)
    return out


class Whitening:
    """Exact sums of a fit list, its covariance and its components."""

    def __init__(self, rows: DataFrame, width: int, components: int = COMPONENTS):
        self.width = width
        self.n = n = rows.count()
        self.sums = exact_totals(rows, width, width, column_sums)
        self.centre = [round(Fraction(s, n)) for s in self.sums]
        centre = np.array(self.centre, dtype=np.int64)

        def squares(x):
            z = x - centre
            out = [square_sums(z)]
            for i in range(width - 1):
                out.append(square_sums(z[:, i + 1 :] + z[:, i : i + 1]))
            return np.concatenate(out)

        total = exact_totals(rows, width, width * (width + 1) // 2, squares)
        self.rest = rest = [s - n * c for s, c in zip(self.sums, self.centre)]  # sums of the centred values
        single = [n * total[i] - rest[i] ** 2 for i in range(width)]  # n^2 variance of a dimension
        matrix = np.zeros((width, width))
        at = width
        for i in range(width):
            matrix[i, i] = single[i] / n**2
            for j in range(i + 1, width):
                pair = n * total[at] - (rest[i] + rest[j]) ** 2  # n^2 variance of a sum of two
                matrix[i, j] = matrix[j, i] = (pair - single[i] - single[j]) / (2 * n**2)
                at += 1
        self.covariance = matrix
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(-values, kind="stable")[: min(components, width)]
        self.values, self.vectors = values[order], vectors[:, order]
        self.live = self.values > width * np.finfo(float).eps * max(values.max(), 0.0)
        trace = float(np.trace(matrix))
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))

    def project(self, vectors: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened coordinates (nan for components without variance) and the deviation of some rows."""
        n, rest = self.n, self.rest
        z = to_integers(vectors) - np.array(self.centre, dtype=np.int64)
        mean = np.array([r / n for r in rest])
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        white = ((z - mean) @ self.vectors) / scale
        far = n * int(np.abs(z).max(initial=0)) + max(abs(r) for r in rest)
        if far**2 * self.width <= LONG_MAX:
            u = z * n - np.array(rest, dtype=np.int64)
            return white, np.einsum("ij,ij->i", u, u).tolist()
        u = z.astype(object) * n - np.array(rest, dtype=object)
        return white, [d if d <= LONG_MAX else None for d in (u * u).sum(axis=1).tolist()]


def whitened_rows(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of every row, ``whitened`` an array over the components."""

    def run(batches):
        for batch in batches:
            for lo, block in blocks(batch.column(1), model.width):
                white, deviation = model.project(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(block)), pa.array(deviation, pa.int64()), vector_array(white)], ["id", "deviation", "whitened"]
                )

    return rows.mapInArrow(lean(run), "id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    live = np.flatnonzero(model.live)
    width, k, n = len(model.live), len(live), model.n
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            for _, block in blocks(batch.column(0), width):
                w = block[:, live]
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "part"])

    sums = np.zeros(k + k * k)
    for slot, part in white.select("whitened").mapInArrow(lean(run), "slot int, part double").groupBy("slot").agg(F.sum("part")).collect():
        sums[slot] = part
    mean = sums[:k] / n
    return float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every remaining row and component."""
    rows, width = finite_rows(df, id_col, vector_col)
    if not width:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    model = Whitening(rows, width, components)
    white = stored(whitened_rows(rows, model), "whitened")
    error = identity_error(white, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    long = white.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return long.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
