"""Whitening of embeddings with covariances by polarisation (operator 13).

Every entry c becomes the whole number floor(256 c). The fit list holds each distinct vector once. For every dimension i and
every pair i < j one number is aggregated over the fit list: the sum of the centred value's square, and of the square
of the pair's sum. All of them are exact. With q_i = floor(S_i / n), r_i = S_i - n q_i and y = x - q the tasks add whole y**2 and (y_i + y_j)**2;
since the y_i add up to r_i, the sum of (n x_i - S_i)**2 is n**2 times that of y_i**2 less n r_i**2, and alike for pairs. Cross-covariances
follow from differences of variances: 2 cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j), subtracted as whole numbers and divided once.
The matrix (dimensions squared, whatever the number of rows) goes to ``eigh`` on the driver; the rows are projected in tasks.

The fit list is written once. Sums leave a task as one row per dimension or pair, in parts of 31 bits, so that no size of
input overflows. The covariance of the whitened fit list is measured in a pass of its own.

Defined results: vectors that are null or hold null or non-finite entries are dropped; shorter vectors count as filled up with zeros
to the longest (the empty vector is all zeros); equal vectors fit once and are all returned, null ids included; entries
beyond 64 bits are cut to the least or greatest long by Spark's floor; ``deviation`` is null where it does not fit a long; a component without
variance (eigenvalue not above rounding of the trace) has null ``whitened`` and an ``identity_error`` of the others only (0 without any);
``explained`` is null where nothing varies; extra columns are ignored; an empty table, or one of empty
vectors alone (no component), gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut_lineage, map_rows

COMPONENTS = 4
BATCH_BYTES = 4_000_000
#: Absolute entries up to which sums of one batch stay within 64 bits.
SMALL = 1 << 20
PARTS, MASK = 6, (1 << 31) - 1
PART_NAMES = [f"part{k}" for k in range(PARTS)]
#: An eigenvalue up to this share of the trace is rounding.
ROUNDING = 1e-13


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of the rows whose vector is complete and finite."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = embeddings.filter(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(F.lit(256.0) * c)).alias("x"))


def padded(x: Column, dimensions: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(x)))


def matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, dimensions)


def exact_rows(keys: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
    """Whole sums of up to 186 bits in PARTS parts of 31 bits, the last with the sign."""
    parts = [pa.array([int(s) >> (31 * k) & MASK if k < PARTS - 1 else int(s) >> (31 * k) for s in sums], pa.int64()) for k in range(PARTS)]
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), *parts], ["i", "j", *PART_NAMES])


def added(rows: DataFrame) -> list[tuple[int, int, int]]:
    """The rows of ``exact_rows`` added up, one per dimension or pair (a part overflows only beyond 2**32 tasks)."""
    totals = rows.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in PART_NAMES]).collect()  # dimensions squared
    return [(r["i"], r["j"], sum(r[p] << (31 * k) for k, p in enumerate(PART_NAMES))) for r in totals]


def task_sums(fit: DataFrame, dimensions: int, of_batch) -> list:
    """Sums over the fit list of a function from (rows of whole vectors) to (i, j, exact sums), added up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total = None, None
        for batch in batches:
            step = max(1, BATCH_BYTES // (8 * max(dimensions, 1)))
            x = matrix(batch.column(0), dimensions)
            for start in range(0, len(x), step):
                i, j, sums = of_batch(x[start : start + step])
                keys, total = (i, j), sums.astype(object) if total is None else total + sums
        if keys is not None:
            yield exact_rows(list(keys), total)

    return added(fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{p} long" for p in PART_NAMES)))


def totals(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """n and the sums per dimension of the fit list."""
    each = np.arange(-1, dimensions, dtype=np.int32)  # -1: the number of rows

    def of_batch(x: np.ndarray):
        sums = x.sum(0) if np.abs(x, dtype=np.float64).max(initial=0) < SMALL else x.astype(object).sum(0)
        return each, each, np.array([len(x), *sums], object)

    found = {i: s for i, _, s in task_sums(fit, dimensions, of_batch)}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimensions)]


def squares(fit: DataFrame, dimensions: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of y_i**2 at (i, i) and of (y_i + y_j)**2 at (i, j), with y = x - centre."""
    first, second = (k.astype(np.int32) for k in np.triu_indices(dimensions))

    def of_batch(x: np.ndarray):
        y = x.astype(object) - np.array(centre, object)
        if np.abs(y.astype(np.float64)).max(initial=0) < SMALL:
            y = y.astype(np.int64)
        parts = []
        for i in range(dimensions):
            pair = y[:, i : i + 1] + y[:, i:]
            pair[:, 0] = y[:, i]
            parts.append((pair * pair).sum(0).astype(object))
        return first, second, np.concatenate(parts) if parts else np.zeros(0, object)

    return {(i, j): s for i, j, s in task_sums(fit, dimensions, of_batch)}


def covariance(n: int, sums: list[int], square: dict[tuple[int, int], int]) -> np.ndarray:
    """The matrix from exact variances (times n**3), by polarisation."""
    d = len(sums)
    rest = [s - n * (s // n) for s in sums]
    out = np.zeros((d, d))
    single = [n * n * square[i, i] - n * rest[i] ** 2 for i in range(d)]
    for i in range(d):
        out[i, i] = single[i] / n**3
        for j in range(i + 1, d):
            both = n * n * square[i, j] - n * (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - single[i] - single[j]) / (2 * n**3)
    return out


@dataclass
class Basis:
    """What the tasks need: n, sums, unit vectors (one row per component), eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    @property
    def varies(self) -> np.ndarray:
        return self.values > 0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component; those without variance are 0."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        return ((x - mean) @ self.vectors.T) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        largest = max(float(np.abs(x, dtype=np.float64).max(initial=0)), *(abs(s) / self.n for s in self.sums), 0.0)
        if (2 * largest * self.n) ** 2 * max(x.shape[1], 1) < 2.0**62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [None if v >= 2**63 else int(v) for v in (d * d).sum(1)]


def basis(n: int, sums: list[int], matrix_: np.ndarray, components: int) -> Basis:
    values, vectors = np.linalg.eigh(matrix_)
    falling = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(matrix_))
    top = np.where(values[falling] > ROUNDING * trace, values[falling], 0.0)
    return Basis(n, sums, np.ascontiguousarray(vectors[:, falling].T), top, [float(v) / trace if trace > 0 else None for v in top])


def identity_error(fit: DataFrame, base: Basis) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    count = len(base.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count + 1))
        for batch in batches:
            w = base.whitened(matrix(batch.column(0), len(base.sums)))
            total += np.column_stack([w.T @ w, w.sum(0)])
        i, j = (k.ravel().astype(np.int32) for k in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((count, count + 1))
    for row in fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # components squared
        total[row["i"], row["j"]] = row["s"]
    mean = total[:, -1] / base.n
    error = np.abs(total[:, :-1] / base.n - np.outer(mean, mean) - np.eye(count))[np.ix_(base.varies, base.varies)]
    return float(error.max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every complete row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(embeddings)
    dimensions = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if not dimensions:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("x", padded(F.col("x"), dimensions))
    fit = cut_lineage(rows.select("x").distinct())
    n, sums = totals(fit, dimensions)
    square = squares(fit, dimensions, [s // n for s in sums])
    base = basis(n, sums, covariance(n, sums, square), components)
    error = identity_error(fit, base)
    count = len(base.values)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(1), dimensions)
            size = len(x)
            each = np.repeat(np.arange(size), count)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()),
                pa.array(np.full(size * count, n), pa.int64()),
                pa.array(base.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(base.whitened(x).ravel(), mask=np.tile(~base.varies, size)),
                pa.array(base.explained * size, pa.float64()),
                pa.array(np.full(size * count, error)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return step

    return map_rows(rows, make, schema, BATCH_BYTES)
