"""Whitening of embeddings by eigenvectors that are refined in mixed precision.

Entries become integers x = floor(``SCALE`` c) + ``SHIFT``. The covariance is that of the different vectors x, each counted once,
centred at their mean before anything is multiplied; tasks add up its rows, and dimension x dimension numbers reach the driver. There a float32
decomposition gives approximate eigenvectors, which the iteration of Ogita and Aishima corrects by matrix products alone: with R = I - X'X and
S = X'VX, taken in the longest float type, eigenvalues are S_ii / (1 - R_ii), and X is replaced by X + X E, where
E_ij = (S_ij + e_j R_ij) / (e_j - e_i). The error is squared at each step as long as eigenvalues are well apart. Those that are closer than the error
of S allows to tell (clusters) get E_ij = R_ij / 2, which keeps them orthogonal; then the part of V inside a cluster, less its mean eigenvalue, is decomposed by
itself, where its small gaps are large, and the cluster's vectors are turned accordingly.

Components are numbered by falling eigenvalue, ``COMPONENTS`` at most; directions without variance (below ``FLAT`` of the largest) are no components.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are left out, and so are vectors of another length than the most
frequent one (of equally frequent ones, the longest); entries beyond 2^52 are taken as that; a deviation that 64 bits do not hold is null; fewer than
two different vectors have no component and give an empty result; repeated rows stay as many rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut

SCALE, SHIFT, COMPONENTS, FLAT = 64, 1_000_000, 16, 1e-12
MOST = float(1 << 52)
ROWS = 1 << 12  # vectors that a task multiplies at once


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, length, x): the usable rows of a list column, the length of each one's vector, and all their entries in turn as integers."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    value = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(value)))
    end = np.cumsum(size)
    good = (size > 0) & (bad[end] == bad[end - size])
    value = value[np.repeat(good, size)]
    x = np.floor(np.clip(SCALE * value, -MOST, MOST)).astype(np.int64) + SHIFT
    return np.flatnonzero(good), size[good], x


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id_, size, x): x holds the little-endian 64-bit integers of a vector, so that equal vectors are equal bytes."""
    rows = df.select(F.col(vec_id).alias("id_"), F.col(embedding).alias("v")).where("v is not null")
    schema = T.StructType([rows.schema["id_"], T.StructField("size", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, x = whole_numbers(batch.column("v"))
            off = np.append(0, np.cumsum(size * 8))
            if off[-1] >= 1 << 31:
                raise ValueError("a batch of vectors exceeds 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column("id_").take(pa.array(row)), pa.array(size.astype(np.int32)), data], schema.names)

    return rows.mapInArrow(turn, schema)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a binary column as rows of integers."""
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int64, count=(off[-1] - off[0]) // 8, offset=int(off[0])).reshape(-1, d) if len(column) else np.zeros((0, d), np.int64)


def totals(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of vectors and their exact sum; each task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), d)
            n += len(x)
            high += (x >> 32).sum(0)  # in halves, so that no sum leaves 64 bits
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    found = rows.select("x").mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    own = {r.i: r for r in found.collect()}  # d rows
    return int(own[0].n), np.array([(int(own[i].high) << 32) + int(own[i].low) for i in range(d)], object)


def products(rows: DataFrame, vectors, d: int, k: int) -> np.ndarray:
    """The sum of z z' over all rows, z (k numbers) being ``vectors()`` of a block of x; a task gives its sum once, row by row."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = np.zeros((k, k)), vectors()
        for batch in batches:
            x = matrix(batch.column("x"), d)
            for at in range(0, len(x), ROWS):
                z = of(x[at : at + ROWS])
                held += z.T @ z
        listed = pa.ListArray.from_arrays(np.arange(0, k * k + 1, k, dtype=np.int32), pa.array(held.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), listed], ["i", "row"])

    held = rows.select("x").mapInArrow(multiply, "i int, row array<double>")
    found = held.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # k x k numbers
    out = np.zeros((k, k))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


# --- eigenvectors -----------------------------------------------------------------------------------------------------


def clusters(e: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of at least two eigenvalues, ascending, of which neighbours are no more than ``apart`` from each other."""
    border = np.flatnonzero(np.append(True, np.diff(e) > apart))
    return [np.arange(a, b) for a, b in zip(border, np.append(border[1:], len(e))) if b - a > 1]


def refined(v: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors (columns) of a symmetric matrix, from a float32 decomposition."""
    size = np.abs(v).max(initial=0) or 1.0
    high = (v / size).astype(np.longdouble)
    eye = np.eye(len(v), dtype=np.longdouble)
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble)
    norm = float(np.linalg.norm(high.astype(float), 2))
    least = 8 * len(v) * np.finfo(np.longdouble).eps  # what rounding leaves of R and of S beside its diagonal
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ (high @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # so that E corrects R whatever the gaps
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(e, kind="stable")
        x, e, r, s = x[:, order], e[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(np.diag(s))
        if max(np.abs(off).max(initial=0), np.abs(r).max(initial=0)) <= least:
            break
        apart = 2 * float(np.linalg.norm((s - np.diag(e)).astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > apart
        x = x + x @ np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
        for group in clusters(e.astype(float), apart):
            own = x[:, group]
            middle = e[group].mean()
            # The cluster's part of V less its mean eigenvalue, scaled so that its small gaps are resolved.
            inner = own.T @ (high @ own - middle * own)
            inner = (inner + inner.T) / 2
            scale = np.abs(inner).max() or 1
            turn = np.linalg.eigh((inner / scale).astype(float))[1].astype(np.longdouble)
            x[:, group] = own @ turn
    x = x / np.sqrt((x * x).sum(0))
    e = ((high @ x) * x).sum(0)
    order = np.argsort(e, kind="stable")
    return (e[order] * size).astype(float), x[:, order].astype(float)


# --- the operator -----------------------------------------------------------------------------------------------------


def centred(sums: np.ndarray, n: int):
    """A function from integer vectors to their difference from the mean: the mean's whole part goes first, exactly."""
    base = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) % n / n for s in sums])
    return lambda x: (x - base) - rest


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """The sum over dimensions of (n x - S)^2, exactly; null where 64 bits do not hold it."""
    base = np.array([int(s) // n for s in sums], np.int64)
    most = int(max(np.abs(x - base).max(initial=0) + 1, 1)) * n
    if most * most * x.shape[1] < 1 << 63:
        y = (x - base) * n - np.array([int(s) % n for s in sums], np.int64)
        return pa.array((y * y).sum(1))
    found = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    rows = cut(usable(df, vec_id, embedding))
    out = T.StructType([
        T.StructField(vec_id, df.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    lengths = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    empty = df.sparkSession.createDataFrame([], out)
    if lengths is None:
        return empty
    d = int(lengths["size"])
    rows = rows.where(F.col("size") == d)
    once = cut(rows.select("x").distinct())
    n, sums = totals(once, d)
    covariance = products(once, lambda: centred(sums, n), d, d) / n
    e, x = refined((covariance + covariance.T) / 2)
    e, x = e[::-1], x[:, ::-1]
    k = int(min(components, d, (e > FLAT * max(e[0], 1e-300)).sum())) if e[0] > 0 else 0
    if k == 0:
        return empty
    turn = x[:, :k] / np.sqrt(e[:k])
    # The whitened vectors' own covariance, measured on the data.
    measured = products(once, lambda: (lambda of: lambda y: of(y) @ turn)(centred(sums, n)), d, k) / n
    error = float(np.abs(measured - np.eye(k)).max())
    explained = e[:k] / np.trace(covariance)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = centred(sums, n)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                y = matrix(batch.column("x"), d)
                repeat = pa.array(np.repeat(np.arange(len(batch)), k))
                size = len(repeat)
                columns = [
                    batch.column("id_").take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(size, n)),
                    deviations(y, sums, n).take(repeat), pa.array((of(y) @ turn).ravel()), pa.array(np.tile(explained, len(batch))), pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.select("id_", "x").mapInArrow(project, out)
