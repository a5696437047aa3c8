"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR factor.

Each task folds its centred rows, block by block, into an upper triangle (QR of the triangle so far on top of the block);
triangles are folded in a tree of small groups, so what meets in one place has a size set by the dimension alone. Plane
rotations then orthogonalise the columns of the last triangle: their accumulated product holds the components, the
columns' norms give the standard deviations without squaring the condition, as a covariance matrix would.

Rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are vectors of another length
than most have (ties: the longer): they lie in another space. Equal vectors count once in the fit and all are projected.
Directions without variance have no component. Without any row, or any variance, the result is empty. Other columns go
through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Triangles folded by one task of the tree.
FAN = 16
#: Rows folded into a triangle at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors with `sums` by dimension; column k of `components` has the standard deviation `deviations[k]`.

    `total` is the trace of the covariance; `error` the largest entry by which the covariance of the whitened fitted
    vectors differs from the identity, measured over them.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    total: float
    error: float = 0.0


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as long; null where the vector is null, empty, or holds a null or non-finite entry."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when((F.size(vector) > 0) & usable, F.transform(vector, lambda c: F.floor(scale * c.cast("double")).cast("long")))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose integer `vector` isn't null and has the length that most such rows have."""
    found = df.where(F.col(vector).isNotNull())
    lengths = found.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return found.where(F.size(vector) == F.lit(most)) if most is not None else found


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list array without nulls, all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _each(df: DataFrame, vector: str, start, fold, end, schema: str) -> DataFrame:
    """One row for each task that has rows: end(state) of fold(state, matrix) over its batches."""
    common.ship(df.sparkSession)

    def run(batches):
        state, seen = start, False
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                state, seen = fold(state, _matrix(batch.column(0).slice(k, BLOCK))), True
        if seen:
            yield end(state)

    return df.select(vector).mapInArrow(run, schema)


def _totals(df: DataFrame, vector: str, kind: str, of=lambda m: m) -> tuple[int, list]:
    """Count and sums by dimension of the matrix rows that `of` gives; tasks sum first, Spark sums the tasks' rows."""

    def fold(state, m):
        m = of(m)
        return (state[0] + len(m), (state[1] + m.sum(0))) if state else (len(m), m.sum(0))

    def end(state):
        return pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1].tolist()])], names=["n", "sums"])

    parts = _each(df, vector, None, fold, end, f"n long, sums array<{kind}>").select("n", F.posexplode("sums").alias("k", "s"))
    wide = F.col("s").cast("decimal(38,0)") if kind == "long" else F.col("s")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(wide).alias("s")).orderBy("k").collect()  # a row for each dimension
    return (rows[0]["n"] if rows else 0), [int(r["s"]) if kind == "long" else r["s"] for r in rows]


def centred(matrix: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from the exact integer n * x - sums where that fits."""
    if float(np.abs(matrix).max(initial=0)) * n < 2.0**62:
        return (n * matrix - sums.astype(np.int64)) / n
    return matrix - np.array([float(s / n) for s in map(Decimal, sums.tolist())])


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of rows = Q R, square."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.concatenate([rows, np.zeros((d - len(rows), d))])
    return np.linalg.qr(rows, mode="r")


def triangle(df: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows, by a tree of blocks."""
    exact, d = np.array(sums, dtype=object), len(sums)

    def fold(r, m):
        rows = centred(m, n, exact)
        return _triangle(rows if r is None else np.concatenate([r, rows]))

    def end(r):
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.ravel().tolist()])], names=["block", "r"])

    def merged(table: pa.Table) -> pa.Table:
        r = None
        for flat in table["r"].to_pylist():
            m = np.array(flat).reshape(d, d)
            r = m if r is None else _triangle(np.concatenate([r, m]))
        return pa.table({"block": pa.array([table["block"][0].as_py() // FAN]), "r": pa.array([r.ravel().tolist()])})

    parts = common.stage(_each(df, vector, None, fold, end, "block long, r array<double>"), "triangles")
    most = parts.agg(F.max("block")).first()[0]
    while most:  # of the numbers of the triangles left
        parts, most = parts.groupBy(F.expr(f"block div {FAN}").alias("group")).applyInArrow(merged, "block long, r array<double>"), most // FAN
    return np.array(parts.first()["r"]).reshape(d, d)


def rounds(d: int):
    """Pairs of d columns, in rounds of disjoint pairs that meet every two columns once: one stays, the others rotate."""
    seats = [*range(d), *([-1] if d % 2 else [])]
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if a >= 0 and b >= 0]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(v, norms): orthogonal v so that the columns of r v are orthogonal with these norms, largest first.

    Rotates disjoint pairs of columns together until every two are orthogonal to rounding.
    """
    a, v = r.astype(float), np.eye(r.shape[1])
    scale = np.abs(a).max(initial=0.0)
    if scale:
        a = a / scale
    tiny = np.finfo(float).eps * max(1, len(a)) ** 0.5
    for _ in range(sweeps if scale else 0):
        worst = 0.0
        for p, q in rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            apart = np.abs(gamma) / np.maximum(np.sqrt(alpha * beta), np.finfo(float).tiny)
            turn = apart > tiny
            if not turn.any():
                continue
            worst = max(worst, float(apart.max()))
            p, q, x, y, alpha, beta, gamma = p[turn], q[turn], x[:, turn], y[:, turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not worst:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * sign, norms[order] * scale


def fit(df: DataFrame, vector: str, k: int | None = None) -> Whitening | None:
    """The whitening of the distinct integer vectors of `df`, with the first k components; None without a vector.

    Distinct vectors are written once; three passes read them: sums, triangle and the covariance of what is whitened.
    """
    listed = common.stage(df.select(F.col(vector).alias("x")).where("x IS NOT NULL").distinct(), "vectors")
    n, sums = _totals(listed, "x", "long")
    if not n:
        return None
    v, norms = jacobi(triangle(listed, "x", n, sums))
    total = float((norms * norms).sum()) / n
    there = norms > norms.max(initial=0.0) * np.finfo(float).eps * max(n, len(norms)) ** 0.5
    kept = slice(0, min(int(there.sum()), k or len(norms)))
    model = Whitening(n, tuple(sums), v[:, kept], norms[kept] / n**0.5, total)
    return Whitening(n, model.sums, model.components, model.deviations, total, _identity_error(listed, model))


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors (divisor n, centred first) minus the identity."""
    k = len(model.deviations)
    if not k:
        return 0.0
    means = np.array(_totals(listed, "x", "double", lambda m: whitened(m, model))[1]) / model.n

    def products(m):
        w = whitened(m, model) - means
        return (w.T @ w).reshape(1, -1)

    sums = _totals(listed, "x", "double", products)[1]
    return float(np.abs(np.array(sums).reshape(k, k) / model.n - np.eye(k)).max())


def whitened(matrix: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(matrix, model.n, np.array(model.sums, dtype=object)) @ model.components / model.deviations


def deviations(matrix: np.ndarray, model: Whitening) -> list[Decimal | None]:
    """Sum over dimensions of (n * x - sums) squared, exact, of each row; null from 10 ** 38 on."""
    sums, n = np.array(model.sums, dtype=object), model.n
    if (float(np.abs(matrix).max(initial=0)) * n + max(map(abs, map(float, model.sums)))) ** 2 * matrix.shape[1] < 2.0**63:
        apart = n * matrix - sums.astype(np.int64)
        return [Decimal(x) for x in (apart * apart).sum(1).tolist()]
    apart = n * matrix.astype(object) - sums
    return [Decimal(s) if (s := sum(x * x for x in row)) < 10**38 else None for row in apart.tolist()]


def transform(df: DataFrame, vector: str, model: Whitening, white: str = "white", deviation: str = "deviation") -> DataFrame:
    """Adds `white` (array<double>, an entry for each component) and `deviation` (decimal(38,0)); no null vectors allowed.

    Neither name may be a column of `df` already: common.fresh gives one that isn't.
    """

    def make():
        def run(batch):
            m = _matrix(batch.column(batch.schema.get_field_index(vector)))
            w = whitened(m, model) if len(m) else np.empty((0, len(model.deviations)))
            return [pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(deviations(m, model) if len(m) else [], pa.decimal128(38, 0))]

        return run

    return common.map_arrow(df, make, [common.field(white, "array<double>"), common.field(deviation, "decimal(38,0)")])
