"""Embedding whitening: leading principal components by matrix-free block subspace iteration.

Vectors become whole numbers on a fixed grid; the fit list holds each distinct one once and is written to the shared
folder. Each pass is one Spark job over that list: every task computes its part of Xᵀ(XQ) on centred rows in numpy,
and the parts are summed by dimension on executors, so the driver gets a d x block matrix, whatever the number of
rows or tasks. There it is brought to Ritz pairs (QR of the block, eigenpairs of QᵀVQ), and passes go on until the
residual |Vu - eu| of every wanted component is at most `tolerance` of the largest eigenvalue (or what rounding over n rows
allows). The covariance itself is never formed unless it has to be: where the residuals fall so slowly that more than
PATIENCE passes would be left, as with eigenvalues that lie close together, the block is doubled, up to the dimension d,
at which a pass is exact. Q travels with a job's code: d x block doubles, d^2 at most.

Differences from the mean are whole numbers (n x - S), exact whatever n is; sums S too. A last pass measures the whitened
rows' covariance. Order and partitioning change results by rounding only.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, so are those of another
length than most (of equally many lengths the greater one counts; vectors without entries have none); repeated rows each
give their rows, and count once in the fit; components whose eigenvalue is not above 1e-12 of the trace have no direction
of their own and are left out, so a table of one distinct vector, like an empty one, gives an empty result; the
deviation is null where it exceeds a long; grid values beyond a long are taken as its ends; columns of any other name
than the given two play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import in_arrow, materialize

#: Steps of the grid in one unit, and what is added to each.
GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Residual as a share of the largest eigenvalue, passes worth waiting for, passes after which there must be a result.
TOLERANCE, PATIENCE, MOST_PASSES = 1e-13, 4, 200
#: Rows that a task holds as a matrix at once.
ROWS = 8192
_SAFE = 1 << 62


def on_grid(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers, all of one length."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    step = lambda c: F.floor(F.least(F.greatest(c.cast("double") * GRID, F.lit(-9e18)), F.lit(9e18))).cast("long") + SHIFT
    usable = rows.where(v.isNotNull() & (F.size(v) > 0)).where(finite).select(F.col(vec_id).alias("vec_id"), F.transform(v, step).alias("x"))
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return usable.where(F.size("x") == (sizes[0].d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches, at: int):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            if part.num_rows:
                yield part, _matrix(part.column(at))


@dataclass(frozen=True)
class Centre:
    """n distinct vectors with sums S, as Python's whole numbers."""

    n: int
    sums: tuple[int, ...]

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs, or Python's whole numbers where these may not hold it."""
        base = [s // self.n for s in self.sums]
        rest = [s - b * self.n for s, b in zip(self.sums, base, strict=True)]
        far = int(max(abs(int(x.max()) - min(base)), abs(int(x.min()) - max(base)))) if x.size else 0
        if max(map(abs, base), default=0) < _SAFE and (far + 1) * self.n < _SAFE:
            return (x - np.array(base, np.int64)) * self.n - np.array(rest, np.int64)
        return (x.astype(object) - np.array(base, object)) * self.n - np.array(rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)


def _summed(fit: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(matrix of rows), an array of `width` columns. Tasks sum their rows, executors sum the tasks by row of the result."""
    names = [f"y{j}" for j in range(width)]

    def run(batches):
        total = None
        for _, x in _blocks(batches, 0):
            made = part(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["i", *names])

    out = in_arrow(fit, run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    return np.array([r[1:] for r in sorted(out.collect())], np.float64)


def _centre(fit: DataFrame) -> Centre | None:
    """Count and exact sums: a long is added up as its upper and lower half."""

    def run(batches):
        n, total = 0, None
        for _, x in _blocks(batches, 0):
            made = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
            n, total = n + len(x), made if total is None else total + made
        if total is not None:
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n, np.int64)), pa.array(total[0]), pa.array(total[1])], names=["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = in_arrow(fit, run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.i)
    return Centre(rows[0].n, tuple((int(r.high) << 32) + int(r.low) for r in rows))


@dataclass(frozen=True)
class Whitening:
    """A fit: components are the columns of `axes`, by falling eigenvalue."""

    centre: Centre
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.axes / np.sqrt(self.eigenvalues)


def subspace(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, n: int, trace: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(axes, eigenvalues, residuals, passes) of the k leading eigenpairs of V; product(Q) is VQ, one pass over the data."""
    random = np.random.default_rng(12)
    block = min(d, 2 * k)
    q = np.linalg.qr(random.standard_normal((d, block)))[0]
    bound, last, full = max(tolerance, np.finfo(float).eps * n**0.5), None, 0
    for passes in range(1, MOST_PASSES + 1):
        y = product(q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes = q @ turn
        residuals = np.linalg.norm(y @ turn - axes * values, axis=0)[:k]
        worst = residuals.max() / max(values[0], 1e-300)
        if worst <= bound or values[0] <= 1e-300:
            return axes[:, :k], values[:k], residuals, passes
        block = q.shape[1]
        if block < d:
            fall = worst / last if last else 1.0
            slow = last is not None and (fall >= 1.0 or np.log(bound / worst) / np.log(fall) > PATIENCE)
            last = worst
            basis = y @ turn
            if slow:  # more directions, fresh ones beside those found
                basis, last = np.hstack([basis, random.standard_normal((d, min(d, 2 * block) - block)) * values[block - 1]]), None
            q = np.linalg.qr(basis)[0]
        else:  # the whole space: only rounding is left
            full += 1
            if full > 3:
                break
            q = np.linalg.qr(axes)[0]
    raise RuntimeError(f"residual {worst:.3g} of the largest eigenvalue is above {bound:.3g}")


def fit(x: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fits k components on the distinct vectors of x (on_grid's); None where there is no direction to fit."""
    rows = materialize(x.select("x").distinct())
    centre = _centre(rows)
    if centre is None:
        return None
    d = len(centre.sums)
    trace = float(_summed(rows, 1, lambda m: np.square(centre.centred(m)).sum(keepdims=True).reshape(1, 1))[0, 0]) / centre.n

    def product(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = centre.centred(m)
            return c.T @ (c @ q)

        return _summed(rows, q.shape[1], part) / centre.n

    axes, values, residuals, passes = subspace(product, d, min(k, d), centre.n, trace)
    real = values > 1e-12 * trace
    if not real.any():
        return None
    axes, values, residuals = axes[:, real], values[real], residuals[real]
    bare = Whitening(centre, axes, values, trace, residuals, passes, 0.0)
    mean = _summed(rows, 1, lambda m: bare.whitened(m).sum(0)[:, None])[:, 0] / centre.n

    def spread(m: np.ndarray) -> np.ndarray:
        z = bare.whitened(m) - mean
        return z.T @ z

    error = float(np.abs(_summed(rows, len(values), spread) / centre.n - np.eye(len(values))).max())
    return Whitening(centre, axes, values, trace, residuals, passes, error)


def whiten(rows: DataFrame, k: int = COMPONENTS, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, whitened, deviation) of each usable row: an array of k doubles, and n^2 times its squared distance from the mean."""
    x = on_grid(rows, vec_id=vec_id, vector=vector)
    return apply(x, fit(x, k))


def apply(x: DataFrame, model: Whitening | None) -> DataFrame:
    """on_grid's rows by a fit."""
    kind = x.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for part, m in _blocks(batches, 1):
            far = model.centre.differences(m)
            if far.dtype != object and int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < _SAFE:
                deviation = pa.array(np.square(far).sum(1))
            else:
                deviation = pa.array([s if s < 1 << 63 else None for s in np.square(far.astype(object)).sum(1).tolist()], pa.int64())
            z = model.whitened(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, deviation], names=["vec_id", "whitened", "deviation"])

    schema = f"vec_id {kind}, whitened array<double>, deviation long"
    return x.sparkSession.createDataFrame([], schema) if model is None else in_arrow(x.select("vec_id", "x"), run, schema)


def report(rows: DataFrame, k: int = COMPONENTS, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: whitened value, share of the variance, and what certifies the fit."""
    x = on_grid(rows, vec_id=vec_id, vector=vector)
    model = fit(x, k)
    shares = [] if model is None else [(float(e / model.trace), float(r / model.eigenvalues[0])) for e, r in zip(model.eigenvalues, model.residuals, strict=True)]
    facts = F.array(*[F.struct(F.lit(e).alias("explained"), F.lit(r).alias("residual")) for e, r in shares]) if shares else F.expr("cast(array() as array<struct<explained: double, residual: double>>)")
    out = apply(x, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", facts.alias("f"))).alias("place", "z"))
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"), "deviation", F.col("z.whitened").alias("whitened"),
        F.col("z.f.explained").alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"), F.col("z.f.residual").alias("residual"),
    )
