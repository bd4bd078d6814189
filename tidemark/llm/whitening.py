"""Embedding whitening by a block Jacobi-Davidson method.

The leading eigenvectors of the covariance are found without the covariance:
every product with it is one pass over the rows, each centred before it is
multiplied. A search space grows by corrections: for every wanted Ritz pair
(theta, u) with residual r = V u - theta u that has not settled, MINRES solves

    (I - Q Q') (V - theta I) (I - Q Q') t = -r,     Q: the pairs locked and sought,

and all pairs take their inner steps together, so that one pass serves them all.
The corrections are made orthogonal and join the space; Rayleigh-Ritz there
gives the next pairs, and those whose residual is at the rounding of doubles are
locked. A full space is restarted from its best vectors.

Components are whole numbers, so the sums, the centre and the deviations are
exact: (n x - S) is a whole number, and only its quotient by n is rounded. Each
task adds up its own rows; the partial products, of dimension by block, are
added in a second stage, and the driver receives at most ``_SUMS`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

COMPONENTS = 32
#: Rows stored together.
BLOCK_ROWS = 4096
#: Vectors of the search space beside the wanted ones at the start.
_SPARE = 8
_INNER = 12
_OUTER = 80
#: Sums of a pass that come to the driver.
_SUMS = 8
#: A residual below this share of the largest eigenvalue is rounding.
TOLERANCE = 1e-13


def whole_rows(frame: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """Rows (id, x): floor(scale * entry) + offset as longs; vectors that are null
    or hold null or non-finite entries are left out."""
    rows = frame.select(frame[id_col].alias("id"), frame[vector_col].cast("array<double>").alias("v")).where("v IS NOT NULL")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select("id", F.transform("v", lambda c: F.floor(c * float(scale)).cast("long") + F.lit(offset).cast("long")).alias("x"))


def _packed(size: int, filler: int, rows: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                lists = piece.column("x")
                lengths = np.diff(lists.offsets.to_numpy())
                x = np.full((piece.num_rows, size), filler, dtype=np.int64)
                x[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy()
                ids = pa.array([piece.column("id").to_pylist()], pa.list_(id_type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return run


@dataclass(frozen=True)
class _Rows:
    """The fit list, packed, with its exact sums."""

    blocks: DataFrame
    size: int
    n: int
    sums: np.ndarray


def _matrix(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, size)


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as whole numbers. It is formed around a near centre, so that it
    stays small whatever the offset; beyond 64 bits in Python's integers."""
    near = sums // n
    rest = sums - near * n
    off = x - near
    if len(off) and int(np.abs(off).max()) * n + n >= 1 << 62:
        return off.astype(object) * n - rest.astype(object)
    return off * n - rest


def _added(partials: DataFrame, kind: str) -> np.ndarray | None:
    """The sum of rows (data binary) of equal shape, in two stages."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                own = np.frombuffer(data, dtype=kind)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    rows = partials.repartition(_SUMS).mapInArrow(add, "data binary").collect()
    parts = [np.frombuffer(row.data, dtype=kind) for row in rows]
    return np.sum(parts, axis=0) if parts else None


def _load(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int, block_rows: int) -> _Rows:
    rows = whole_rows(vectors, id_col, vector_col, scale, offset)
    held = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size")).collect()[0]
    size = held["size"] or 0
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    id_type = rows.schema["id"].dataType.simpleString()
    if id_type not in kinds:
        rows, id_type = rows.withColumn("id", F.col("id").cast("string")), "string"
    blocks = cut_lineage(rows.mapInArrow(_packed(size, offset, block_rows, kinds[id_type]), f"ids array<{id_type}>, x binary"), "vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for data in batch.column("x").to_pylist():
                total += _matrix(data, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    total = _added(blocks.select("x").mapInArrow(sums, "data binary"), "int64") if size else None
    return _Rows(blocks, size, held.n, total if total is not None else np.zeros(size, dtype=np.int64))


def _product(rows: _Rows, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of vectors: one pass over the rows."""
    size, n, sums = rows.size, rows.n, rows.sums
    width = block.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for batch in batches:
            for data in batch.column("x").to_pylist():
                centred = _apart(_matrix(data, size), n, sums).astype(np.float64) / n
                total += centred.T @ (centred @ block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    added = _added(rows.blocks.select("x").mapInArrow(partial, "data binary"), "float64")
    return added.reshape(size, width) / n


def _without(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A block made orthogonal to an orthonormal basis, twice for rounding."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """MINRES for all columns at once: ``apply`` multiplies column j by its own
    symmetric matrix. Stops when every column's residual has shrunk to ``goal``."""
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(right), right / first
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, c = np.ones(len(beta)), np.ones(len(beta))
    s_old, s = np.zeros(len(beta)), np.zeros(len(beta))
    eta, beta = beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        product = apply(v) - beta * v_old
        alpha = (v * product).sum(axis=0)
        product = product - alpha * v
        grown = np.linalg.norm(product, axis=0)
        # Two rotations of the tridiagonal matrix's column.
        delta = c * alpha - c_old * s * beta
        gamma = np.hypot(delta, grown)
        rest = s * alpha + c_old * c * beta
        corner = s_old * beta
        live = (gamma > 1e-300) & (np.abs(eta) > goal * first)
        safe = np.where(gamma > 1e-300, gamma, 1.0)
        c_new, s_new = delta / safe, grown / safe
        w_new = (v - corner * w_old - rest * w) / safe
        x = x + np.where(live, c_new * eta, 0.0) * w_new
        eta = np.where(live, -s_new * eta, eta)
        if not (live & (np.abs(eta) > goal * first)).any():
            break
        v_old, v = v, product / np.where(grown > 1e-300, grown, 1.0)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, grown
    return x


def _basis(block: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Orthonormal vectors for what a block adds to an orthonormal basis."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    block = _without(block, held)
    kept: list[np.ndarray] = []
    for column in block.T:
        for _ in range(2):
            column = column - held @ (held.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        length = np.linalg.norm(column)
        if length > 1e-8 and held.shape[1] + len(kept) < len(column):
            kept.append(column / length)
    return np.array(kept).T if kept else np.zeros((len(held), 0))


def leading_pairs(multiply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive matrix given by its
    products with blocks, their unit eigenvectors, and their residuals relative
    to the largest. Raises where the residuals do not reach the tolerance."""
    wanted = min(wanted, size)
    start = np.random.default_rng(seed).standard_normal((size, min(size, wanted + _SPARE)))
    space = _basis(start, np.zeros((size, 0)))
    image = multiply(space)
    most = min(size, max(3 * wanted + _SPARE, wanted + 2 * _SPARE))
    locked = np.zeros((size, 0))
    values = np.zeros(0)
    settled = np.zeros(0)
    for _ in range(_OUTER):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        sought = wanted - locked.shape[1]
        vectors, images, theta = space @ turn[:, :sought], image @ turn[:, :sought], ritz[:sought]
        residual = images - theta * vectors
        top = max(float(values[0]) if len(values) else 0.0, float(theta[0]) if len(theta) else 0.0, 1e-300)
        size_of = np.linalg.norm(residual, axis=0) / top
        # Locked in order: a pair waits for the larger ones.
        done = int(np.argmin(np.append(size_of <= tolerance, False)))
        if done:
            locked = np.hstack([locked, vectors[:, :done]])
            values, settled = np.append(values, theta[:done]), np.append(settled, size_of[:done])
            space, image = space @ turn[:, done:], image @ turn[:, done:]
            vectors, theta, residual = vectors[:, done:], theta[done:], residual[:, done:]
            ritz = ritz[done:]
            turn = np.eye(space.shape[1])
        if locked.shape[1] == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order], settled[order]
        kept = np.hstack([locked, vectors])
        open_ = np.linalg.norm(residual, axis=0) > tolerance * top

        def corrected(block: np.ndarray, kept: np.ndarray = kept, theta: np.ndarray = theta[open_]) -> np.ndarray:
            block = _without(block, kept)
            return _without(multiply(block) - theta * block, kept)

        step = _minres(corrected, -_without(residual[:, open_], kept), _INNER, 1e-3)
        if locked.shape[1] + space.shape[1] + step.shape[1] > most and space.shape[1] > vectors.shape[1] + _SPARE and locked.shape[1] + space.shape[1] < size:
            few = vectors.shape[1] + _SPARE
            space, image = space @ turn[:, :few], image @ turn[:, :few]
        grown = _basis(step, np.hstack([locked, space]))
        if not grown.shape[1]:
            # The corrections add nothing: refresh the images, which rounding has worn.
            space = _basis(space, locked)
            image = _without(multiply(space), locked)
            continue
        space = np.hstack([space, grown])
        image = np.hstack([image, multiply(grown)])
    raise RuntimeError("The residuals did not reach the tolerance.")


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; ``rows`` is the list it was fitted on."""

    rows: _Rows
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float

    @property
    def components(self) -> int:
        return len(self.values)


def _trace(rows: _Rows) -> float:
    size, n, sums = rows.size, rows.n, rows.sums

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for data in batch.column("x").to_pylist():
                total += float(((_apart(_matrix(data, size), n, sums).astype(np.float64) / n) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.array([total]).tobytes()], pa.binary())], names=["data"])

    added = _added(rows.blocks.select("x").mapInArrow(partial, "data binary"), "float64")
    return float(added[0]) / n


def fit_whitening(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, block_rows: int = BLOCK_ROWS
) -> Whitening:
    """The ``components`` largest eigenpairs of the covariance of all vectors.

    Entries are floor(``scale`` * entry) + ``offset``. Vectors that are null or
    hold null or non-finite entries are left out; shorter ones than the longest
    are filled up with zeros. Rows with a null or repeated id are rows like any
    other. Components without variance, as of one row or of equal rows, do not
    exist: there are then fewer, or none.
    """
    rows = _load(vectors, id_col, vector_col, scale, offset, block_rows)
    if not rows.n or not rows.size:
        return Whitening(rows, np.zeros(0), np.zeros((rows.size, 0)), np.zeros(0), 0.0)
    trace = _trace(rows)
    if trace <= 0:
        return Whitening(rows, np.zeros(0), np.zeros((rows.size, 0)), np.zeros(0), trace)
    values, found, residuals = leading_pairs(lambda block: _product(rows, block), rows.size, components)
    real = values > rows.size * np.finfo(np.float64).eps * 16 * values[0]
    return Whitening(rows, values[real], found[:, real], residuals[real], trace)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    rows = model.rows
    centred = _apart(x, rows.n, rows.sums).astype(np.float64) / rows.n
    return (centred @ model.vectors) / np.sqrt(model.values)


def _bare(model: Whitening) -> Whitening:
    """The model as tasks need it: without the frame."""
    return Whitening(_Rows(None, model.rows.size, model.rows.n, model.rows.sums), model.values, model.vectors, model.residuals, model.trace)  # type: ignore[arg-type]


def identity_error(model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity,
    measured on the rows themselves."""
    own, k = _bare(model), model.components
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for data in batch.column("x").to_pylist():
                z = _whitened(own, _matrix(data, own.rows.size))
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    added = _added(model.rows.blocks.select("x").mapInArrow(partial, "data binary"), "float64").reshape(k + 1, k) / model.rows.n
    return float(np.abs(added[:k] - np.outer(added[k], added[k]) - np.eye(k)).max())


def whiten(model: Whitening) -> DataFrame:
    """One row per row of the fit list and component: id, component (from 1),
    deviation (the exact sum over dimensions of (n x - S)^2) and whitened (the
    centred row projected on the component, over the root of its eigenvalue).
    A deviation past 64 bits raises an error."""
    own, k = _bare(model), model.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            for ids, data in zip(batch.column("ids"), batch.column("x").to_pylist(), strict=True):
                x = _matrix(data, own.rows.size)
                apart = _apart(x, own.rows.n, own.rows.sums)
                if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * own.rows.size >= 1 << 63:
                    apart = apart.astype(object)
                deviation = pa.array(np.repeat((apart * apart).sum(axis=1), k).tolist(), pa.int64())
                at = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [ids.values.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation, pa.array(_whitened(own, x).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened"])

    id_type = model.rows.blocks.schema["ids"].dataType.elementType.simpleString()
    return model.rows.blocks.mapInArrow(run, f"id {id_type}, component int, deviation long, whitened double")
