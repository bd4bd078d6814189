import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components, scale=64, offset=1_000_000):
    """Exact sums in Python's integers, then a dense solver."""
    held = [(key, [math.floor(scale * float(np.float32(c))) + offset for c in vector]) for key, vector, *_ in rows if vector is not None and all(c is not None and math.isfinite(c) for c in vector)]
    size = max(len(x) for _, x in held)
    held = [(key, x + [offset] * (size - len(x))) for key, x in held]
    n = len(held)
    sums = [sum(x[j] for _, x in held) for j in range(size)]
    apart = [[n * x[j] - sums[j] for j in range(size)] for _, x in held]
    deviation = [sum(a * a for a in row) for row in apart]
    centred = np.array(apart, dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [key for key, _ in held], deviation, values, (centred @ vectors) / np.sqrt(values), float((centred**2).sum() / n)


def checked(frame, rows, components, **settings):
    model = whitening.fit_whitening(frame, components, **settings)
    keys, deviation, values, whitened, trace = plain(rows, components)
    assert np.allclose(model.values, values, rtol=1e-10) and math.isclose(model.trace, trace, rel_tol=1e-12)
    assert model.residuals.max() <= whitening.TOLERANCE
    assert whitening.identity_error(model) < 1e-9
    got = np.zeros((len(keys), components))
    place = {key: i for i, key in enumerate(keys)}
    for row in whitening.whiten(model).collect():
        got[place[row.id], row.component - 1] = row.whitened
        assert row.deviation == deviation[place[row.id]]
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-6
    return model


def drawn(n, size, seed=0):
    draw = np.random.default_rng(seed)
    scales = 1.0 / np.sqrt(1 + np.arange(size))
    mixed = draw.normal(size=(n, size)) * scales @ np.linalg.qr(draw.normal(size=(size, size)))[0]
    return [(i, [float(c) for c in row], 0) for i, row in enumerate(mixed)]


@pytest.mark.parametrize("size, components", [(6, 6), (40, 8)])
def test_equals_a_dense_solver(spark, size, components):
    rows = drawn(500, size)
    checked(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, components, block_rows=64)


def test_restarts_and_locks_in_a_wide_space():
    draw = np.random.default_rng(4)
    basis = np.linalg.qr(draw.normal(size=(300, 300)))[0]
    truth = np.concatenate([np.linspace(10, 2, 12), [1.9, 1.9 - 1e-4], np.linspace(1.5, 0, 286)])
    matrix = (basis * truth) @ basis.T
    calls = []

    def multiply(block):
        calls.append(block.shape[1])
        return matrix @ block

    values, vectors, residuals = whitening.leading_pairs(multiply, 300, 14)
    assert np.allclose(values, truth[:14], rtol=1e-11) and residuals.max() <= whitening.TOLERANCE
    assert np.abs(vectors.T @ vectors - np.eye(14)).max() < 1e-12
    # Passes over the rows, not products of single vectors.
    assert len(calls) < 150


def test_minres_solves_every_column():
    draw = np.random.default_rng(6)
    half = draw.normal(size=(20, 20))
    matrix = half + half.T
    right = draw.normal(size=(20, 3))
    shifts = np.array([0.0, 1.5, -2.0])
    found = whitening._minres(lambda block: matrix @ block - shifts * block, right, 60, 1e-12)
    for j, shift in enumerate(shifts):
        assert np.allclose((matrix - shift * np.eye(20)) @ found[:, j], right[:, j], atol=1e-7)


def test_nulls_non_finite_ragged_null_ids_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*drawn(60, 4), (100, None, 0), (101, [None, 1.0, 1.0, 1.0], 0), (102, [nan, 1.0, 1.0, 1.0], 0), (103, [inf, 0.0, 0.0, 0.0], 0), (104, [0.5], 0), (105, [], 0)]
    frame = spark.createDataFrame([(*row, 1, "c") for row in rows], f"{SCHEMA}, component int, whitened string")
    checked(frame, rows, 3)
    model = whitening.fit_whitening(spark.createDataFrame([*rows, (None, [1.0, 1.0, 1.0, 1.0], 0), (3, [1.0, 0.0, 0.0, 0.0], 0)], SCHEMA), 2)
    held = [row.id for row in whitening.whiten(model).where("component = 1").collect()]
    assert held.count(None) == 1 and held.count(3) == 2 and len(held) == 64


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)], [(1, [], 0)]])
def test_without_variance_there_are_no_components(spark, rows):
    model = whitening.fit_whitening(spark.createDataFrame(rows, SCHEMA))
    assert model.components == 0 and whitening.whiten(model).count() == 0 and whitening.identity_error(model) == 0.0


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)]
    model = whitening.fit_whitening(spark.createDataFrame(rows, SCHEMA), 3)
    assert model.components == 1 and math.isclose(model.values[0] / model.trace, 1.0, rel_tol=1e-12)


def test_deviations_beyond_doubles_are_exact(spark):
    rows = [(i, [1e6 * i, 3.0], 0) for i in range(5)]
    model = whitening.fit_whitening(spark.createDataFrame(rows, SCHEMA), 1)
    _, deviation, *_ = plain(rows, 1)
    assert [row.deviation for row in whitening.whiten(model).orderBy("id").collect()] == deviation
