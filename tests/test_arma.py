"""The regression with ARMA errors: known series, known coefficients, known answers."""

import numpy as np
import pytest

from tidemark.operators import arma


def simulated(ar, ma, n, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    e = scale * draw.normal(size=n + 200)
    u = np.zeros(n + 200)
    for t in range(len(u)):
        u[t] = e[t] + sum(w * u[t - k] for k, w in enumerate(ar, 1) if t >= k) + sum(w * e[t - k] for k, w in enumerate(ma, 1) if t >= k)
    return u[200:]


@pytest.mark.parametrize("ar, ma", [((0.7,), ()), ((0.6,), (0.4,)), ((0.5, 0.3), ()), ((), (0.5,)), ((0.9,), (-0.4,))])
def test_coefficients_of_a_simulated_series_come_back(ar, ma):
    u = np.stack([simulated(ar, ma, 4000, seed) for seed in range(4)])
    e = arma.innovations(u, arma.long_order(u.shape[1], 2))
    first = 40
    got = arma.fit_errors(u, e, range(1, len(ar) + 1), range(1, len(ma) + 1), first)
    assert got.ar == pytest.approx(np.tile(ar, (4, 1)), abs=0.08) and got.ma == pytest.approx(np.tile(ma, (4, 1)), abs=0.08)
    assert got.variance == pytest.approx(np.ones(4), abs=0.1)


def test_levinson_solves_the_normal_equations():
    u = np.stack([simulated((0.5, -0.3), (0.2,), 300, seed) for seed in range(3)])
    covariances = arma.autocovariances(u, 5)
    got = arma.levinson(covariances)
    for row, weights in zip(covariances, got, strict=True):
        matrix = np.array([[row[abs(i - j)] for j in range(5)] for i in range(5)])
        assert weights == pytest.approx(np.linalg.solve(matrix, row[1:]), abs=1e-10)


def test_the_forecast_of_an_autoregression_dies_out():
    u = np.array([[0.0, 1.0, 2.0, 4.0]])
    errors = arma.Errors((1,), (1,), np.array([[0.5]]), np.array([[0.25]]), np.ones(1), 3)
    e = arma.shocks(u, errors)
    assert e == pytest.approx(np.array([[0.0, 1.0, 1.25, 2.6875]]))
    path = arma.ahead(u, e, errors, 3)
    assert path == pytest.approx(np.array([[2.671875, 1.3359375, 0.66796875]]))


def test_an_exploding_part_is_drawn_in():
    u = np.array([1.3**np.arange(40.0)])
    fitted = arma.fit_errors(u, np.zeros_like(u), (1,), (), 5)
    assert fitted.ar[0, 0] == pytest.approx(arma.MOST_PERSISTENCE)


def test_a_moving_average_that_would_explode_is_drawn_in():
    draw = np.random.default_rng(9)
    e = draw.normal(size=(1, 60))
    u = e.copy()
    u[:, 1:] += 3.0 * e[:, :-1]
    fitted = arma.fit_errors(u, e, (1,), (1,), 4)
    assert fitted.ma[0, 0] == pytest.approx(arma.MOST_PERSISTENCE)
    assert np.abs(arma.shocks(u, fitted)).max() < 60 * np.abs(u).max()


def test_trend_season_and_drivers_are_followed():
    t = np.arange(72)
    season = 10 * np.cos(2 * np.pi * t / 12) + 4 * np.sin(4 * np.pi * t / 12)
    driver = np.random.default_rng(1).normal(size=72)
    y = np.stack([100 + 2.0 * t + season + 5 * driver, 50 - t + 2 * season - 3 * driver])
    drivers = np.stack([driver, driver])[:, :, None]
    got = arma.regression_batch(y[:, :60], 12, True, True, 12, drivers=drivers)
    assert np.stack(got) == pytest.approx(y[:, 60:], rel=1e-6)


def test_errors_that_last_make_a_better_forecast_than_the_line_alone():
    worse, better = [], []
    for seed in range(30):
        u = simulated((0.9,), (), 90, seed, 5.0) + 100
        full = arma.regression_batch(u[None, :84], 12, False, False, 6)[0]
        line = arma.regression_batch(u[None, :84], 12, False, False, 6, orders=((0, 0),))[0]
        better.append(np.abs(full - u[84:]).mean())
        worse.append(np.abs(line - u[84:]).mean())
    assert np.mean(better) < 0.9 * np.mean(worse)


def test_each_window_of_a_batch_is_its_own():
    draw = np.random.default_rng(2)
    y = draw.normal(size=(6, 60)).cumsum(axis=1) + 50
    together = arma.regression_batch(y, 12, True, True, 4)
    alone = [arma.regression_batch(row[None], 12, True, True, 4)[0] for row in y]
    assert np.stack(together) == pytest.approx(np.stack(alone), rel=1e-8)


def test_windows_too_short_have_no_path():
    assert arma.regression_batch(np.ones((2, 8)), 12, True, True, 3) == [None, None]
    flat = arma.regression_batch(np.full((1, 40), 7.0), 12, True, True, 3)[0]
    assert flat == pytest.approx([7.0, 7.0, 7.0])


def test_waves_are_orthogonal_and_leave_out_a_second_half_period():
    table = arma.waves(0, 24, 12, 6)
    assert table.shape == (24, 11)
    cross = table.T @ table
    assert cross - np.diag(np.diag(cross)) == pytest.approx(np.zeros((11, 11)), abs=1e-9)
