"""The continuous search of the smoothing weights."""

import time

import numpy as np
import pytest

from tidemark.operators import smoothing


def simulated(level, n, seed, trend=0.0):
    draw = np.random.default_rng(seed)
    at, slope, out = 50.0, 0.0, []
    for _ in range(n):
        shock = float(draw.normal())
        out.append(at + slope + shock)
        at += slope + level * shock
        slope += level * trend * shock
    return np.array(out)


@pytest.mark.parametrize("level", [0.15, 0.42, 0.8])
def test_a_known_weight_comes_back_between_the_grids_own(level):
    y = np.stack([simulated(level, 1500, seed) for seed in range(4)])
    start = smoothing._opening(y, 1, None, False)
    grid = np.array([(a, 0.0, 0.0, 1.0) for a in smoothing.LEVEL_WEIGHTS])
    squared = smoothing._run(y, start, tuple(grid.T), False, None)[0]
    best, least = smoothing._refined(y, start, grid[squared.argmin(axis=1)], squared.min(axis=1), np.array([0]), False, None)
    assert best[:, 0] == pytest.approx(np.full(4, level), abs=0.07)
    exact = [min(float(smoothing._run(row[None], tuple(held[i : i + 1] for held in start), tuple(np.array([[v]]) for v in (a, 0.0, 0.0, 1.0)), False, None)[0][0, 0]) for a in np.linspace(0.01, 0.99, 99)) for i, row in enumerate(y)]
    assert (least <= np.array(exact) * (1 + 1e-4)).all()


@pytest.mark.parametrize("trend, damped, season", [(False, False, None), (True, False, None), (True, True, None), (False, False, "add"), (True, True, "add"), (True, True, "mul")])
def test_the_criterion_is_never_above_the_grids(trend, damped, season):
    draw = np.random.default_rng(4)
    t = np.arange(60)
    y = 100 + 0.5 * t + 10 * np.cos(2 * np.pi * t / 12) + draw.normal(size=(25, 60)) * draw.uniform(0.1, 12, size=(25, 1))
    rough, _ = smoothing.smooth(y, 12, trend, damped, season, 3, refine=False)
    fine, path = smoothing.smooth(y, 12, trend, damped, season, 3)
    assert (fine <= rough + 1e-9).all() and (fine < rough - 1e-6).any() and np.isfinite(path).all()


def test_each_window_of_a_batch_is_its_own():
    draw = np.random.default_rng(6)
    y = 100 + draw.normal(size=(7, 40)).cumsum(axis=1)
    together = smoothing.smooth(y, 12, True, True, None, 4)
    alone = [smoothing.smooth(row[None], 12, True, True, None, 4) for row in y]
    assert together[0] == pytest.approx(np.concatenate([one[0] for one in alone])) and together[1] == pytest.approx(np.concatenate([one[1] for one in alone]))


def test_the_search_costs_less_than_the_grid_again():
    y = 100 + np.random.default_rng(7).normal(size=(300, 70)).cumsum(axis=1)
    spent = []
    for refine in (False, True):
        began = time.process_time()
        smoothing.smooth(y, 12, True, True, "add", 6, refine=refine)
        spent.append(time.process_time() - began)
    assert spent[1] < 2 * spent[0] + 0.05


def test_flat_and_broken_windows_stay_sound():
    flat = np.full((2, 30), 7.0)
    criterion, path = smoothing.smooth(flat, 12, True, True, None, 3)
    assert np.isfinite(criterion).all() and path == pytest.approx(np.full((2, 3), 7.0))
