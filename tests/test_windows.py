"""Numeric window functions on made-up series."""

import math
import random

import numpy as np
import pytest

from tidemark.functions import windows as w

T = np.arange(120) * 0.5
WALK = 1e6 + np.cumsum(np.random.default_rng(7).normal(0, 40, 120))


@pytest.mark.parametrize(("function", "least"), [(w.trig, 6), (w.superformula, 8), (w.flow, 8), (w.trail, 12), (w.curve, 8), (w.trajectory, 12)])
def test_minimum_length(function, least):
    assert function(T[: least - 1], WALK[: least - 1]) is None
    assert function(T[:least], WALK[:least]) is not None


@pytest.mark.parametrize("function", [w.trig, w.superformula, w.flow, w.trail, w.curve, w.trajectory])
def test_constant_series_does_not_fail(function):
    function(T[:30], np.full(30, 1e6))


def test_superformula_takes_the_first_best_of_the_grid():
    p = WALK[:24]
    radius = [0.2 + 0.8 * (x - p.min()) / (p.max() - p.min()) for x in p]
    best, at = math.inf, None
    for i, m in enumerate(w.SUPER_M):
        for j, a in enumerate(w.SUPER_N):
            for k, b in enumerate(w.SUPER_N):
                error = 0.0
                for n, r in enumerate(radius):
                    phi = 2 * math.pi * n / len(radius)
                    base = abs(math.cos(m * phi / 4)) ** b + abs(math.sin(m * phi / 4)) ** b
                    error += (r - base ** (-1 / a)) ** 2
                if error < best - 1e-12:
                    best, at = error, (i, j, k)
    bins = [min(int(x / (size - 1) * n), n - 1) for x, size, n in zip(at, (9, 8, 8), (5, 4, 4), strict=True)]
    assert w.superformula(T[:24], p).startswith(f"sf:m{bins[0]}_n1_{bins[1]}_n2_{bins[2]}_d")


def test_turning_points_keep_the_widest():
    y = np.array([0.5, 0.6, 0.5, 0.9, 0.1, 1.0, 0.0, 0.8, 0.2, 0.7, 0.3, 0.6, 0.4, 0.5])
    turns = w.turning_points(y)
    assert len(turns) == 6 and [i for i, _ in turns] == sorted(i for i, _ in turns)


def test_trajectory_of_a_ramp_goes_up():
    signature, direction, strength, _ = w.trajectory(T[:30], 1e6 + 10.0 * np.arange(30))
    assert signature.startswith("traj:LINEAR_lin_calm") and direction == "UP" and 0 < strength <= 1


def test_wilder_and_ema_against_loops():
    rng = random.Random(1)
    closes = np.array([100 + rng.random() for _ in range(80)])
    out = [closes[0]]
    for x in closes[1:]:
        out.append(2 / 11 * x + 9 / 11 * out[-1])
    assert np.allclose(w.ema(closes, 10), out)
    assert len(w.wilder(closes, 14)) == len(closes) - 14
    assert w.wilder(np.arange(40.0), 14)[-1] == 100.0


def test_curve_shapes():
    assert "_s0_" in w.curve(T[:30], 1e6 + 0.2 * T[:30])  # a line; its family is a tie of rounding errors
    zigzag = 1e6 + np.where(np.arange(30) % 2, 5.0, -5.0)
    assert "_s4_" in w.curve(T[:30], zigzag)
