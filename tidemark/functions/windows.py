"""Signatures of one window of ticks that need iteration or linear algebra: small numpy functions for Arrow-batched UDFs.

Each takes the times (seconds) and prices of a window, oldest first, and returns a signature or None where the
window is too short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

TINY = 1e-9


def sign_changes(values: np.ndarray, least: float) -> int:
    """Changes of sign among the values that are at least ``least`` in size."""
    signs = np.sign(values[np.abs(values) >= least])
    return int((signs[1:] != signs[:-1]).sum())


def way(delta: float, margin: float = 0.0) -> str:
    return "U" if delta > margin else "D" if delta < -margin else "F"


def terrain(prices: np.ndarray) -> int:
    """0 calm, 1 normal, 2 volatile: sample deviation of simple returns."""
    before = prices[:-1]
    returns = (np.diff(prices) / np.where(before > 0, before, 1))[before > 0]
    if not len(returns):
        return 1
    spread = np.sqrt(((returns - returns.mean()) ** 2).sum() / max(len(returns) - 1, 1))
    return int(spread >= 0.00005) + int(spread >= 0.00020)


# ---- trigonometric curves over the price's place in its range

TRIG_WINDOW, TRIG_RECENT, SINGULAR = 24, 10, 0.02
PARALLEL, PERPENDICULAR, COINCIDENT, INTERSECTING, CONVERGING, DIVERGING = range(6)


def trig_curves(theta: np.ndarray) -> np.ndarray:
    """sin, cos, tan, cot, sec, csc; NaN where the denominator is too small."""
    s, c = np.sin(theta), np.cos(theta)
    over_c, over_s = np.where(np.abs(c) < SINGULAR, np.nan, c), np.where(np.abs(s) < SINGULAR, np.nan, s)
    return np.stack([s, c, s / over_c, c / over_s, 1 / over_c, 1 / over_s])


def _relation(market: np.ndarray, curve: np.ndarray) -> int:
    n, gap = len(market), market - curve
    if n < 3:
        return DIVERGING
    a, b = (market[-1] - market[0]) / (n - 1), (curve[-1] - curve[0]) / (n - 1)
    if abs(a - b) < 0.1 * max(abs(a), abs(b), 1e-6):
        return PARALLEL
    if abs(1 + a * b) < 0.3:
        return PERPENDICULAR
    if (np.abs(gap) < SINGULAR).all():
        return COINCIDENT
    signs = np.sign(gap[gap != 0])
    if len(signs) >= 2 and signs[0] != signs[-1]:
        return INTERSECTING
    return CONVERGING if abs(gap[-1]) < abs(gap[0]) else DIVERGING


def trig(_: np.ndarray, prices: np.ndarray) -> str | None:
    if len(prices) < 6:
        return None
    p = prices[-TRIG_WINDOW:]
    span = p.max() - p.min()
    theta = 2 * np.pi * (p - p.min()) / span if span > 0 else np.zeros(len(p))
    curves = trig_curves(theta[-TRIG_RECENT:])
    singular = int(np.isnan(curves[2:, -1]).sum())
    curves, market = np.nan_to_num(curves, nan=0.0), p[-TRIG_RECENT:]
    found = [_relation(market, c) for c in curves]
    relation = max(dict.fromkeys(found), key=found.count)  # the first of the most frequent
    near = np.abs(curves[:, None] - curves[None]) <= 0.05
    three = any(near[a, b, i] and near[a, c, i] and near[b, c, i] for i in range(curves.shape[1]) for a in range(6) for b in range(a + 1, 6) if near[a, b, i] for c in range(b + 1, 6))
    gaps = curves[:, None] - curves[None]
    was, now = gaps[..., :-1], gaps[..., 1:]
    crosses = (was != 0) & (now != 0) & ((was > 0) != (now > 0)) & (np.abs(now) < 0.5)
    transversal = bool((crosses.sum(axis=1) >= 2).any())
    direction = 1 + int(np.sign(market[-1] - market[0]))
    return f"trig:rel{relation}_cx{int(three)}_tr{int(transversal)}_dir{direction}_sg{int(singular >= 2)}"


# ---- superformula

SUPER_WINDOW = 24
# The grid of the formula's parameters.
SUPER_M = (1, 2, 3, 4, 5, 6, 8, 10, 12)
SUPER_N = (0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0, 5.0)
_super_grids: dict[int, np.ndarray] = {}


def super_grid(n: int) -> np.ndarray:
    """Radii for every (m, n1, n2) at n equal angles; kept for each n."""
    if n not in _super_grids:
        phi = 2 * np.pi * np.arange(n) / n
        m, n1, n2 = (np.array(x).reshape(s) for x, s in ((SUPER_M, (-1, 1, 1, 1)), (SUPER_N, (1, -1, 1, 1)), (SUPER_N, (1, 1, -1, 1))))
        base = np.abs(np.cos(m * phi / 4)) ** n2 + np.abs(np.sin(m * phi / 4)) ** n2
        with np.errstate(all="ignore"):
            _super_grids[n] = np.where(base <= 0, 0.0, base ** (-1 / n1)).reshape(-1, n)
    return _super_grids[n]


def superformula(_: np.ndarray, prices: np.ndarray) -> str | None:
    p = prices[-SUPER_WINDOW:]
    if len(p) < 8 or p.max() <= p.min():
        return None
    radius = 0.2 + 0.8 * (p - p.min()) / (p.max() - p.min())
    with np.errstate(all="ignore"):
        errors = (radius - super_grid(len(p))) ** 2
    best = int(np.where(np.isfinite(errors), errors, 1.0).mean(axis=1).argmin())
    m, n1, n2 = np.unravel_index(best, (len(SUPER_M), len(SUPER_N), len(SUPER_N)))
    bins = [min(int(i / (len(grid) - 1) * k), k - 1) for i, grid, k in ((m, SUPER_M, 5), (n1, SUPER_N, 4), (n2, SUPER_N, 4))]
    return f"sf:m{bins[0]}_n1_{bins[1]}_n2_{bins[2]}_d{way(p[-1] - p[0])}"


# ---- flow over a graph of price levels

# Ticks, nodes, steps, length of a step, viscosity and seed.
FLOW_WINDOW, FLOW_NODES, FLOW_STEPS, FLOW_DT, FLOW_VISCOSITY, FLOW_SEED = 48, 16, 8, 0.15, 0.05, 0xC0FFEE


def flow(_: np.ndarray, prices: np.ndarray) -> str | None:
    p = prices[-FLOW_WINDOW:]
    if len(p) < 8:
        return None
    inner = np.quantile(p, np.arange(1, FLOW_NODES) / FLOW_NODES)  # between the nodes
    used, node = np.unique(np.searchsorted(inner, p, "right"), return_inverse=True)
    n = len(used)
    if n < 3:
        return None
    speed = np.bincount(node[1:], np.diff(p), n) / np.bincount(node, minlength=n)
    moves = np.zeros((n, n))
    np.add.at(moves, (node[:-1], node[1:]), 1.0)
    np.fill_diagonal(moves, 0.0)
    moves /= np.maximum(moves.sum(axis=1, keepdims=True), 1.0)
    u = speed / max(np.abs(speed).max(), TINY)
    pressure = u - 0.5
    alive = (np.random.default_rng(FLOW_SEED + n + int(abs(p[-1]) * 100) % 1000).random(n) < 0.5).astype(float)
    before = alive.mean()
    for _step in range(FLOW_STEPS):
        around = moves @ alive
        push = 0.25 * np.clip(np.abs(alive - around), 0, 1) * (around - alive)
        drift = moves @ u - u
        u = u + FLOW_DT * (-drift * 0.5 - (moves @ pressure - pressure) + FLOW_VISCOSITY * drift + push)
        pressure = pressure + FLOW_DT * (moves @ u - u)
        near = around * max(n - 1, 1)
        alive = (((alive < 0.5) & (near > 2.5) & (near < 3.5)) | ((alive > 0.5) & (near > 1.5) & (near < 3.5))).astype(float)
    sign = lambda x, margin: 1 + int(x > margin) - int(x < -margin)
    return f"ns:v{sign(u.mean(), 0.05)}_p{sign(pressure.mean(), 0.5)}_d{min(int(alive.mean() * 4), 3)}_a{sign(alive.mean() - before, 0.05)}"


def flow_starts(n: int, m: int) -> np.ndarray:
    """The nodes that are alive at first, of n of them and a price whose hundredths end in m; kept for each n and m."""
    if (n, m) not in _flow_starts:
        _flow_starts[n, m] = (np.random.default_rng(FLOW_SEED + n + m).random(n) < 0.5).astype(float)
    return _flow_starts[n, m]


_flow_starts: dict[tuple[int, int], np.ndarray] = {}


def flows(_: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """:func:`flow` of many windows of one length, a row each: the same sums in the same order, for all windows with as many nodes at once."""
    out = np.full(len(prices), None, object)
    p = prices[:, -FLOW_WINDOW:]
    if p.shape[1] < 8:
        return out
    inner = np.quantile(p, np.arange(1, FLOW_NODES) / FLOW_NODES, axis=1).T
    found = (p[:, :, None] >= inner[:, None, :]).sum(axis=2)
    used = np.zeros((len(p), FLOW_NODES), bool)
    np.put_along_axis(used, found, True, axis=1)
    nodes, sizes = np.take_along_axis(used.cumsum(axis=1) - 1, found, axis=1), used.sum(axis=1)
    names = np.array([f"ns:v{v}_p{q}_d{d}_a{a}" for v in range(3) for q in range(3) for d in range(4) for a in range(3)], object)
    sign = lambda x, margin: 1 + (x > margin).astype(int) - (x < -margin)
    for n in np.unique(sizes[sizes >= 3]).tolist():
        at = np.flatnonzero(sizes == n)
        node, own = nodes[at], np.arange(len(at))[:, None] * n
        gained = np.bincount((own + node[:, 1:]).ravel(), np.diff(p[at], axis=1).ravel(), len(at) * n)
        speed = (gained / np.bincount((own + node).ravel(), minlength=len(at) * n)).reshape(-1, n)
        moves = np.bincount(((own + node[:, :-1]) * n + node[:, 1:]).ravel(), minlength=len(at) * n * n).reshape(-1, n, n).astype(float)
        moves[:, np.arange(n), np.arange(n)] = 0.0
        moves /= np.maximum(moves.sum(axis=2, keepdims=True), 1.0)
        u = speed / np.maximum(np.abs(speed).max(axis=1, keepdims=True), TINY)
        pressure = u - 0.5
        alive = np.array([flow_starts(n, m) for m in ((np.abs(p[at, -1]) * 100).astype(np.int64) % 1000).tolist()])
        before = alive.mean(axis=1)
        along = lambda x: np.matmul(moves, x[:, :, None])[:, :, 0]  # noqa: B023, E731
        for _step in range(FLOW_STEPS):
            around = along(alive)
            push = 0.25 * np.clip(np.abs(alive - around), 0, 1) * (around - alive)
            drift = along(u) - u
            u = u + FLOW_DT * (-drift * 0.5 - (along(pressure) - pressure) + FLOW_VISCOSITY * drift + push)
            pressure = pressure + FLOW_DT * (along(u) - u)
            near = around * max(n - 1, 1)
            alive = (((alive < 0.5) & (near > 2.5) & (near < 3.5)) | ((alive > 0.5) & (near > 1.5) & (near < 3.5))).astype(float)
        share = alive.mean(axis=1)
        code = (sign(u.mean(axis=1), 0.05) * 3 + sign(pressure.mean(axis=1), 0.5)) * 4 + np.minimum((share * 4).astype(int), 3)
        out[at] = names[code * 3 + sign(share - before, 0.05)]
    return out


# ---- trail of turning points

TRAIL_WINDOW, TRAIL_TURNS, TRAIL_STEP = 30, 6, 0.00015


def turning_points(y: np.ndarray) -> list[tuple[int, str]]:
    """Places and kinds (p peak, v valley) of strict extrema; of more than six those with the widest swing around them."""
    inner, left, right = y[1:-1], y[:-2], y[2:]
    peak = (inner > left) & (inner > right) & (inner - np.minimum(left, right) >= TRAIL_STEP)
    valley = (inner < left) & (inner < right) & (np.minimum(left, right) - inner >= TRAIL_STEP)
    at = np.flatnonzero(peak | valley)
    if len(at) > TRAIL_TURNS:
        swing = np.array([np.ptp(y[max(0, i - 2) : i + 5]) for i in at])  # from three before the turn to three after it
        at = np.sort(at[np.argsort(-swing, kind="stable")[:TRAIL_TURNS]])
    return [(int(i) + 1, "p" if peak[i] else "v") for i in at]


def trail(_: np.ndarray, prices: np.ndarray) -> str | None:
    if len(prices) < 12:
        return None
    p = prices[-TRAIL_WINDOW:]
    span = p.max() - p.min()
    y = (p - p.min()) / span if span > 0 else np.full(len(p), 0.5)
    turns = turning_points(y)
    ground = terrain(p[-20:])
    return f"trail:nt{len(turns)}_pe{turns[0][1] if turns else 'n'}_{way(y[-1] - y[0], 0.10)}{way(y[-1] - y[-2])}_t{ground}"


def terrains(prices: np.ndarray) -> np.ndarray:
    """:func:`terrain` of many windows of one length, a row each."""
    if prices.shape[1] < 2 or not (prices[:, :-1] > 0).all():
        return np.array([terrain(p) for p in prices], int)
    returns = np.diff(prices, axis=1) / prices[:, :-1]
    spread = np.sqrt(((returns - returns.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) / max(returns.shape[1] - 1, 1))
    return (spread >= 0.00005).astype(int) + (spread >= 0.00020)


def trails(_: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """:func:`trail` of many windows of one length, a row each."""
    if prices.shape[1] < 12:
        return np.full(len(prices), None, object)
    p = prices[:, -TRAIL_WINDOW:]
    low, span = p.min(axis=1, keepdims=True), np.ptp(p, axis=1, keepdims=True)
    y = np.where(span > 0, (p - low) / np.where(span > 0, span, 1.0), 0.5)
    inner, left, right = y[:, 1:-1], y[:, :-2], y[:, 2:]
    lower = np.minimum(left, right)
    peak = (inner > left) & (inner > right) & (inner - lower >= TRAIL_STEP)
    turn = peak | (inner < left) & (inner < right) & (lower - inner >= TRAIL_STEP)
    count, first = turn.sum(axis=1), turn.argmax(axis=1)
    many = np.flatnonzero(count > TRAIL_TURNS)
    if len(many):  # the first of those that turning_points keeps
        around = lambda edge: np.lib.stride_tricks.sliding_window_view(np.pad(y[many], ((0, 0), (2, 2)), constant_values=edge), 7, axis=1)
        swing = around(-np.inf).max(axis=2) - around(np.inf).min(axis=2)
        first[many] = np.argsort(np.where(turn[many], -swing, np.inf), axis=1, kind="stable")[:, :TRAIL_TURNS].min(axis=1)
    kind = np.where(count == 0, 2, np.where(np.take_along_axis(peak, first[:, None], axis=1)[:, 0], 0, 1))
    ways = lambda delta, margin: np.where(delta > margin, 0, np.where(delta < -margin, 1, 2))
    code = ((np.minimum(count, TRAIL_TURNS) * 3 + kind) * 3 + ways(y[:, -1] - y[:, 0], 0.10)) * 3 + ways(y[:, -1] - y[:, -2], 0.0)
    names = np.array([f"trail:nt{n}_pe{k}_{a}{b}_t{t}" for n in range(TRAIL_TURNS + 1) for k in "pvn" for a in "UDF" for b in "UDF" for t in range(3)], object)
    return names[code * 3 + terrains(p[:, -20:])]


#: Function of one window -> the same of many windows of one length at once, all of finite prices.
MANY: dict[Callable, Callable] = {flow: flows, trail: trails}


# ---- momentum over closed candles


def wilder(closes: np.ndarray, period: int) -> np.ndarray:
    """Relative strength index from its first full period on."""
    step = np.diff(closes)
    up, down = np.maximum(step, 0), np.maximum(-step, 0)
    gain, loss = up[:period].mean(), down[:period].mean()
    out = np.empty(len(step) - period + 1)
    for i in range(len(out)):
        if i:
            gain, loss = (gain * (period - 1) + up[period + i - 1]) / period, (loss * (period - 1) + down[period + i - 1]) / period
        out[i] = 100.0 if loss <= 1e-12 else 100 - 100 / (1 + gain / loss)
    return out


def ema(values: np.ndarray, period: int) -> np.ndarray:
    alpha, out = 2 / (period + 1), np.array(values, float)
    for i in range(1, len(out)):
        out[i] = alpha * out[i] + (1 - alpha) * out[i - 1]
    return out


def momentum(high: np.ndarray, low: np.ndarray, close: np.ndarray, least: int = 90, rsi: int = 60, fast: int = 30, slow: int = 60, smooth: int = 20, short: int = 30) -> str | None:
    if len(close) < max(least, rsi + 1, slow + smooth + 1, 2 * short + 1):
        return None
    strength = wilder(close, rsi)[-1]
    line = ema(close, fast) - ema(close, slow)
    hist = (line - ema(line, smooth))[-2:]
    recent = wilder(close, short)[-short:]
    stochastic = 50.0 if np.ptp(recent) <= 1e-9 else (recent[-1] - recent.min()) / np.ptp(recent) * 100
    typical = ((high + low + close) / 3)[-short:]
    spread = np.abs(typical - typical.mean()).mean()
    channel = 0.0 if spread <= 1e-12 else (typical[-1] - typical.mean()) / (0.015 * spread)
    phase = (0 if hist[1] >= hist[0] else 1) if hist[1] > 0 else 2 if hist[1] < 0 and hist[1] <= hist[0] else 3
    reach = lambda x, edges: sum(x >= e for e in edges)
    return f"mom:r{reach(strength, (30, 50, 70))}_m{phase}_s{reach(stochastic, (20, 80))}_c{reach(channel, (-100, 100))}"


# ---- curves and their formulas

Fit = tuple[Callable[[np.ndarray], np.ndarray], float]


def rms(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(np.mean((a - b) ** 2)))


def polynomial(x: np.ndarray, y: np.ndarray, degree: int) -> Fit:
    c = np.polyfit(x, y, degree)
    return (lambda at: np.polyval(c, at)), rms(y, np.polyval(c, x))


def on_terms(x: np.ndarray, y: np.ndarray, terms: Callable[[np.ndarray], np.ndarray]) -> Fit:
    c = np.linalg.lstsq(terms(x), y, rcond=None)[0]
    return (lambda at: terms(at) @ c), rms(y, terms(x) @ c)


def harmonics(waves: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.stack([np.ones_like(x), *(f(2 * np.pi * k * x) for k in waves for f in (np.sin, np.cos))], axis=1)


def best_fit(fits: Iterable[Fit]) -> Fit:
    """The fit with the least error; the first of equals."""
    return min(fits, key=lambda f: f[1])


CURVE_POINTS, CURVE_LEAST = 60, 8
FAMILIES = ("linear", "quadratic", "cubic", "quartic", "power", "exponential", "logarithmic")


def _families(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Error of each family; infinite where it can't be fitted."""
    errors = [polynomial(x, y, 1)[1], *(polynomial(x, y, d)[1] if len(x) >= d + 2 else np.inf for d in (2, 3, 4))]
    same = (np.abs(x) > 1e-4) & (np.abs(y) > 1e-6)
    same &= np.sign(x) == np.sign(y)
    power = np.inf
    if same.sum() >= 3:
        b, a = np.polyfit(np.log(np.abs(x[same])), np.log(np.abs(y[same])), 1)
        with np.errstate(all="ignore"):
            power = rms(y, np.exp(a) * np.sign(x) * np.abs(x) ** b)
    exponential = np.inf
    if (y > 0).all() or (y < 0).all():
        b, a = np.polyfit(x, np.log(np.abs(y)), 1)
        exponential = rms(y, np.sign(y[0]) * np.exp(a + b * x))
    logs = np.log(np.abs(x) + 1e-3)
    out = np.array([*errors, power, exponential, polynomial(logs, y, 1)[1]])
    return np.where(np.isnan(out), np.inf, out).tolist()


def _crossings(points: np.ndarray) -> int:
    """Pairs of segments, not next to each other, that cross; among the first 30 points."""
    p = points[:30]
    a, b = p[:-1], p[1:]
    turn = lambda o, s, e: (e[..., 1] - o[..., 1]) * (s[..., 0] - o[..., 0]) > (s[..., 1] - o[..., 1]) * (e[..., 0] - o[..., 0])
    i, j = np.triu_indices(len(a), 2)
    open_ends = ~((i == 0) & (j == len(a) - 1))
    i, j = i[open_ends], j[open_ends]
    return int(((turn(a[i], a[j], b[j]) != turn(b[i], a[j], b[j])) & (turn(a[i], b[i], a[j]) != turn(a[i], b[i], b[j]))).sum())


def _graph(times: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and prices around the middle of their ranges, on one scale."""
    x, y = times - times[0], prices - prices[0]
    x, y = x - (x.min() + x.max()) / 2, y - (y.min() + y.max()) / 2
    half = max(np.abs(x).max(), np.abs(y).max(), TINY)
    return x / half, y / half


def curve_shape(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Class of the path (loop, zigzag, wiggle, s, straight or curve) and the quadrant that holds most of its points."""
    points = np.stack([x, y], axis=1)
    d = np.diff(points, axis=0)
    size = np.sqrt((d**2).sum(axis=1))
    bend = 2 * (d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0]) / np.maximum(size[:-1] * size[1:] * (size[:-1] + size[1:]), 1e-12)
    ends = np.hypot(*(points[-1] - points[0]))
    tortuosity = size.sum() / ends if ends > TINY else 1.0
    turns = sign_changes(np.diff(y), 0.002)
    if _crossings(points) >= 1:
        shape = 5
    elif turns >= 6:
        shape = 4
    elif turns >= 4 and tortuosity > 1.5:
        shape = 3
    elif sign_changes(bend, 0.05) >= 2:
        shape = 2
    else:
        shape = 0 if tortuosity < 1.15 else 1
    quarter = np.where(y >= 0, np.where(x >= 0, 0, 1), np.where(x < 0, 2, 3))
    return shape, int(np.bincount(quarter, minlength=4).argmax())


def curve(times: np.ndarray, prices: np.ndarray) -> str | None:
    if len(prices) < CURVE_LEAST:
        return None
    if len(prices) > CURVE_POINTS:
        at = (np.arange(CURVE_POINTS) * (len(prices) / CURVE_POINTS)).astype(int)
        times, prices = times[at], prices[at]
    x, y = _graph(times, prices)
    shape, quarter = curve_shape(x, y)
    return f"cg:f{int(np.argmin(_families(x, y)))}_s{shape}_q{quarter}"


def curve_dwell(times: np.ndarray, prices: np.ndarray, core: str, backs: tuple[float, ...]) -> float:
    """Seconds that the class and quadrant of ``core`` have held: the span of the shortest of the last ``backs`` seconds that differs, else the longest of them."""
    own = tuple(int(part[1:]) for part in core.split("_")[1:3])
    for back in backs:
        part = times >= times[-1] - back
        if part.sum() >= CURVE_LEAST and curve_shape(*_graph(times[part], prices[part])) != own:
            return float(times[-1] - times[part][0])
    return float(backs[-1])


# ---- trajectory: twelve models, weighed by how well they forecast

TRAJECTORY_WINDOW, TRAJECTORY_LEAST, HORIZON = 30, 12, 3


def _thirds(x: np.ndarray, y: np.ndarray) -> Fit | None:
    """A parabola for each third of the points; outside them the first or the last one."""
    ends = len(x) * np.arange(1, 3) // 3
    groups = np.split(np.arange(len(x)), ends)
    if min(map(len, groups)) < 3:
        return None
    parabolas = np.stack([np.polyfit(x[g], y[g], 2) for g in groups])

    def at(points: np.ndarray) -> np.ndarray:
        return (parabolas[np.searchsorted(x[ends - 1], points)] * np.vander(points, 3)).sum(axis=1)

    return at, rms(y, at(x))


def _autoregression(y: np.ndarray, order: int) -> Fit:
    """Least squares on the ``order`` values before each one, newest first; the forecast goes on from the last ones."""
    windows = np.lib.stride_tricks.sliding_window_view(y, order + 1)
    design = np.column_stack([np.ones(len(windows)), windows[:, -2::-1]])
    c = np.linalg.lstsq(design, windows[:, -1], rcond=None)[0]

    def at(points: np.ndarray) -> np.ndarray:
        path = np.concatenate([y[-order:], np.empty(len(points))])
        for i in range(order, len(path)):
            path[i] = c[0] + path[i - order : i] @ c[:0:-1]
        return path[order:]

    return at, rms(y, np.concatenate([y[:order], design @ c]))


def _exponential(x: np.ndarray, y: np.ndarray) -> Fit:
    b, a = np.polyfit(x, np.log(y - y.min() + 0.1), 1)
    at = lambda p: np.exp(a) * np.exp(b * p) + y.min() - 0.1
    return at, rms(y, at(x))


def _logarithmic(x: np.ndarray, y: np.ndarray) -> Fit:
    c = np.polyfit(np.log(x + 0.01), y, 1)
    at = lambda p: np.polyval(c, np.log(p + 0.01))
    return at, rms(y, at(x))


def _power(x: np.ndarray, y: np.ndarray) -> Fit:
    b, a = np.polyfit(np.log(x + 0.01), np.log(y - y.min() + 0.1), 1)
    at = lambda p: np.exp(a) * (p + 0.01) ** b + y.min() - 0.1
    return at, rms(y, at(x))


# Name, points it needs, complexity; and its fitter.
MODELS: tuple[tuple[str, int, float, Callable[[np.ndarray, np.ndarray], Fit | None]], ...] = (
    ("lin", 3, 1.0, lambda x, y: polynomial(x, y, 1)),
    ("quad", 4, 1.2, lambda x, y: polynomial(x, y, 2)),
    ("cubic", 5, 1.4, lambda x, y: polynomial(x, y, 3)),
    ("quart", 6, 1.6, lambda x, y: polynomial(x, y, 4)),
    ("pieceq", 6, 1.5, _thirds),
    ("four1", 6, 1.8, lambda x, y: best_fit(on_terms(x, y, harmonics((k,))) for k in range(1, 6))),
    ("four2", 8, 2.0, lambda x, y: best_fit(on_terms(x, y, harmonics((k, m))) for k in range(1, 4) for m in range(k + 1, 6))),
    ("ar3", 6, 1.7, lambda x, y: _autoregression(y, 3)),
    ("ar5", 8, 1.9, lambda x, y: _autoregression(y, 5)),
    ("exp", 4, 1.3, _exponential),
    ("log", 4, 1.3, _logarithmic),
    ("pow", 4, 1.3, _power),
)


def _fitted(least: int, fitter: Callable, x: np.ndarray, y: np.ndarray) -> Fit | None:
    if len(x) < least:
        return None
    try:
        return fitter(x, y)
    except (np.linalg.LinAlgError, ValueError):
        return None


def _scaled(times: np.ndarray, prices: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All points on the scale of the first n."""
    span = max(times[n - 1] - times[0], TINY)
    height = max(np.abs(prices[:n] - prices[0]).max(), TINY)
    return (times - times[0]) / span, (prices - prices[0]) / height


def _forecast_error(least: int, fitter: Callable, times: np.ndarray, prices: np.ndarray) -> float:
    """Mean error of forecasts of three points from origins 12, 15, ...; infinite if none could be made."""
    n = len(times)
    origins = range(12, n - HORIZON + 1, 3) if n >= 12 + HORIZON else [n - HORIZON]
    errors = []
    for o in origins:
        x, y = _scaled(times, prices, o)
        if fit := _fitted(least, fitter, x[:o], y[:o]):
            errors.append(rms(y[o : o + HORIZON], fit[0](x[o : o + HORIZON])))
    return float(np.mean(errors)) if errors else np.inf


def _ensemble(times: np.ndarray, prices: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, scores, weights and forecasts (a row for each of the next points) of the models that fit."""
    step = x[-1] - x[-2] if x[-1] > x[-2] else 0.01
    future = x[-1] + step * np.arange(1, HORIZON + 1)
    names, scores, ahead = [], [], []
    for name, least, complexity, fitter in MODELS:
        if fit := _fitted(least, fitter, x, y):
            error = _forecast_error(least, fitter, times, prices)
            names.append(name)
            scores.append(0.65 * (error if np.isfinite(error) else 1.0) + 0.25 * fit[1] + 0.10 * (complexity - 1.0))
            ahead.append(np.asarray(fit[0](future), float))
    weight = 1 / (np.array(scores) + 1e-6)
    return names, np.array(scores), weight / weight.sum(), np.array(ahead)


def trajectory_models(times: np.ndarray, prices: np.ndarray) -> tuple[float, float, float, list[tuple[str, float, str, list[float]]]] | None:
    """First price and height of the window, the price now, and of each model: name, weight, direction and forecast prices."""
    if len(prices) < TRAJECTORY_LEAST:
        return None
    times, prices = times[-TRAJECTORY_WINDOW:], prices[-TRAJECTORY_WINDOW:]
    x, y = _scaled(times, prices, len(times))
    names, _, weight, ahead = _ensemble(times, prices, x, y)
    height = max(np.abs(prices - prices[0]).max(), TINY)
    way = np.sign(ahead[:, -1] - y[-1]).astype(int)
    models = [(n, float(w), ("FLAT", "UP", "DOWN")[d], (prices[0] + height * v).tolist()) for n, w, d, v in zip(names, weight, way, ahead, strict=True)]
    return float(prices[0]), float(height), float(prices[-1]), models


def trajectory(times: np.ndarray, prices: np.ndarray) -> tuple[str, str | None, float, str] | None:
    """Signature, direction of the weighed forecast, its strength and the best model."""
    if len(prices) < TRAJECTORY_LEAST:
        return None
    times, prices = times[-TRAJECTORY_WINDOW:], prices[-TRAJECTORY_WINDOW:]
    x, y = _scaled(times, prices, len(times))
    a, b, c = np.stack([x[:-2], y[:-2]]), np.stack([x[1:-1], y[1:-1]]), np.stack([x[2:], y[2:]])
    ab, bc, ca = b - a, c - b, a - c
    sides = np.hypot(*ab) * np.hypot(*bc) * np.hypot(*ca)
    bend = float(np.abs(2 * (ab[0] * bc[1] - ab[1] * bc[0]) / np.maximum(sides, 1e-12)).mean())
    ends = np.hypot(x[-1] - x[0], y[-1] - y[0])
    tortuosity = np.hypot(np.diff(x), np.diff(y)).sum() / ends if ends > TINY else 1.0
    turns = sign_changes(np.diff(y), 0.005)
    if turns >= 6:
        shape = "ZIGZAG"
    elif turns >= 4 and tortuosity > 1.4:
        shape = "WIGGLE"
    elif bend > 0.4:
        shape = "OSCILLATORY"
    else:
        shape = "LINEAR" if tortuosity < 1.15 else "REVERSAL" if tortuosity > 1.8 else "CURVE"
    names, scores, weight, ahead = _ensemble(times, prices, x, y)
    ends_at = ahead[:, -1]
    target = float(weight @ ends_at)
    spread = float(np.sqrt(weight @ (ends_at - target) ** 2))
    delta = target - y[-1]
    strength = (1.0 if abs(delta) > 1e-4 else 0.0) if spread < 1e-6 else min(1.0, abs(delta) / (3 * spread))
    direction = "UP" if delta > 0 else "DOWN" if delta < 0 else None
    best = names[int(np.argmin(scores))]
    ground = ("calm", "normal", "volatile")[terrain(prices)]
    return f"traj:{shape}_{best}_{ground}", direction, strength, best
