"""Posterior mode of one edition's variance components from aggregated statistics.

Everything here has the size of the model (a few hundred columns), never of the data. With the
school effects absorbed, the statistics depend on the data only through smooth functions of the
log ratio of residual to school variance. Those are tabulated on Chebyshev nodes by one Spark pass
and interpolated here, so the search itself needs no further pass over the schools.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

from estratia import fixed_values as V

SD_RATE = -np.log(V.SD_PRIOR_TAIL) / V.SD_PRIOR_BOUND
D = len(V.DOMAINS)
LOWER = [(i, j) for i in range(D) for j in range(i + 1)]


@dataclass
class Grid:
    """Nodes over an interval per school effect (intercept, or intercept and slope)."""

    centre: np.ndarray
    half: float
    order: int

    @property
    def nodes(self) -> np.ndarray:
        unit = np.cos(np.pi * (np.arange(self.order) + 0.5) / self.order)
        return np.array(list(product(*[c + self.half * unit for c in self.centre])))

    def weights(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weights of the nodes for the interpolated value and for each partial derivative."""
        k = np.arange(self.order)
        angle = np.pi * (k + 0.5) / self.order
        to_coef = np.cos(np.outer(k, angle)) * (2.0 / self.order)
        to_coef[0] /= 2.0
        values, slopes = [], []
        for c, xi in zip(self.centre, x):
            u = np.clip((xi - c) / self.half, -1 + 1e-12, 1 - 1e-12)
            a = np.arccos(u)
            values.append(np.cos(k * a) @ to_coef)
            slopes.append((k * np.sin(k * a) / np.sin(a) / self.half) @ to_coef)
        flat = lambda parts: np.prod(np.array(list(product(*parts))), axis=1)
        partial = [
            flat([slopes[e] if e == d else values[e] for e in range(len(x))]) for d in range(len(x))
        ]
        return flat(values), partial


@dataclass
class System:
    """Sums of one edition: cross-products, response sums and their absorbed parts by node."""

    gram: np.ndarray
    rhs: np.ndarray
    yy: float
    weight: float  # what multiplies the log residual variance: sum of weights, or rows
    n_schools: int
    n_fixed: int
    n_strata: int
    n_regions: int
    grid: Grid | None = None
    absorbed: np.ndarray | None = None  # upper triangles of the cross-products, one row a node
    absorbed_rhs: np.ndarray | None = None
    absorbed_yy: np.ndarray | None = None
    log_det: np.ndarray | None = None

    def __post_init__(self):
        q = len(self.rhs)
        self.upper = np.triu_indices(q)
        self.flat = self.upper[0] * q + self.upper[1]
        self.mirror = self.upper[1] * q + self.upper[0]
        self.twice = np.where(self.upper[0] == self.upper[1], 1.0, 2.0)
        self.fixed_at = np.arange(self.n_fixed)
        rows = self.n_fixed + D * np.arange(self.n_strata)[:, None, None]
        self.block_rows = rows + np.arange(D)[None, :, None]
        self.block_columns = rows + np.arange(D)[None, None, :]
        self.region_at = np.arange(self.n_fixed + D * self.n_strata, q)

    def set_table(self, grid: Grid, triangles, rhs, yy, log_det) -> None:
        """The absorbed sums at the nodes of a grid."""
        self.grid, self.absorbed, self.absorbed_rhs = grid, triangles, rhs
        self.absorbed_yy, self.log_det = yy, log_det


def cholesky_factor(t: np.ndarray) -> np.ndarray:
    factor = np.zeros((D, D))
    for value, (i, j) in zip(t, LOWER):
        factor[i, j] = np.exp(value) if i == j else value
    return factor


@dataclass
class Point:
    """Objective, gradient parts and solution at one value of the parameters."""

    value: float
    d_te: float
    d_x: np.ndarray
    d_tr: float
    d_chol: np.ndarray
    theta: np.ndarray
    inverse: np.ndarray


def evaluate(s: System, te: float, x: np.ndarray, tr: float, chol: np.ndarray) -> Point:
    """Negative log posterior of (log residual sd, log variance ratios, log region sd, Cholesky)."""
    q, m = len(s.rhs), len(x)
    s2 = np.exp(2 * te)
    w, dw = s.grid.weights(x)
    factor = cholesky_factor(chol)
    precision = np.linalg.inv(factor @ factor.T)
    c = s.gram.copy()
    packed = w @ s.absorbed
    flat = c.reshape(-1)
    flat[s.flat] -= packed
    flat[s.mirror] = flat[s.flat]
    c[s.fixed_at, s.fixed_at] += s2 * V.FIXED_PRECISION
    c[s.block_rows, s.block_columns] += s2 * precision
    c[s.region_at, s.region_at] += s2 * np.exp(-2 * tr)
    rhs = s.rhs - w @ s.absorbed_rhs
    lower = np.linalg.cholesky(c)
    inverse = np.linalg.inv(c)
    theta = inverse @ rhs
    misfit = (s.yy - w @ s.absorbed_yy - rhs @ theta) / s2
    tv = te - x / 2
    log_det_omega = 2 * np.sum(np.log(np.diag(factor)))
    a, b = V.RESIDUAL_PRIOR
    df = V.STRATA_PRIOR_DF
    value = 0.5 * (
        s.weight * 2 * te + misfit + w @ s.log_det + 2 * np.sum(np.log(np.diag(lower)))
        - (s.n_schools * m + q) * 2 * te + s.n_schools * 2 * tv.sum() + s.n_regions * 2 * tr + s.n_strata * log_det_omega
    )
    value -= np.sum(tv - SD_RATE * np.exp(tv)) + (-2 * a * te - b * np.exp(-2 * te))
    if s.n_regions:
        value -= tr - SD_RATE * np.exp(tr)
    jacobian = np.array([D + 1 - i if i == j else 0.0 for i, j in LOWER])
    value += 0.5 * (df + D + 1) * log_det_omega + 0.5 * V.STRATA_PRIOR_SCALE * np.trace(precision) - jacobian @ np.where(
        jacobian > 0, chol, 0.0
    )

    curve = np.outer(theta, theta) / s2 + inverse
    blocks = curve[s.block_rows, s.block_columns].sum(axis=0)
    region_trace = np.exp(-2 * tr) * curve[s.region_at, s.region_at].sum()
    prior_part = V.FIXED_PRECISION * curve[s.fixed_at, s.fixed_at].sum() + np.sum(blocks * precision) + region_trace
    d_te = (
        s.weight - misfit - (s.n_schools * m + q) + s2 * prior_part + s.n_schools * m
        - np.sum(1 - SD_RATE * np.exp(tv)) + 2 * a - 2 * b * np.exp(-2 * te)
    )
    on_nodes = s.absorbed @ (curve.reshape(-1)[s.flat] * s.twice)
    d_x = np.zeros(m)
    for d in range(m):
        moved = (2 * theta @ (dw[d] @ s.absorbed_rhs) - dw[d] @ s.absorbed_yy) / s2
        d_x[d] = 0.5 * (moved + dw[d] @ s.log_det - dw[d] @ on_nodes) - 0.5 * s.n_schools
        d_x[d] += 0.5 * (1 - SD_RATE * np.exp(tv[d]))
    d_tr = 0.0
    if s.n_regions:
        d_tr = -s2 * region_trace + s.n_regions - 1 + SD_RATE * np.exp(tr)
    total = s2 * blocks + V.STRATA_PRIOR_SCALE * np.eye(D)
    d_omega = 0.5 * (-precision @ total @ precision + (s.n_strata + df + D + 1) * precision)
    d_factor = 2 * d_omega @ factor
    d_chol = np.array([d_factor[i, j] * (factor[i, i] if i == j else 1.0) for i, j in LOWER]) - jacobian
    return Point(value, d_te, d_x, d_tr, d_chol, theta, inverse)


@dataclass
class Mode:
    """Parameters at the mode: te, tv per school effect, tr and Cholesky, with their covariance."""

    t: np.ndarray
    covariance: np.ndarray
    theta: np.ndarray
    inverse: np.ndarray
    converged: bool
    iterations: int
    edge: float  # how far from the centre of the tabulated interval, 1 at its ends

    def unpack(self, m: int, regions: int) -> tuple[float, np.ndarray, float, np.ndarray]:
        return split(self.t, m, regions)


def split(t: np.ndarray, m: int, regions: int) -> tuple[float, np.ndarray, float, np.ndarray]:
    te, tv = t[0], t[1 : 1 + m]
    tr = t[1 + m] if regions else 0.0
    return te, tv, tr, t[1 + m + (1 if regions else 0) :]


def start(weight_scale: float, m: int, regions: int) -> np.ndarray:
    """Moderate components; the residual sd carries the scale of the weights in one mode."""
    te = 0.5 * np.log(0.7 * weight_scale)
    chol = [0.5 * np.log(0.1) if i == j else 0.0 for i, j in LOWER]
    return np.array([te, *[0.5 * np.log(0.1)] * m, *([0.5 * np.log(0.05)] if regions else []), *chol])


def find_mode(s: System, t0: np.ndarray, tolerance: float = 1e-5, limit: int = 200, curvature: bool = True) -> Mode:
    """Quasi-Newton descent inside the tabulated interval, then curvature at the mode."""
    m = len(s.grid.centre)
    centre, half = s.grid.centre, s.grid.half

    def to_search(t):
        te, tv, tr, chol = split(t, m, s.n_regions)
        unit = np.clip((2 * (te - tv) - centre) / half, -0.9, 0.9)
        return np.concatenate([[te], np.arctanh(unit), [tr] if s.n_regions else [], chol])

    def at(z):
        te, u, tr, chol = split(z, m, s.n_regions)
        x = centre + half * np.tanh(u)
        p = evaluate(s, te, x, tr, chol)
        g = np.concatenate([[p.d_te], p.d_x * half * (1 - np.tanh(u) ** 2), [p.d_tr] if s.n_regions else [], p.d_chol])
        return p, g

    # rough curvature of each parameter, so that first steps have about the right length
    rough = [2 * s.weight, *[0.5 * s.n_schools * half**2] * m, *([2 * s.n_regions] if s.n_regions else [])]
    rough += [2 * s.n_strata if i == j else 10 * s.n_strata for i, j in LOWER]
    scale_of = np.diag(1 / np.maximum(1.0, rough))
    z = to_search(t0)
    point, g = at(z)
    h = scale_of
    done, used = False, 0
    for used in range(1, limit + 1):
        step = -h @ g
        if g @ step >= 0:
            h = scale_of
            step = -h @ g
        step *= min(1.0, 2.0 / np.max(np.abs(step)))
        scale, accepted = 1.0, False
        noise = 1e-11 * abs(point.value)  # rounding of the objective
        for _ in range(30):
            try:
                trial, gt = at(z + scale * step)
                if np.isfinite(trial.value) and trial.value <= point.value + 1e-4 * scale * (g @ step) + noise:
                    accepted = True
                    break
            except np.linalg.LinAlgError:
                pass
            scale /= 2
        if not accepted:
            done = np.max(np.abs(g)) < 1e-2 * max(1.0, np.sqrt(s.weight))
            break
        dz, dg = scale * step, gt - g
        z, point, g = z + dz, trial, gt
        if dz @ dg > 1e-12:
            rho, eye = 1 / (dz @ dg), np.eye(len(z))
            left = eye - rho * np.outer(dz, dg)
            h = left @ h @ left.T + rho * np.outer(dz, dz)
        if np.max(np.abs(np.tanh(z[1 : 1 + m]))) > 0.97:
            break  # the mode lies outside: tabulate around here and go on
        # change expected from a full step, in units of the log posterior, and size of the step
        if g @ h @ g < tolerance**2 and np.max(np.abs(h @ g)) < tolerance:
            done = True
            break
    te, u, tr, chol = split(z, m, s.n_regions)
    x = centre + half * np.tanh(u)
    t = np.concatenate([[te], te - x / 2, [tr] if s.n_regions else [], chol])
    covariance = _covariance(s, t, m) if curvature else np.zeros((len(t), len(t)))
    return Mode(t, covariance, point.theta, point.inverse, done, used, float(np.max(np.abs(np.tanh(u)))))


def _covariance(s: System, t: np.ndarray, m: int, step: float = 1e-4) -> np.ndarray:
    """Inverse curvature of the negative log posterior, by differences of its gradient."""

    def gradient(v):
        te, tv, tr, chol = split(v, m, s.n_regions)
        p = evaluate(s, te, 2 * (te - tv), tr, chol)
        return np.concatenate([[p.d_te + 2 * p.d_x.sum()], -2 * p.d_x, [p.d_tr] if s.n_regions else [], p.d_chol])

    n = len(t)
    hessian = np.zeros((n, n))
    for i in range(n):
        e = np.zeros(n)
        e[i] = step
        hessian[i] = (gradient(t + e) - gradient(t - e)) / (2 * step)
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
    values = np.maximum(values, 1e-8 * values.max())
    return (vectors / values) @ vectors.T
