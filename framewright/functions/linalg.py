"""Dense linear algebra on small aggregated matrices, with numpy alone."""

from __future__ import annotations

import math

import numpy as np


def row_stochastic(counts: np.ndarray) -> np.ndarray:
    """Counts over their row sums; rows without counts stay zero."""
    total = counts.sum(1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts, "f8"), where=total > 0)


def strong_components(adjacent: np.ndarray) -> list[list[int]]:
    """Strongly connected components of a boolean matrix, largest first, ties by least member.

    Reachability by repeated squaring: two states belong together if each reaches the other.
    """
    n = len(adjacent)
    reach = adjacent.astype(bool) | np.eye(n, dtype=bool)
    while True:
        wider = (reach.astype("f4") @ reach.astype("f4")) > 0
        if (wider == reach).all():
            break
        reach = wider
    mutual = reach & reach.T
    parts = {tuple(np.flatnonzero(row).tolist()) for row in mutual}
    return sorted((list(p) for p in parts), key=lambda p: (-len(p), p[0]))


def weak_components(adjacent: np.ndarray) -> list[list[int]]:
    return strong_components(adjacent | adjacent.T)


def stationary(p: np.ndarray) -> np.ndarray:
    """Solution of pi P = pi with sum one, by least squares on the two conditions together."""
    n = len(p)
    a = np.vstack([p.T - np.eye(n), np.ones((1, n))])
    pi = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
    pi = np.clip(pi, 0, None)
    return pi / pi.sum()


def check_transition_matrix(p: np.ndarray, pi: np.ndarray, row_tol: float = 1e-12, pi_tol: float = 1e-8) -> None:
    """Raise unless P is non-negative and row-stochastic and pi is invariant under it."""
    if (p < 0).any():
        raise ValueError("negative probabilities")
    if np.abs(p.sum(1) - 1).max() > row_tol:
        raise ValueError("rows do not sum to one")
    if np.abs(pi @ p - pi).max() > pi_tol:
        raise ValueError("pi is not invariant")


def sorted_eigenvalues(p: np.ndarray) -> np.ndarray:
    values = np.linalg.eigvals(p)
    return values[np.lexsort((values.imag, -np.abs(values)))]


def timescales(values: np.ndarray, lag: float) -> np.ndarray:
    """-lag / ln |lambda|; NaN where |lambda| is not inside (0, 1) or a real lambda is not positive."""
    values = np.asarray(values, complex)
    size = np.abs(values)
    bad = (size <= 0) | (size >= 1) | ((np.abs(values.imag) < 1e-12) & (values.real <= 0))
    out = np.full(len(values), np.nan)
    out[~bad] = -lag / np.log(size[~bad])
    return out


def signed_columns(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude is positive."""
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1.0, 1.0)


def inverse_root(c: np.ndarray, epsilon: float) -> np.ndarray:
    """Symmetric inverse square root on the eigenvalues above ``epsilon``."""
    s, u = np.linalg.eigh((c + c.T) / 2)
    keep = s > epsilon
    return u[:, keep] / np.sqrt(s[keep]) @ u[:, keep].T


def pca_basis(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s, u = np.linalg.eigh(cov)
    order = np.argsort(-s)[:k]
    return s[order], signed_columns(u[:, order])


def tica_basis(c00: np.ndarray, c0t: np.ndarray, k: int, epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Generalised eigenproblem of the symmetrised lagged covariance in the whitened space."""
    w = inverse_root(c00, epsilon)
    m = w @ ((c0t + c0t.T) / 2) @ w
    s, u = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-s)[:k]
    return s[order], signed_columns(w @ u[:, order])


def vamp_basis(c00: np.ndarray, c0t: np.ndarray, ctt: np.ndarray, k: int, epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and left functions of C00^-1/2 C0t Ctt^-1/2."""
    a, b = inverse_root(c00, epsilon), inverse_root(ctt, epsilon)
    u, s, _ = np.linalg.svd(a @ c0t @ b)
    return s[:k], signed_columns(a @ u[:, :k])


def vamp2_score(c00: np.ndarray, c0t: np.ndarray, ctt: np.ndarray, ridge: float = 1e-6) -> float:
    """Squared Frobenius norm of the whitened lagged covariance; the ridge grows until both factor."""
    for k in range(8):
        try:
            own = ridge * 10**k * np.eye(len(c00))
            a, b = np.linalg.cholesky(c00 + own), np.linalg.cholesky(ctt + own)
            return float((np.linalg.solve(b, np.linalg.solve(a, c0t).T) ** 2).sum())
        except np.linalg.LinAlgError:
            continue
    return math.nan


def canonical_correlations(cxx: np.ndarray, cxy: np.ndarray, cyy: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Canonical correlations from covariances, in [0, 1]."""
    a = inverse_root(cxx + ridge * np.eye(len(cxx)), ridge)
    b = inverse_root(cyy + ridge * np.eye(len(cyy)), ridge)
    return np.clip(np.linalg.svd(a @ cxy @ b, compute_uv=False), 0, 1)


def mean_first_passage(p: np.ndarray, target: list[int]) -> np.ndarray:
    """Expected steps to ``target`` from each state; NaN where it can't be reached for sure."""
    rest = [i for i in range(len(p)) if i not in set(target)]
    out = np.zeros(len(p))
    try:
        out[rest] = np.linalg.solve(np.eye(len(rest)) - p[np.ix_(rest, rest)], np.ones(len(rest)))
    except np.linalg.LinAlgError:
        out[rest] = np.nan
    return out


def dominant_eigenvectors(p: np.ndarray, pi: np.ndarray, k: int) -> np.ndarray:
    """Right eigenvectors of the symmetrised chain, the first of them constant."""
    flow = pi[:, None] * p
    flow = (flow + flow.T) / 2
    root = np.sqrt(np.maximum(pi, 1e-300))
    s, u = np.linalg.eigh(flow / root[:, None] / root[None, :])
    x = signed_columns(u[:, np.argsort(-s)[:k]]) / root[:, None]
    x[:, 0] = 1.0
    return x


def simplex_corners(x: np.ndarray) -> list[int]:
    """Rows that span the simplex of all: repeatedly the row farthest from the span so far."""
    corners = [int((x**2).sum(1).argmax())]
    rest = x - x[corners[0]]
    for _ in range(x.shape[1] - 1):
        size = (rest**2).sum(1)
        corners.append(int(size.argmax()))
        axis = rest[corners[-1]] / np.sqrt(max(size.max(), 1e-300))
        rest = rest - np.outer(rest @ axis, axis)
    return corners


def feasible_transform(inner: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The k x k map of ``x`` to memberships that are non-negative and sum to one, from its free (k - 1) x (k - 1) part."""
    k = x.shape[1]
    a = np.zeros((k, k))
    a[1:, 1:] = inner
    a[1:, 0] = -inner.sum(1)
    a[0] = -(x[:, 1:] @ a[1:]).min(0)
    return a / max(a[0].sum(), 1e-300)


def downhill(f, start: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Least value of a function by the simplex method of Nelder and Mead."""
    n = len(start)
    points = np.vstack([start, *(start + np.eye(n)[i] * (0.05 * abs(start[i]) or 0.00025) for i in range(n))])
    values = np.array([f(v) for v in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance:
            break
        middle = points[:-1].mean(0)
        step = middle - points[-1]
        tried = [(f(v), v) for v in (middle + step,)]
        if tried[0][0] < values[0]:
            tried.append((f(middle + 2 * step), middle + 2 * step))
        elif tried[0][0] >= values[-2]:
            inside = middle + (0.5 if tried[0][0] < values[-1] else -0.5) * step
            tried.append((f(inside), inside))
        best = min(tried, key=lambda t: t[0])
        if best[0] < (values[-2] if len(tried) == 1 else values[-1]):
            points[-1], values[-1] = best[1], best[0]
        else:
            points[1:] = points[0] + (points[1:] - points[0]) / 2
            values[1:] = [f(v) for v in points[1:]]
    return points[values.argmin()]


def memberships(p: np.ndarray, pi: np.ndarray, k: int, optimise: bool = True) -> np.ndarray:
    """Fuzzy macrostates (PCCA+): the crispest non-negative memberships that the dominant eigenvectors span.

    The start is the inverse of the simplex' corner rows; the free part of the map is then moved so that the
    memberships are as crisp as possible, sum_j sum_i A_ij^2 / A_0j being largest.
    """
    x = dominant_eigenvectors(p, pi, k)
    a = np.linalg.inv(x[simplex_corners(x)])
    if k > 1:
        crisp = lambda v: -float((feasible_transform(v.reshape(k - 1, k - 1), x) ** 2 / np.maximum(feasible_transform(v.reshape(k - 1, k - 1), x)[0], 1e-300)).sum())
        start = a[1:, 1:].ravel()
        a = feasible_transform((downhill(crisp, start) if optimise else start).reshape(k - 1, k - 1), x)
    chi = np.clip(x @ a, 0, None)
    return chi / chi.sum(1, keepdims=True)


def macrostates(p: np.ndarray, k: int) -> np.ndarray | None:
    """Macrostate of each state, numbered by falling population; None if there are not more states than k."""
    if len(p) <= k:
        return None
    pi = stationary(p)
    of = memberships(p, pi, k).argmax(1)
    weight = np.array([pi[of == m].sum() for m in range(k)])
    rank = np.empty(k, int)
    rank[np.lexsort((np.arange(k), -weight))] = np.arange(k)
    return rank[of]


def committors(p: np.ndarray, pi: np.ndarray, source: list[int], sink: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward committors between disjoint sets; the latter by the time-reversed chain."""
    if not source or not sink or set(source) & set(sink):
        raise ValueError("source and sink must be non-empty and disjoint")

    def solve(m: np.ndarray, zero: list[int], one: list[int]) -> np.ndarray:
        q = np.zeros(len(m))
        q[one] = 1
        free = [i for i in range(len(m)) if i not in {*zero, *one}]
        if free:
            a = np.eye(len(free)) - m[np.ix_(free, free)]
            q[free] = np.linalg.lstsq(a, m[np.ix_(free, one)].sum(1), rcond=None)[0]
        return np.clip(q, 0, 1)

    back = np.divide(p.T * pi[None, :], pi[:, None], out=np.zeros_like(p), where=pi[:, None] > 0)
    return solve(p, source, sink), solve(back, sink, source)


def pathways(net: np.ndarray, source: list[int], sink: list[int], fraction: float = 0.99, most: int = 1000) -> list[tuple[list[int], float]]:
    """Strongest-bottleneck paths through a net flux, one after another, until ``fraction`` of it is used."""
    rest, whole, used, out = net.copy(), net[source].sum(), 0.0, []
    while whole > 0 and used < fraction * whole and len(out) < most:
        width = {i: math.inf for i in source}
        before: dict[int, int] = {}
        done: set[int] = set()
        while open_ := [i for i in width if i not in done]:
            i = max(open_, key=lambda x: (width[x], -x))
            done.add(i)
            for j in np.flatnonzero(rest[i] > 1e-300).tolist():
                w = min(width[i], rest[i, j])
                if j not in done and w > width.get(j, 0.0):
                    width[j], before[j] = w, i
        ends = [j for j in sink if j in width]
        if not ends:
            break
        at = max(ends, key=lambda j: (width[j], -j))
        path, flux = [at], float(width[at])
        while path[-1] in before:
            path.append(before[path[-1]])
        path.reverse()
        for a, b in zip(path[:-1], path[1:], strict=True):
            rest[a, b] -= flux
        used += flux
        out.append((path, flux))
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of ln Gamma: upward recurrence, then the asymptotic series."""
    x = np.asarray(x, "f8").copy()
    total = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        total[small] += 1 / x[small] ** 2
        x[small] += 1
    y = 1 / x**2
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def blur(grid: np.ndarray, sigma: float, wrap: tuple[bool, ...] | None = None) -> np.ndarray:
    """Separable Gaussian blur to four deviations; each axis wraps or reflects."""
    out = np.asarray(grid, "f8")
    reach = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in range(out.ndim):
        mode = "wrap" if wrap and wrap[axis] else "symmetric"
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode=mode)
        out = sum(w * np.take(wide, np.arange(out.shape[axis]) + k, axis) for k, w in enumerate(kernel))
    return out
