"""Singular values and right vectors of a triangular matrix: bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
#: Neighbouring eigenvalues closer than this part of their size are one cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3
#: Steps of inverse iteration in a cluster.
STEPS = 4


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, reflectors of the columns) of a square matrix, by Householder reflections."""
    a = np.array(r, float)
    n = len(a)
    right: list[np.ndarray] = []
    for k in range(n):
        u = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector whose reflection puts all of ``x`` on its first entry; zero where nothing is to do."""
    u = np.array(x, float)
    size = np.abs(u[1:]).max() if len(u) > 1 else 0.0
    if size == 0:
        return np.zeros_like(u)
    u /= max(size, abs(u[0]))
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u / np.linalg.norm(u)


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step; none where the shift is beyond the smallest eigenvalue."""
    n, d = len(q), q[0] - shift
    new_q, new_e, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = top = d + e[i]
        if top < TINY:
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def _lower_bound(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, less what couples them to the rest."""
    n = len(q)
    a, b, c = q[-2] + (e[n - 3] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    middle, half = (a + c) / 2, (a - c) / 2
    low = middle - np.hypot(half, np.sqrt(b))
    return max(0.0, float(low - (np.sqrt(q[-3] * e[-2]) if n > 2 else 0.0)))


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by the differential qd algorithm with shifts.

    A step only multiplies, divides and adds what is not negative, but for the
    shift, so small values keep their digits. A shift that proves too large is
    cut to a quarter, at last to zero, which never fails.
    """
    q, e = np.square(diagonal, dtype=float), np.square(above, dtype=float)
    scale = max(q.max(initial=0.0), e.max(initial=0.0))
    if scale == 0:
        return np.zeros(len(q))
    parts, found = [((q / scale).tolist(), (e / scale).tolist(), 0.0)], []
    while parts:
        q, e, total = parts.pop()
        guess = 0.0
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1])) or e[i] < TINY), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], total))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[-1] > 1.5 * q[0]:  # the small end goes last
                q, e = q[::-1], e[::-1]
            shift = max(_lower_bound(q, e), guess)
            while (done := _transform(q, e, shift)) is None:
                shift = shift / 4 if shift > EPS * (total + min(q)) else 0.0
            q, e, least = done
            total += shift
            guess = 0.75 * least if shift == 0 and least > EPS * total else 0.0
        found.extend(x + total for x in q)
    return np.sort(np.array(found))[::-1] * scale


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, ...]:
    """Factors of LDL' - value from above and from below, and what is left at each place where they could meet."""
    n = len(d)
    plus, l_plus, s = np.empty(n), np.empty(n - 1), np.empty(n)
    minus, u_minus, p = np.empty(n), np.empty(n - 1), np.empty(n)
    floor = EPS * EPS * max(float(np.abs(d).max()), TINY) + TINY
    s[0] = -value
    for i in range(n - 1):
        # A pivot that vanishes is moved, and with it what it was made of.
        if abs(s[i] + d[i]) <= floor:
            s[i] = floor - d[i]
        plus[i] = s[i] + d[i] or floor
        l_plus[i] = d[i] * low[i] / plus[i]
        s[i + 1] = l_plus[i] * low[i] * s[i] - value
    plus[-1] = s[-1] + d[-1] if abs(s[-1] + d[-1]) > floor else floor
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        coupled = d[i] * low[i] * low[i]
        if abs(coupled + p[i + 1]) <= floor:
            p[i + 1] = floor - coupled
        minus[i + 1] = coupled + p[i + 1] or floor
        ratio = d[i] / minus[i + 1]
        u_minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    minus[0] = p[0] if abs(p[0]) > floor else floor
    left = s + p + value
    return plus, l_plus, minus, u_minus, np.where(np.abs(left) > floor, left, floor)


def _eigenvector(factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Unit vector from the factors that meet where least is left."""
    _, l_plus, _, u_minus, left = factors
    n, z = len(left), np.zeros(len(left))
    at = int(np.argmin(np.abs(left)))
    z[at] = 1
    for i in range(at - 1, -1, -1):
        z[i] = -l_plus[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -u_minus[i] * z[i]
    return z / np.linalg.norm(z)


def _solved(factors: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Solution of (LDL' - value) y = x, up to its length."""
    plus, l_plus, minus, u_minus, left = factors
    n, at = len(left), int(np.argmin(np.abs(left)))
    u = np.array(x)
    for i in range(1, at + 1):
        u[i] -= l_plus[i - 1] * u[i - 1]
    for i in range(n - 2, at - 1, -1):
        u[i] -= u_minus[i] * u[i + 1]
    y = np.concatenate((u[:at] / plus[:at], [u[at] / left[at]], u[at + 1 :] / minus[at + 1 :]))
    for i in range(at - 1, -1, -1):
        y[i] -= l_plus[i] * y[i + 1]
    for i in range(at, n - 1):
        y[i + 1] -= u_minus[i] * y[i]
    return y / np.linalg.norm(y)


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values of ``r``, falling; unit right vectors of the first ``k`` as columns).

    A value apart from its neighbours gets its vector from the factorisation that
    is twisted where least is left. In a cluster, where that would give nearly
    the same vector twice, inverse iteration with the same factors starts from
    vectors drawn from a fixed seed, each made orthogonal to those before.
    """
    n = len(r)
    a, b, reflectors = bidiagonal(r)
    values = squared_singular_values(a, b)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    k = min(k, int((values > (n * EPS * size) ** 2).sum()))
    if k == 0:
        return values, np.zeros((n, 0))
    a = np.where(np.abs(a) < EPS * size, np.copysign(EPS * size, a), a)
    d, low = a * a, b / a[:-1]
    close = values[1:] > values[:-1] * (1 - CLUSTER)
    rng = np.random.default_rng(0)
    out: list[np.ndarray] = []
    for j in range(k):
        factors = _twisted(d, low, float(values[j]))
        first = j
        while first and close[first - 1]:
            first -= 1
        if first == j and not (j < n - 1 and close[j]):
            out.append(_eigenvector(factors))
            continue
        z = rng.standard_normal(n)
        for _ in range(STEPS):
            z = _solved(factors, z)
            for _ in range(2):
                for other in out[first:j]:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
        out.append(z)
    vectors = np.stack(out, axis=1)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values, vectors
