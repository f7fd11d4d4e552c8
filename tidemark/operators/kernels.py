"""NumPy work inside Arrow tasks: the moving-average filter and the conditional least-squares fit.

Everything here sees one bounded piece of one series; Spark does the splitting (see ``estimation``).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tidemark.functions.criteria import LOG_2PI

#: Largest partial autocorrelation, in modulus, of the autoregressive and of the moving-average part of a fit.
LIMIT = 0.9999
BLOCK = 64
MAX_STEPS = 100
TOLERANCE = 1e-14
ACCEPTABLE = 1e-6
MOST_DAMPING = 1e6


@lru_cache(maxsize=None)
def _lag_index(size: int) -> np.ndarray:
    """Index of the impulse response in each cell of its lower-triangular Toeplitz matrix."""
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    return np.where(lag >= 0, lag, size)


def _impulse(theta, size: int) -> list:
    h = [1.0]
    for t in range(1, size):
        total = 0.0
        for j, v in enumerate(theta[:t], 1):
            total -= v * h[t - j]
        h.append(total)
    return h


@lru_cache(maxsize=16)
def _response(theta: tuple, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Toeplitz matrix of the impulse response, and what the last values before a block do to it."""
    q = len(theta)
    impulse = np.power(-theta[0], np.arange(size)) if q == 1 else _impulse(theta, size)
    toeplitz = np.append(impulse, 0.0)[_lag_index(size)]
    inflow = np.zeros((q, q))
    for i in range(q):
        inflow[i, :q - i] = [-v for v in theta[i:]]
    return toeplitz, toeplitz[:, :q] @ inflow


def ma_filter(u: np.ndarray, theta: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """x_t = u_t - sum_j theta_j x_{t-j} for every column of ``u``; ``state[k]`` is x_{-1-k}.

    Blocks are filtered by one matrix product with the impulse response; only the last q values of a
    block travel to the next one.
    """
    u = np.asarray(u, dtype=float)
    flat = u.ndim == 1
    u = u[:, None] if flat else u
    n, m = u.shape
    q = len(theta)
    if q == 0 or n == 0:
        return u[:, 0].copy() if flat else u.copy()
    size = max(q, min(BLOCK, n))
    toeplitz, carry = _response(tuple(float(v) for v in theta), size)
    blocks = -(-n // size)
    padded = np.zeros((blocks * size, m))
    padded[:n] = u
    x = np.matmul(toeplitz, padded.reshape(blocks, size, m))
    s = np.zeros((q, m)) if state is None else np.asarray(state, dtype=float).reshape(q, m)
    for b in range(blocks):
        if b or state is not None:
            x[b] += carry @ s
        s = x[b][:-q - 1:-1] if size > q else x[b][::-1]
    out = x.reshape(blocks * size, m)[:n]
    return out[:, 0] if flat else out


def lag_matrix(w: np.ndarray, lags: int) -> np.ndarray:
    out = np.zeros((len(w), lags))
    for k in range(1, lags + 1):
        out[k:, k - 1] = w[:-k] if k < len(w) else 0.0
    return out


def residuals(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Innovations of a centred series; the first max(p, q) are 0."""
    start = max(len(phi), len(theta))
    u = w - lag_matrix(w, len(phi)) @ phi if len(phi) else w.copy()
    u[:start] = 0.0
    return ma_filter(u, theta)


def _jacobian(w, e, phi, theta):
    start = max(len(phi), len(theta))
    u = -np.hstack([lag_matrix(w, len(phi)), lag_matrix(e, len(theta))])
    u[:start] = 0.0
    return ma_filter(u, theta)


def coefficients(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of 1 - c_1 z - ... with partial autocorrelations ``r``, and their derivatives.

    Every point of the open cube has all roots outside the unit circle, so a bound on each ``r`` alone keeps a fit
    stationary or invertible.
    """
    k = len(r)
    c, slope = np.zeros(k), np.zeros((k, k))
    for m in range(k):
        head, above = c[:m].copy(), slope[:m].copy()
        c[:m] = head - r[m] * head[::-1]
        slope[:m] = above - r[m] * above[::-1]
        slope[:m, m] = -head[::-1]
        c[m], slope[m, m] = r[m], 1.0
    return c, slope


def partials(c: np.ndarray, limit: float = 0.99) -> np.ndarray:
    """Partial autocorrelations of coefficients, the inverse of ``coefficients``; each is cut to ``limit``."""
    c = np.where(np.isfinite(c), c, 0.0)
    r = np.zeros(len(c))
    for m in range(len(c) - 1, -1, -1):
        r[m] = min(max(float(c[m]), -limit), limit)
        c = (c[:m] + r[m] * c[:m][::-1]) / (1.0 - r[m] * r[m])
    return r


def coordinates(beta: np.ndarray, p: int) -> np.ndarray:
    """A start for the fit from estimates ``phi, theta`` that need not be stationary or invertible."""
    return np.concatenate([partials(beta[:p]), partials(-beta[p:])])


def parameters(r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """``phi, theta`` in one array, and their derivatives by the coordinates."""
    if p <= 1 and len(r) - p <= 1:  # one coefficient is its own partial autocorrelation
        sign = np.where(np.arange(len(r)) < p, 1.0, -1.0)
        return sign * r, np.diag(sign)
    (phi, by_phi), (theta, by_theta) = coefficients(r[:p]), coefficients(r[p:])
    slope = np.zeros((len(r), len(r)))
    slope[:p, :p], slope[p:, p:] = by_phi, -by_theta
    return np.concatenate([phi, -theta]), slope


def _start(w: np.ndarray, p: int, q: int) -> np.ndarray:
    """Hannan-Rissanen: residuals of a long autoregression stand in for the shocks."""
    n = len(w)
    long = min(max(p, q) + 4, max(1, n // 4))
    x = lag_matrix(w, long)
    coef = np.linalg.lstsq(x[long:], w[long:], rcond=None)[0]
    e = np.zeros(n)
    e[long:] = w[long:] - x[long:] @ coef
    x = np.hstack([lag_matrix(w, p), lag_matrix(e, q)])
    skip = long + q
    if n - skip <= p + q:
        return np.zeros(p + q)
    return np.linalg.lstsq(x[skip:], w[skip:], rcond=None)[0]


def _solved(system: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; the general solver is called for only where a closed form does not do."""
    if len(target) == 1 and system[0, 0] > 0:
        return target / system[0, 0]
    if len(target) == 2:
        (a, b), (_, d) = system.tolist()
        x, y = target.tolist()
        determinant = a * d - b * b
        if a > 0 and determinant > 1e-10 * a * d:
            return np.array([(d * x - b * y) / determinant, (a * y - b * x) / determinant])
    return np.linalg.lstsq(system, target, rcond=None)[0]


def _least_eigenvalue(m: np.ndarray) -> float:
    if len(m) == 1:
        return float(m[0, 0])
    if len(m) == 2:
        (a, b), (_, d) = m.tolist()
        return (a + d) / 2.0 - math.hypot((a - d) / 2.0, b)
    return float(np.linalg.eigvalsh(m)[0])


def boxed_step(best: np.ndarray, normal: np.ndarray, slope: np.ndarray, damp: float) -> np.ndarray:
    """The damped Gauss-Newton step over the box of ``LIMIT``: coordinates that meet a side stay on it."""
    system = normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12))
    wished = _solved(system, -slope)
    inside = best + wished
    if (np.abs(inside) < LIMIT).all() and (np.abs(best) < LIMIT).all():
        return wished
    fixed = ((best >= LIMIT) & (slope < 0)) | ((best <= -LIMIT) & (slope > 0))
    move = np.zeros(len(best))
    for _ in range(len(best)):
        free = np.flatnonzero(~fixed)
        if not len(free):
            break
        held = np.flatnonzero(fixed)
        wished = _solved(system[np.ix_(free, free)], -slope[free] - system[np.ix_(free, held)] @ move[held])
        move[free] = np.clip(wished, -LIMIT - best[free], LIMIT - best[free])
        out = free[move[free] != wished]
        if not len(out):
            break
        fixed[out] = True
    return move


def gain(move, normal, slope) -> float:
    """Fall of the sum of squares that the quadratic model promises."""
    return float(-(2.0 * slope @ move + move @ normal @ move))


def free_gain(best: np.ndarray, normal: np.ndarray, slope: np.ndarray) -> float:
    """What the undamped step promises over the coordinates that no side of the box holds back: 0 at a minimum over the box."""
    free = ~(((best >= LIMIT) & (slope < 0)) | ((best <= -LIMIT) & (slope > 0)))
    g = slope[free]
    return float(g @ _solved(normal[np.ix_(free, free)], g)) if len(g) else 0.0


def local_model(best: np.ndarray, gram: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrix and slope in the coordinates, from sums of products of (derivatives, residuals)."""
    k = len(best)
    turn = parameters(best, p)[1]
    return turn.T @ gram[:k, :k] @ turn, turn.T @ gram[:k, k]


def _bent(bend: np.ndarray, move: np.ndarray, turn: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Secant update of the part of the curvature that the normal matrix lacks, from the change ``turn`` of the slope over ``move``."""
    scale = float(turn @ move)
    if scale <= 1e-12 * float(np.linalg.norm(turn) * np.linalg.norm(move)):
        return bend
    lack = turn - normal @ move
    held = float(move @ bend @ move)
    bend = bend * (min(1.0, abs(float(move @ lack) / held)) if held else 1.0)
    rest = lack - bend @ move
    return bend + (np.outer(rest, turn) + np.outer(turn, rest)) / scale - float(rest @ move) / scale ** 2 * np.outer(turn, turn)


def curvature(normal: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The normal matrix with its bend, where that is still a minimum's; else without."""
    whole = normal + bend
    return whole if _least_eigenvalue(whole) > 1e-8 * np.trace(normal) / len(normal) else normal


def _model(best, gram, bend, p):
    normal, slope = local_model(best, gram, p)
    return (curvature(normal, bend[1:].reshape(normal.shape)) if bend[0] else normal), slope


def proposal(best, gram, bend, damp: float, p: int) -> np.ndarray:
    """The next point to try, for one damping."""
    return np.clip(best + boxed_step(best, *_model(best, gram, bend, p), damp), -LIMIT, LIMIT)


def settled(best, gram, bend, rss, p, tolerance: float = TOLERANCE) -> bool:
    return free_gain(best, *_model(best, gram, bend, p)) < tolerance * rss


def close_enough(best, gram, bend, rss, p) -> bool:
    """Whether a fit that ran out of steps (a flat valley of too many parameters) has at most ``ACCEPTABLE`` of its sum of squares to gain."""
    return best is not None and settled(best, gram, bend, rss, p, ACCEPTABLE)


def no_bend(k: int) -> np.ndarray:
    return np.zeros(1 + k * k)


def advance(trial, best, rss, gram, damp, bend, base, new, p):
    """Judge one trial and propose the next: damped Gauss-Newton over a box of partial autocorrelations, the same for every layout.

    ``trial`` and ``best`` are coordinates; ``new``: sums of products of (derivatives by phi and theta, residuals) at ``trial``;
    ``base``: sum of squares with no parameters; ``bend``: what secants have shown of the curvature beyond the normal matrix, after a
    mark whether the last step went as that foretold rather than as the normal matrix alone did.
    Returns ``(trial, best, rss, gram, damp, bend, done, taken)``; ``done`` means converged: the step without damping, over the
    coordinates that no side of the box holds back, promises nothing any more.  So estimates at the edge end like any other.
    """
    k = len(trial)
    r = float(new[k, k])
    r = r if math.isfinite(r) and np.isfinite(new).all() else math.inf
    if best is None and r > base and np.any(trial):  # no better than the mean alone: start from zero
        return np.zeros(k), None, rss, None, damp, bend, False, False
    taken = best is None or r < rss
    if taken:
        if best is not None:
            damp, move = max(damp / 16.0, 1e-10), trial - best
            (old, before), (normal, slope) = local_model(best, gram, p), local_model(trial, new, p)
            held = bend[1:].reshape(k, k)
            miss = [abs(rss - r - gain(move, m, before)) for m in (old, old + held)]
            bend = np.append(float(miss[1] <= miss[0]), _bent(held, move, slope - before, normal))
        best, rss, gram = trial, r, new
    else:
        damp = max(damp * 8.0, 1e-6)
    curve, slope = _model(best, gram, bend, p)
    step = boxed_step(best, curve, slope, damp)
    while damp <= MOST_DAMPING and gain(step, curve, slope) <= 0:
        damp = max(damp * 8.0, 1e-6)  # the sides cut this step into a worse one
        step = boxed_step(best, curve, slope, damp)
    done = free_gain(best, curve, slope) < TOLERANCE * rss or damp > MOST_DAMPING
    return np.clip(best + step, -LIMIT, LIMIT), best, rss, gram, damp, bend, done, taken


def _rss(w, beta, p):
    with np.errstate(all="ignore"):
        e = residuals(w, beta[:p], beta[p:])
        r = float(e @ e)
    return (r if math.isfinite(r) else math.inf), e


#: Moving-average coefficients from side to side of the box, closer together towards the sides, where sums of squares bend most.
VALLEY_GRID = LIMIT * np.sin(np.linspace(-np.pi / 2, np.pi / 2, 97))


def _ma1_sums(w: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """Sum of squares of the MA(1) residuals for each of ``thetas``."""
    e, rss = np.zeros(len(thetas)), np.zeros(len(thetas))
    for value in w[1:].tolist():
        e = value - thetas * e
        rss += e * e
    return rss


def _ma1_descend(w: np.ndarray):
    """The lowest end of the descents from all local minima of a grid: the sum of squares of an MA(1) can have several.

    A descent that crawls (the curvature all but vanishes on its way) gives way to ever finer grids between the neighbours of its start.
    """
    rss, found = _ma1_sums(w, VALLEY_GRID), []
    edged = np.concatenate([[np.inf], rss, [np.inf]])
    for i in np.flatnonzero((rss <= edged[:-2]) & (rss <= edged[2:])):
        end = _descend(w, 0, -VALLEY_GRID[i:i + 1])
        if not end[-1]:
            low, high = VALLEY_GRID[max(i - 1, 0)], VALLEY_GRID[min(i + 1, len(VALLEY_GRID) - 1)]
            while high - low > 1e-9:
                fine = np.linspace(low, high, 33)
                at = int(np.argmin(_ma1_sums(w, fine)))
                low, high = fine[max(at - 1, 0)], fine[min(at + 1, 32)]
            other = _descend(w, 0, -fine[at:at + 1])
            end = (*other[:-1], True) if other[1] <= end[1] else end
        found.append(end)
    return min(found, key=lambda f: f[1]) if found else _descend(w, 0, np.zeros(1))


def _descend(w: np.ndarray, p: int, trial: np.ndarray):
    """``best, rss, gram, bend, residuals, done`` of the descent from one point."""
    best, rss, gram, damp, bend, kept, base = None, math.inf, None, 1e-6, no_bend(len(trial)), w, float(w @ w)
    for _ in range(MAX_STEPS):
        with np.errstate(all="ignore"):
            beta = parameters(trial, p)[0]
            e = residuals(w, beta[:p], beta[p:])
            x = np.column_stack([_jacobian(w, e, beta[:p], beta[p:]), e])
            trial, best, rss, gram, damp, bend, done, taken = advance(trial, best, rss, gram, damp, bend, base, x.T @ x, p)
        kept = e if taken else kept
        if done:
            break
    if best is None:  # nothing beat the mean within the steps
        best = np.zeros(len(trial))
    return best, rss, gram, bend, kept, done


def css_fit(w: np.ndarray, p: int, q: int):
    """``(phi, theta, rss, residuals, standard errors, converged)`` of a centred series, variance concentrated out."""
    n, k = len(w), p + q
    start = max(p, q)
    if q == 0:
        x, target = lag_matrix(w, p)[start:], w[start:]
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        rss, e = _rss(w, beta, p)
        inverse = np.linalg.pinv(x.T @ x, hermitian=True)
        return beta, beta[:0], rss, e, np.sqrt(np.maximum(np.diag(inverse), 0) * rss / n), True
    if k == 1:
        best, rss, gram, bend, kept, done = _ma1_descend(w)
    else:
        best, rss, gram, bend, kept, done = _descend(w, p, coordinates(_start(w, p, q), p))
    if k > 1 and (np.abs(best) >= LIMIT).any():  # an end on a side of the box need not be the lowest: once more, from inside
        other = _descend(w, p, 0.5 * best)
        if other[-1] and other[1] < rss * (1.0 - 1e-9):
            best, rss, gram, bend, kept, done = other
    done = done or (gram is not None and close_enough(best, gram, bend, rss, p))
    if gram is None:
        return np.zeros(p), np.zeros(q), math.inf, kept, np.zeros(k), False
    inverse = np.linalg.pinv(gram[:k, :k], hermitian=True)
    beta = parameters(best, p)[0]
    return beta[:p], beta[p:], rss, kept, np.sqrt(np.maximum(np.diag(inverse), 0) * rss / n), done


NO_CONVERGENCE = f"no convergence in {MAX_STEPS} steps"


def criteria(n: int, rss: float, k: int, n_aicc: int) -> dict:
    s2 = rss / n
    ll = -n / 2.0 * (LOG_2PI + math.log(s2) + 1.0)
    spare = n_aicc - k - 1
    aic = 2.0 * k - 2.0 * ll
    return {"sigma2": s2, "log_likelihood": ll, "aic": aic, "bic": k * math.log(n) - 2.0 * ll,
            "aicc": aic + 2.0 * k * (k + 1) / spare if spare > 0 else math.inf}


def fit_order(y: np.ndarray, p: int, d: int, q: int, min_obs: int, constant: bool = True) -> dict:
    """One fit row, around the mean or (without ``constant``) around zero.  Problems become ``success = False`` with a text, never an exception."""
    row = {"p": p, "d": d, "q": q, "success": False, "phi": None, "theta": None, "c": None, "mean": None,
           "sigma2": None, "log_likelihood": None, "aic": None, "aicc": math.inf, "bic": None, "se": None,
           "n_obs": len(y), "y_tail": None, "e_tail": None, "levels": None, "error": None}
    try:
        if len(y) < min_obs:
            row["error"] = f"series too short: {len(y)} < {min_obs}"
            return row
        levels, z = [], y
        for _ in range(d):
            levels.append(float(z[-1]))
            z = np.diff(z)
        n = len(z)
        if n <= p + q + 1:
            row["error"] = f"series too short after differencing: {n}"
            return row
        mean = math.fsum(z) / n if constant else 0.0
        w = z - mean
        if p + q == 0:
            phi = theta = se = np.zeros(0)
            e, rss, converged = w, float(w @ w), True
        else:
            phi, theta, rss, e, se, converged = css_fit(w, p, q)
        if not math.isfinite(rss) or rss <= 1e-24 * max(1.0, float(z @ z)):
            row["error"] = "no variation left to fit"
            return row
        if not converged:
            row["error"] = NO_CONVERGENCE
            return row
        row.update(criteria(n, rss, p + q + 1, n), success=True, phi=phi.tolist(), theta=theta.tolist(),
                   mean=mean, c=mean * (1.0 - float(phi.sum())), se=se.tolist(), n_obs=n, levels=levels,
                   y_tail=w[::-1][:max(p, 1)].tolist(), e_tail=e[::-1][:max(q, 1)].tolist())
    except Exception as problem:  # a failing series must not fail the job
        row["error"] = f"{type(problem).__name__}: {problem}"
    return row
