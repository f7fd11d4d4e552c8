"""ARMA fits of series that are too long for one task.

The conditional least-squares fit needs, per step, sums of products of residuals and their derivatives.  All of them are
linear filters, so what a chunk adds is a quadratic form of the filter state it starts from: ``measure`` gives each chunk
a small matrix of sums over a basis (from a zero state, and from each state), and the state it ends in.  Two neighbours merge into
the same kind of summary (``merge``), so a pass over the data is one job without an order between chunks: summaries of chunks, of blocks of ``FAN``
chunks, of the series.

A fit starts near its end: lag products up to ``LAGS``, one aggregate, carry the whole sum of squares but for the edges of the
series and lags beyond, and the fit to these takes no data.  Each pass then sums several points at once: the minimum of the lag-product model
after its slope was set right at the best point so far (the model bends as the sum of squares does, so the distance to
the estimate falls by about the share that edges have), and the damped step of the other layout, also longer and shorter.  The best one
counts; both layouts judge it by ``kernels.advance`` and stop by the same rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import layout
from tidemark.layout import CHUNK, IDX, VALUE
from tidemark.operators import estimation, kernels, shaping
from tidemark.operators.regression import square

_ARR = T.ArrayType(T.DoubleType())
ROUNDS = kernels.MAX_STEPS
LAGS = 60
FAN = 256
#: Further trial points of a pass: the step made longer, for flat valleys; more damped ones, which count after a step that failed.
STRETCH = (2.5, 6.0)
CAUTION = (64.0, 4096.0, 262144.0)


def fit_long(s: DataFrame, orders, by, min_obs, constant: bool = True) -> DataFrame:
    """Fit rows for every order; ``s`` is in the chunked layout, ``orders`` a list of ``(p, d, q)`` or a table ``(by, p, d, q)``."""
    if isinstance(orders, DataFrame):
        tops = {r.d: (r.p, r.q) for r in orders.groupBy("d").agg(F.max("p").alias("p"), F.max("q").alias("q")).collect()}
    else:
        tops = {d: (max(o[0] for o in orders if o[1] == d), max(o[2] for o in orders if o[1] == d)) for d in {o[1] for o in orders}}
    schema = estimation.fit_schema(s, by)
    out = s.sparkSession.createDataFrame([], schema)
    for d, (p, q) in sorted(tops.items()):
        if isinstance(orders, DataFrame):
            specs = orders.filter(F.col("d") == d)
            mine = layout.join_series(s, specs.select(*by).distinct(), by)
        else:
            specs, mine = [o for o in orders if o[1] == d], s
        out = out.unionByName(_fit_at(mine, specs, d, int(p), int(q), by, min_obs, schema, constant))
    return out


def _fit_at(mine, specs, d, top_p, top_q, by, min_obs, schema, constant):
    packed = layout.durable(_pack(mine, d, max(LAGS, top_p), by, constant))
    state = layout.durable(_starts(packed, specs, top_p, top_q, by))
    context = packed.sparkSession.sparkContext
    for _ in range(ROUNDS):
        still = context.accumulator(0)  # fits that go on; its sum counts retried tasks twice, its being 0 does not change
        state = layout.durable(_round(packed, state, by, still))
        if not still.value:
            break
    return _finish(state, _facts(packed, mine, d, max(top_p, 1), by), d, by, min_obs, schema)


def _pack(mine, d, back, by, constant):
    """One row a chunk: the centred (or, without a constant, plain) differences in order, after up to ``back`` of the values before them."""
    z = layout.with_totals(shaping.difference(mine, d, by), by, _n=F.count("*"), _m=F.avg(VALUE) if constant else F.max(F.lit(0.0)))
    rows, _, _ = layout.neighbourhood(z.select(*by, CHUNK, IDX, "_n", "_m", (F.col(VALUE) - F.col("_m")).alias("_w")), back=back, by=by)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), F.col("_w").alias("v"))))
    chunks = rows.groupBy(*by, CHUNK).agg(F.max("_n").alias("n"), F.max("_m").alias("m"), F.max("_home").alias("_home"), ordered.alias("s"))
    return chunks.filter(F.col("_home") == F.col(CHUNK)).select(
        *by, CHUNK, "n", "m", F.col("s")[0]["i"].alias("first"), F.col("s.v").alias("w"))


def _facts(packed, mine, d, lags, by):
    """Length, mean, newest values and levels: what a fit row carries besides the estimates."""
    facts = packed.groupBy(*by).agg(F.max("n").alias("n"), F.max("m").alias("m"),
                                    F.max_by(F.slice(F.reverse("w"), 1, lags), CHUNK).alias("t"))
    if d:
        return facts.join(shaping.last_levels(mine, d, by), [*by])
    return facts.withColumn("levels", F.array().cast("array<double>"))


# ------------------------------------------------------------------ starts from lag products

def _lag_products(w: np.ndarray, skip: int) -> np.ndarray:
    own, padded = w[skip:], np.concatenate([np.zeros(max(LAGS - skip, 0)), w])
    at = len(padded) - len(own)
    return np.array([own @ padded[at - k:at - k + len(own)] for k in range(LAGS + 1)])


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(k), x[:len(x) - k]])


class LagModel:
    """The sum of squares as lag products carry it, with sums of products of its derivatives like those of the data."""

    def __init__(self, gamma: np.ndarray, p: int, q: int):
        self.p, self.q, self.size = p, q, len(gamma)
        self.products = gamma[np.abs(np.subtract.outer(np.arange(self.size), np.arange(self.size)))]
        self.first = np.zeros(self.size)
        self.first[0] = 1.0

    def start(self) -> np.ndarray:
        """Hannan-Rissanen: residuals of a long autoregression stand in for the shocks."""
        p, q, k = self.p, self.q, self.p + self.q
        long = min(max(p, q) + 4, self.size - 1 - q)
        ahead = self.first.copy()
        ahead[1:long + 1] = -np.linalg.lstsq(self.products[:long, :long], self.products[0, 1:long + 1], rcond=None)[0]
        basis = np.column_stack([*[_shifted(self.first, i) for i in range(1, p + 1)], *[_shifted(ahead, i) for i in range(1, q + 1)], self.first])
        gram = basis.T @ self.products @ basis
        return kernels.coordinates(np.linalg.lstsq(gram[:k, :k], gram[:k, k], rcond=None)[0], p)

    def sums(self, r: np.ndarray) -> np.ndarray:
        p, (beta, _) = self.p, kernels.parameters(r, self.p)
        ahead = self.first.copy()
        ahead[1:p + 1] = -beta[:p]
        with np.errstate(all="ignore"):
            e = kernels.ma_filter(ahead, beta[p:])
            x = np.column_stack([kernels.ma_filter(-_shifted(self.first, i), beta[p:]) for i in range(1, p + 1)]
                                + [kernels.ma_filter(-_shifted(e, i), beta[p:]) for i in range(1, self.q + 1)] + [e])
            return x.T @ self.products @ x

    def minimum(self, start: np.ndarray, true: np.ndarray | None = None) -> np.ndarray:
        """The minimum, from ``start``; with ``true``, the data's sums there, of the model with its slope and value set right at ``start``."""
        p, k = self.p, len(start)
        here = self.sums(start)
        lift = np.zeros(k) if true is None else kernels.local_model(start, true, p)[1] - kernels.local_model(start, here, p)[1]
        level = 0.0 if true is None else float(true[k, k] - here[k, k])
        trial, best, rss, gram, damp, bend = start, None, math.inf, None, 1e-6, kernels.no_bend(k)
        for _ in range(ROUNDS):
            new = self.sums(trial)
            new[:k, k] += np.linalg.lstsq(kernels.parameters(trial, p)[1].T, lift, rcond=None)[0]
            new[k, k] += level + 2.0 * float(lift @ (trial - start))
            trial, best, rss, gram, damp, bend, done, _ = kernels.advance(trial, best, rss, gram, damp, bend, math.inf, new, p)
            if done:
                break
        return start if best is None else best


_STATE = T.StructType([T.StructField("trials", T.ArrayType(_ARR)), T.StructField("best", _ARR), T.StructField("rss", T.DoubleType()),
                       T.StructField("gram", _ARR), T.StructField("tail", _ARR), T.StructField("damp", T.DoubleType()),
                       T.StructField("bend", _ARR), T.StructField("done", T.BooleanType()), T.StructField("gamma", _ARR)])


def _starts(packed, specs, top_p, top_q, by):
    def products(batches):
        for table in batches:
            size = table["chunk"] * chunk_rows - table["first"]
            table["g"] = [_lag_products(np.asarray(w), int(k)) for w, k in zip(table["w"], size)]
            yield table[[*by, "g"]]

    chunk_rows = layout.chunk_rows(packed)
    schema = T.StructType([*[packed.schema[c] for c in by], T.StructField("g", _ARR)])
    sums = (packed.select(*by, CHUNK, "first", "w").mapInPandas(products, schema).select(*by, F.posexplode("g").alias("lag", "v"))
            .groupBy(*by, "lag").agg(F.sum("v").alias("v"))
            .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lag", "v"))).alias("s")).select(*by, F.col("s.v").alias("g")))

    def start(g: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for gamma, a, b in zip(g, p, q):
            model = LagModel(np.asarray(gamma, dtype=float), int(a), int(b))
            first = model.start() if gamma[0] > 0 else np.zeros(int(a + b))
            out.append([first.tolist(), *([model.minimum(first).tolist()] if gamma[0] > 0 else [])])
        return pd.Series(out)

    if isinstance(specs, DataFrame):
        asked = specs.join(sums, [*by])
    else:
        grid = F.array(*[F.struct(*[F.lit(int(o[k])).cast("long").alias(n) for n, k in (("p", 0), ("q", 2))]) for o in specs])
        asked = sums.withColumn("_o", F.explode(grid)).select(*by, "g", "_o.p", "_o.q")
    none, k = F.lit(None), F.col("p") + F.col("q")
    return asked.select(
        *by, "p", "q", F.pandas_udf(start, T.ArrayType(_ARR))("g", "p", "q").alias("trials"), none.cast(_ARR).alias("best"),
        F.lit(math.inf).alias("rss"), none.cast(_ARR).alias("gram"), none.cast(_ARR).alias("tail"), F.lit(1e-6).alias("damp"),
        F.array_repeat(F.lit(0.0), (1 + k * k).cast("int")).alias("bend"), F.lit(False).alias("done"), F.col("g").alias("gamma"))


# ------------------------------------------------------------------ summaries of chunks

def measure(w: np.ndarray, skip: int, first: int, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products over the basis of a chunk, and the last rows of the basis, newest first.

    ``w`` holds ``skip`` values before the chunk, whose first position is ``first``.  Basis: residuals and their derivatives from a zero state;
    the residuals' (and derivatives') response to each state value; the response of each theta derivative to each
    value of the residual state.
    """
    p, q = len(phi), len(theta)
    if skip < p:
        w, skip = np.concatenate([np.zeros(p - skip), w]), p
    n = len(w) - skip
    inside = (np.arange(n) + first >= max(p, q)).astype(float)[:, None]
    past = np.column_stack([w[skip - k:skip - k + n] for k in range(1, p + 1)]) if p else np.zeros((n, 0))
    with np.errstate(all="ignore"):
        own = kernels.ma_filter(np.hstack([w[skip:, None] - (past @ phi)[:, None], -past]) * inside, theta)
        if not q:
            return own.T @ own, np.zeros((0, 1 + p))
        echo = kernels.ma_filter(np.zeros((n, q)), theta, np.eye(q))
        before, shocks = np.concatenate([np.zeros(q), own[:, 0]]), np.vstack([np.eye(q)[::-1], echo])
        lagged = [slice(q - k, q - k + n) for k in range(1, q + 1)]
        moved = kernels.ma_filter(np.column_stack([-before[at] for at in lagged]) * inside, theta)
        bent = [kernels.ma_filter(-shocks[at] * inside, theta) for at in lagged]
        basis = np.hstack([own, moved, echo, *bent])
        history = np.zeros((q, basis.shape[1]))
        history[:, 1 + p + q:1 + p + 2 * q] = np.eye(q)[::-1]
        return basis.T @ basis, np.vstack([history, basis])[:-q - 1:-1]


def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The summary of two neighbours: the basis of the first goes on over the second as a combination of the second's."""
    (sums, end), size = one, len(two[0])
    turn = np.zeros((size, size))
    turn[:1 + p + q, :1 + p + q] = np.eye(1 + p + q)
    state = slice(1 + p + q, 1 + p + 2 * q)
    turn[state] = end
    for k in range(q):
        bent = slice(1 + p + 2 * q + k * q, 1 + p + 2 * q + (k + 1) * q)
        turn[bent, 1 + p + k] = end[:, 0]
        turn[bent, bent] = end[:, state]
    return sums + turn.T @ two[0] @ turn, two[1] @ turn if q else end


def _summaries(packed, asks, by):
    """``by, p, q, trial, block, g, e``: summaries of blocks of chunks for every trial point."""
    chunk_rows = layout.chunk_rows(packed)
    names = [*by, "p", "q", "trial", CHUNK, "g", "e"]
    schema = T.StructType([*[packed.schema[c] for c in by], T.StructField("p", T.LongType()), T.StructField("q", T.LongType()),
                           T.StructField("trial", T.IntegerType()), T.StructField(CHUNK, T.LongType()), T.StructField("g", _ARR), T.StructField("e", _ARR)])

    def run(batches):
        for table in batches:
            out = []
            for t in table.itertuples(index=False):
                w, at = np.asarray(t.w, dtype=float), int(t.chunk) * chunk_rows
                for ask in t.asks:
                    p, q = int(ask["p"]), int(ask["q"])
                    for number, trial in enumerate(ask["trials"]):
                        beta = kernels.parameters(np.asarray(trial, dtype=float), p)[0]
                        g, e = measure(w, at - int(t.first), at, beta[:p], beta[p:])
                        out.append([*[getattr(t, c) for c in by], p, q, number, t.chunk, g.ravel(), e.ravel()])
            yield pd.DataFrame(out, columns=names)

    def blocks(pdf):
        pdf = pdf.sort_values(CHUNK)
        head = pdf.iloc[0].copy()
        g, e = _merged(pdf, int(head["p"]), int(head["q"]))
        head[CHUNK] //= FAN
        head["g"], head["e"] = g.ravel(), e.ravel()
        return pd.DataFrame([head.tolist()], columns=names)

    parts = packed.join(asks, [*by]).select(*by, CHUNK, "first", "w", "asks").mapInPandas(run, schema)
    return parts.groupBy(*by, "p", "q", "trial", F.expr(f"{CHUNK} div {FAN}")).applyInPandas(lambda pdf: blocks(pdf), schema)


def _merged(pdf, p, q):
    total, size = None, 1 + p + 2 * q + q * q
    for g, e in zip(pdf["g"], pdf["e"]):
        one = np.asarray(g, dtype=float).reshape(size, size), np.asarray(e, dtype=float).reshape(q, size)
        with np.errstate(all="ignore"):
            total = one if total is None else merge(total, one, p, q)
    return total


def _judged(t, blocks, p, q):
    """One row of the state table after its trial points were summed: ``kernels.advance`` from the best of them."""
    k, found = p + q, []
    keep = [*range(1, 1 + k), 0]
    for _, rows in sorted(blocks.groupby("trial")):
        g, e = _merged(rows.sort_values(CHUNK), p, q)
        found.append((float(g[0, 0]) if math.isfinite(g[0, 0]) else math.inf, g[np.ix_(keep, keep)], e[:, 0]))
    trials = [np.asarray(x, dtype=float) for x in t["trials"]]
    chosen = min(range(len(found)), key=lambda i: found[i][0])
    _, gram, tail = found[chosen]
    best = None if t["best"] is None else np.asarray(t["best"], dtype=float)
    old, gamma = None if t["gram"] is None else square(t["gram"], k + 1), np.asarray(t["gamma"], dtype=float)
    trial, best, rss, now, damp, bend, done, taken = kernels.advance(
        trials[chosen], best, float(t["rss"]), old, float(t["damp"]), np.asarray(t["bend"], dtype=float), float(gamma[0]), gram, p)
    trials = [trial]
    if best is not None and taken and not done:
        trials += [np.clip(best + k * (trial - best), -kernels.LIMIT, kernels.LIMIT) for k in STRETCH]
        trials += [kernels.proposal(best, now, bend, damp * CAUTION[1], p), LagModel(gamma, p, q).minimum(best, now)]
    elif best is not None and not done:
        trials += [kernels.proposal(best, now, bend, damp * k, p) for k in CAUTION]
    upper = None if now is None else now[np.triu_indices(k + 1)].tolist()
    return [[x.tolist() for x in trials], None if best is None else best.tolist(), rss, upper, tail.tolist() if taken else t["tail"],
            damp, bend.tolist(), bool(done), t["gamma"]]


def _round(packed, state, by, still):
    asks = state.filter("not done").groupBy(*by).agg(F.collect_list(F.struct("p", "q", "trials")).alias("asks"))
    keys = [*by, "p", "q"]
    schema = T.StructType([*[state.schema[c] for c in keys], *_STATE.fields])

    def step(blocks, rows):
        if blocks.empty or rows.empty:
            return pd.DataFrame(columns=schema.names)
        t = rows.iloc[0]
        out = _judged(t, blocks, int(t["p"]), int(t["q"]))
        still.add(0 if out[_STATE.names.index("done")] else 1)
        return pd.DataFrame([[*[t[c] for c in keys], *out]], columns=schema.names)

    summed = _summaries(packed, asks, by)
    moved = summed.groupBy(*keys).cogroup(layout.fresh(state.filter("not done")).groupBy(*keys)).applyInPandas(
        lambda blocks, rows: step(blocks, rows), schema)
    return moved.unionByName(state.filter("done"))


def _finish(state, facts, d, by, min_obs, schema):
    names = [*by, *estimation.FIT_NAMES]

    def rows(batches):
        for table in batches:
            out = []
            for t in table.itertuples(index=False):
                p, q, n = int(t.p), int(t.q), int(t.n)
                row = dict.fromkeys(estimation.FIT_NAMES)
                row.update(p=p, d=d, q=q, success=False, aicc=math.inf, n_obs=n, error="no variation left to fit")
                best = None if t.best is None else np.asarray(t.best, dtype=float)
                gram = None if t.gram is None else square(t.gram, p + q + 1)
                if n + d < estimation.minimum(p, d, q, min_obs):
                    row["error"] = f"series too short: {n + d} < {estimation.minimum(p, d, q, min_obs)}"
                elif not t.done and not kernels.close_enough(best, gram, np.asarray(t.bend, dtype=float), t.rss, p):
                    row["error"] = kernels.NO_CONVERGENCE
                elif t.rss > 0 and math.isfinite(t.rss):
                    beta = kernels.parameters(best, p)[0]
                    inverse = np.linalg.pinv(gram[:p + q, :p + q], hermitian=True)
                    row.update(kernels.criteria(n, t.rss, p + q + 1, n), success=True, phi=beta[:p].tolist(),
                               theta=beta[p:].tolist(), mean=t.m, c=t.m * (1.0 - float(beta[:p].sum())),
                               se=np.sqrt(np.maximum(np.diag(inverse), 0) * t.rss / n).tolist(), levels=list(t.levels),
                               y_tail=list(t.t)[:max(p, 1)], e_tail=list(t.tail), error=None)
                out.append([getattr(t, k) for k in by] + [row[c] for c in estimation.FIT_NAMES])
            yield pd.DataFrame(out, columns=names)

    return state.join(facts, [*by]).select(*by, "p", "q", "best", "rss", "gram", "tail", "bend", "done", "n", "m", "t", "levels") \
        .mapInPandas(rows, schema)
