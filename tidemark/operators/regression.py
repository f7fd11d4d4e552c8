"""Least squares from sums of products: the data is read once, the solve sees one row per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.layout import BY

LEAST_PIVOT = 1e-8  # of a design scaled to a unit diagonal

SOLUTION = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())),
                         T.StructField("se", T.ArrayType(T.DoubleType())),
                         T.StructField("rss", T.DoubleType())])


def product_sums(names) -> Column:
    """Upper triangle of X'X of the named columns, row by row, as one array.

    Written as text: one expression to hand over instead of several calls for each of the many cells.
    """
    cells = [f"coalesce(sum(`{a}` * `{b}`), 0D)" for i, a in enumerate(names) for b in names[i:]]
    return F.expr(f"array({', '.join(cells)})")


def square(upper, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(upper, dtype=float)
    return m + np.triu(m, 1).T


def solve(gram: np.ndarray, n: float):
    """Last column is the target.  Singular designs get the minimum-norm solution."""
    k = gram.shape[0] - 1
    xx, xy, yy = gram[:k, :k], gram[:k, k], gram[k, k]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ xy
    rss = max(float(yy - beta @ xy), 0.0)
    spare = n - k
    se = np.sqrt(np.maximum(np.diag(inverse), 0.0) * rss / spare) if spare > 0 else np.full(k, np.nan)
    return beta, se, rss


def squares(upper, k: int) -> np.ndarray:
    """``square`` of many groups at once."""
    m = np.zeros((len(upper), k, k))
    i, j = np.triu_indices(k)
    m[:, i, j] = m[:, j, i] = np.stack(list(upper)).astype(float)
    return m


def solve_many(gram: np.ndarray, n: np.ndarray):
    """``solve`` of many groups with one set of regressors: stacked matrices in, stacked ``beta, se, rss`` out."""
    k = gram.shape[1] - 1
    xx, xy, yy = gram[:, :k, :k], gram[:, :k, k], gram[:, k, k]
    diagonal = np.einsum("gii->gi", xx)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    outer = scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(xx / outer, rcond=1e-13, hermitian=True) / outer
    beta = np.einsum("gij,gj->gi", inverse, xy)
    rss = np.maximum(yy - np.einsum("gi,gi->g", beta, xy), 0.0)
    spare = np.asarray(n, dtype=float) - k
    share = np.where(spare > 0, rss / np.where(spare > 0, spare, 1.0), np.nan)
    return beta, np.sqrt(np.maximum(np.einsum("gii->gi", inverse), 0.0) * share[:, None]), rss


def nested_rss(gram: np.ndarray):
    """Residual sums of squares of the first 1, 2, .. regressors of many groups, from one elimination instead of a solve each.

    ``sound`` tells where no pivot was lost to rounding; elsewhere the caller has to solve the design itself.
    """
    k = gram.shape[1] - 1
    diagonal = np.einsum("gii->gi", gram)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    a = gram / (scale[:, :, None] * scale[:, None, :])
    rss, sound, whole = np.empty((len(gram), k)), np.empty((len(gram), k), dtype=bool), np.ones(len(gram), dtype=bool)
    for j in range(k):
        pivot = a[:, 0, 0]
        whole = whole & (pivot > LEAST_PIVOT)
        step = a[:, 0, 1:] / np.where(pivot > LEAST_PIVOT, pivot, 1.0)[:, None]
        a = a[:, 1:, 1:] - step[:, :, None] * a[:, 0, None, 1:]
        rss[:, j], sound[:, j] = a[:, -1, -1] * scale[:, -1] ** 2, whole & (a[:, -1, -1] > LEAST_PIVOT)
    return rss, sound


@F.pandas_udf(SOLUTION)
def solve_rows(upper: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = []
    for u, m in zip(upper, n):
        k = int((np.sqrt(8 * len(u) + 1) - 1) / 2)
        beta, se, rss = solve(square(u, k), float(m))
        out.append((beta.tolist(), se.tolist(), rss))
    return pd.DataFrame(out, columns=["beta", "se", "rss"])


def ols_gram(df: DataFrame, regressors, target: Column, by=BY) -> DataFrame:
    """``(by, n, beta[], se[], rss)`` of ``target`` on ``regressors``; rows with a NULL are left out."""
    cols = {f"x{i}": c for i, c in enumerate(regressors)} | {"target": target}
    rows = df.select(*by, *[c.cast("double").alias(n) for n, c in cols.items()]).dropna(subset=list(cols))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), product_sums(list(cols)).alias("g"))
    s = solve_rows("g", "n")
    return g.withColumn("s", s).select(*by, "n", "s.beta", "s.se", "s.rss")
