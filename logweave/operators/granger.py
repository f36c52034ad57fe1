"""Granger causality between the hourly counts of two entities (lagged OLS),
with F and chi-square tail probabilities computed here (no statistics package).

A pair's series never meets in one place: the regressions need sums of products of
lagged counts only, which are SQL aggregates; the small normal equations of
each pair are solved from one row of sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LAG = 3
MIN_POINTS = 10


def _beta_half(a2: int, x: float) -> tuple[float, float]:
    """I_x(a, 1/2) for a = ``a2`` / 2, and x^a (1-x)^(1/2) / B(a, 1/2).

    Climbs from a = 1/2 (an arc sine) or a = 1 (a square root) in steps of one:
    each step takes away t / a, where t is the second value at that a."""
    root = math.sqrt(1 - x)
    if a2 % 2:
        a, value, t = 0.5, 2 / math.pi * math.asin(math.sqrt(x)), math.sqrt(x) * root / math.pi
    else:
        a, value, t = 1.0, 1 - root, x * root / 2
    while a < a2 / 2:
        value -= t / a
        t *= x * (a + 0.5) / a
        a += 1
    return max(value, 0.0), t


def f_sf(f: float, d1: int, d2: int) -> float:
    """P(F > f) for an F(d1, d2) variable; d1 is a lag of 1, 2 or 3."""
    if not f > 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    if d1 == 2:
        return x ** (d2 / 2)
    one, t = _beta_half(int(d2), x)
    if d1 == 1:
        return one
    if d1 == 3:
        return min(1.0, one + 2 * t)
    raise ValueError("lags of 1 to 3 only")


def chi2_sf(x: float, k: int) -> float:
    """P(X > x) for a chi-square variable with ``k`` degrees of freedom: the tail of
    1 or 2 degrees, and a term for each two more."""
    if not x > 0:
        return 1.0
    tail, have = (math.erfc(math.sqrt(x / 2)), 1) if k % 2 else (math.exp(-x / 2), 2)
    while have < k:
        tail += math.exp(have / 2 * math.log(x / 2) - x / 2 - math.lgamma(have / 2 + 1))
        have += 2
    return min(tail, 1.0)


def _ssr(y: np.ndarray, X: np.ndarray) -> float:
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    r = y - X @ beta
    return float(r @ r)


def granger_pvalue(effect: np.ndarray, cause: np.ndarray, max_lag: int = MAX_LAG) -> float | None:
    """Minimum p-value over lags 1..max_lag of the SSR F, SSR chi-square and
    likelihood-ratio tests that ``cause`` helps predict ``effect``; None when
    the series are too short or degenerate."""
    y_all = np.asarray(effect, dtype=float)
    x_all = np.asarray(cause, dtype=float)
    if len(y_all) < MIN_POINTS or len(x_all) < MIN_POINTS or len(y_all) != len(x_all):
        return None
    ps = []
    for lag in range(1, max_lag + 1):
        n = len(y_all) - lag
        if n - 2 * lag - 1 <= 0:
            continue
        y = y_all[lag:]
        own = np.column_stack([y_all[lag - j: len(y_all) - j] for j in range(1, lag + 1)])
        oth = np.column_stack([x_all[lag - j: len(x_all) - j] for j in range(1, lag + 1)])
        one = np.ones((n, 1))
        xr = np.hstack([one, own])
        xu = np.hstack([one, own, oth])
        if np.linalg.matrix_rank(xu) < xu.shape[1]:
            return None
        ssr_r, ssr_u = _ssr(y, xr), _ssr(y, xu)
        if ssr_u <= 0:
            return None
        df_u = n - xu.shape[1]
        fstat = (ssr_r - ssr_u) / ssr_u / lag * df_u
        ps.append(f_sf(fstat, lag, df_u))
        ps.append(chi2_sf(n * (ssr_r - ssr_u) / ssr_u, lag))
        llf = lambda s: -n / 2.0 * (math.log(2 * math.pi) + math.log(s / n) + 1)
        ps.append(chi2_sf(-2 * (llf(ssr_r) - llf(ssr_u)), lag))
    return min(ps) if ps else None


#: A fit that leaves less of the sum of squares than this is perfect, and no test.
PERFECT = 1e-10


def _variables(lag: int) -> list[Column]:
    """Regressors and regressed variable of one lag: 1, own lags, lags of the other, y."""
    return [F.lit(1.0), *[F.col(f"_y{j}") for j in range(1, lag + 1)], *[F.col(f"_x{j}") for j in range(1, lag + 1)], F.col("_y0")]


def _sums(lag: int) -> list[Column]:
    """The upper triangle of the Gram matrix of :func:`_variables`, over the points that have the lag."""
    v = _variables(lag)
    return [F.sum(F.when(F.col("_i") > lag, v[i] * v[j])) for i in range(len(v)) for j in range(i, len(v))]


def _residual(gram: np.ndarray, keep: list[int]) -> float | None:
    """Sum of squared residuals of the last variable on those of ``keep``; None if they depend on each other."""
    a, b, yy = gram[np.ix_(keep, keep)], gram[keep, -1], gram[-1, -1]
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return None
    a, b = a / scale[:, None] / scale, b / scale
    if np.linalg.matrix_rank(a, tol=1e-10) < len(keep):
        return None
    return float(yy - b @ np.linalg.solve(a, b))


def pvalue_of_sums(n_points: int, sums: list[list[float]]) -> float | None:
    """As :func:`granger_pvalue`, from the Gram sums of each lag."""
    if n_points < MIN_POINTS:
        return None
    ps = []
    for lag, upper in enumerate(sums, 1):
        n, size = n_points - lag, 2 * lag + 2
        if n - 2 * lag - 1 <= 0:
            continue
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = np.asarray(upper, dtype=float)
        gram = np.triu(gram) + np.triu(gram, 1).T
        ssr_u, ssr_r = _residual(gram, list(range(size - 1))), _residual(gram, list(range(lag + 1)))
        if ssr_u is None or ssr_r is None or ssr_u <= PERFECT * gram[-1, -1]:
            return None
        gain = max(ssr_r - ssr_u, 0.0) / ssr_u
        df_u = n - size + 1
        ps += [f_sf(gain / lag * df_u, lag, df_u), chi2_sf(n * gain, lag), chi2_sf(n * math.log1p(gain), lag)]
    return min(ps) if ps else None


def hourly_series(events: DataFrame, pairs: DataFrame, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Zero-filled hourly counts of both entities of each pair over the pair's span."""
    h = events.groupBy(F.col(entity).alias("e"), F.date_trunc("hour", F.col(ts)).alias("hour")) \
              .agg(F.count(F.lit(1)).alias("n"))
    span = h.groupBy("e").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    p = pairs.select("source_entity", "target_entity").distinct()
    p = p.join(span.withColumnRenamed("e", "source_entity").withColumnRenamed("lo", "lo_s").withColumnRenamed("hi", "hi_s"),
               "source_entity").join(span.withColumnRenamed("e", "target_entity"), "target_entity")
    p = p.select("source_entity", "target_entity", F.explode(F.sequence(
        F.least("lo_s", "lo"), F.greatest("hi_s", "hi"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    hs = h.select(F.col("e").alias("source_entity"), "hour", F.col("n").alias("n_source"))
    ht = h.select(F.col("e").alias("target_entity"), "hour", F.col("n").alias("n_target"))
    return p.join(hs, ["source_entity", "hour"], "left").join(ht, ["target_entity", "hour"], "left").na.fill(0, ["n_source", "n_target"])


def granger(series: DataFrame) -> DataFrame:
    """CG6: (source_entity, target_entity, n_points, p_value) per pair."""
    key = ["source_entity", "target_entity"]
    w = Window.partitionBy(*key).orderBy("hour")
    x = series.select(*key, "hour", F.col("n_target").cast("double").alias("_y0"), F.col("n_source").cast("double").alias("_x0"))
    x = x.select("*", F.row_number().over(w).alias("_i"),
                 *[F.coalesce(F.lag(f"_{v}0", j).over(w), F.lit(0.0)).alias(f"_{v}{j}") for v in "yx" for j in range(1, MAX_LAG + 1)])
    g = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"),
                            *[s.alias(f"_s{lag}_{i}") for lag in range(1, MAX_LAG + 1) for i, s in enumerate(_sums(lag))])
    sums = F.array(*[F.array(*[F.coalesce(f"_s{lag}_{i}", F.lit(0.0)) for i in range((2 * lag + 2) * (2 * lag + 3) // 2)])
                     for lag in range(1, MAX_LAG + 1)])

    @F.pandas_udf("double")
    def solve(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([pvalue_of_sums(a, b) for a, b in zip(n, s)], dtype="float64")
    return g.select(*key, "n_points", solve("n_points", sums).alias("p_value")) \
            .withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))
