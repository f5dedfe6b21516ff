"""Statistics that SQL lacks: Student's t, Welch's test, adjustment of p-values, curve fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def _beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, elementwise."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.where(x > 0, x, 1)) + b * np.log(np.where(x < 1, 1 - x, 1)))
    with np.errstate(all="ignore"):
        low, high = front * _beta_fraction(a, b, x) / a, 1 - front * _beta_fraction(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    x = np.where(ok, df / (df + np.where(ok, t, 0) ** 2), 0.5)
    safe = np.where(ok, df, 1.0)
    return np.where(ok, _beta(safe / 2, np.full_like(safe, 0.5), x), np.nan)


def t_p_value(t: Column, df: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(a.to_numpy(float), b.to_numpy(float))).replace({np.nan: None})

    return F.pandas_udf(run, "double")(t, df)


def welch(groups: DataFrame, n1: str, m1: str, v1: str, n2: str, m2: str, v2: str) -> DataFrame:
    """Adds ``t, dof`` of Welch's test from counts, means and sample variances; null unless both counts exceed 1."""
    a, b = F.col(v1) / F.col(n1), F.col(v2) / F.col(n2)
    ok = (F.col(n1) > 1) & (F.col(n2) > 1) & (a + b > 0)
    t = F.when(ok, (F.col(m1) - F.col(m2)) / F.sqrt(a + b))
    dof = F.when(ok, (a + b) * (a + b) / (a * a / (F.col(n1) - 1) + b * b / (F.col(n2) - 1)))
    return groups.withColumns({"t": t, "dof": dof})


#: Ranges of p-values that are ranked on their own.
P_RANGES = 4096


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str, name: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values within ``by``: running minimum from the largest of ``p * n / rank``, at most 1; null stays null.

    Equal p-values get equal results. Values are counted before they are ranked, and ranks and
    minima are put together from those of value ranges and those within a range, so that no
    group is sorted as a whole in one task. p-values lie between 0 and 1; rows with a null key get null.
    """
    c = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_k"))
    c = c.withColumn("_b", F.floor(F.col(p) * P_RANGES).cast("int"))
    ranges = c.groupBy(*by, "_b").agg(F.sum("_k").alias("_bk"))
    w = W.partitionBy(*by).orderBy("_b")
    ranges = ranges.withColumns({"_off": F.coalesce(F.sum("_bk").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_bk").over(W.partitionBy(*by))}).drop("_bk")
    inner = W.partitionBy(*by, "_b")
    c = c.join(ranges, [*by, "_b"]).withColumn("_raw", F.col(p) * F.col("_n") / (F.col("_off") + F.sum("_k").over(inner.orderBy(p))))
    # running minimum from the largest value: downwards, as a frame that ends at the current row costs one pass
    down = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    above = c.groupBy(*by, "_b").agg(F.min("_raw").alias("_m")).select(*by, "_b", F.min("_m").over(down).alias("_above"))
    here = F.min("_raw").over(inner.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0))
    adj = c.withColumn("_here", here).join(above, [*by, "_b"]).select(*by, p, F.least(F.lit(1.0), F.col("_here"), F.coalesce("_above", F.lit(1.0))).alias(name))
    return df.join(adj, [*by, p], "left")


def fit_power(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """``a, b`` of ``y = a * x**b`` by least squares on logarithms."""
    b, a = np.polyfit(np.log(x), np.log(y), 1)
    return float(np.exp(a)), float(b)


def fit_decay(x: Sequence[float], y: Sequence[float], rounds: int = 200) -> tuple[float, float, float]:
    """``a, b, c`` of ``y = a * exp(-b * x) + c`` by Gauss-Newton steps with damping."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.array([max(y[0] - y[-1], 1e-9), 1.0 / max(np.ptp(x), 1e-9), y[-1]])
    lam = 1e-2
    cost = lambda q: float(((q[0] * np.exp(-q[1] * x) + q[2] - y) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(-p[1] * x)
        jac = np.stack([e, -p[0] * x * e, np.ones_like(x)], 1)
        r = y - (p[0] * e + p[2])
        h = jac.T @ jac
        step = np.linalg.solve(h + lam * np.diag(np.diag(h) + 1e-12), jac.T @ r)
        if cost(p + step) < cost(p):
            p, lam = p + step, lam / 3
        else:
            lam *= 4
    return float(p[0]), float(p[1]), float(p[2])
