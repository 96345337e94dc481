"""Normal, t and chi-square distributions, and the tests of experiments on one-row-per-comparison tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, total = 1e-300, 1.0
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return total


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability of a larger absolute value."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p above one half, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def chi2_upper(x: float, df: int) -> float:
    """Probability of a larger value: the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def normal_p(z: Column | str) -> Column:
    """Two-sided probability of a larger absolute value, by the series of the error integral; null stays null."""
    x = F.abs(F.col(z) if isinstance(z, str) else z)
    step = lambda acc, n: F.struct((acc["t"] * x * x / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * x * x / (2 * n + 1)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("t"), x.alias("s")), step)["s"]
    inner = 1 - 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total
    return F.when(x > 10, F.lit(0.0)).when(x.isNotNull(), F.greatest(inner, F.lit(0.0)))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if b == b and b > 0 else 1.0 for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(1 - (1 - c) / 2, d) if d == d and d > 0 else 0.0 for d, c in zip(df, confidence, strict=True)])


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, int(b)) for a, b in zip(x, df, strict=True)])


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def proportion_columns(c: str, cn: str, t: str, tn: str) -> dict[str, Column]:
    """Rates, effects, pooled standard error and z of successes over sizes, unrounded."""
    a, n, b, m = (F.col(x).cast("double") for x in (c, cn, t, tn))
    p, q = _div(a, n), _div(b, m)
    pooled = _div(a + b, n + m)
    se = F.sqrt(pooled * (1 - pooled) * _div(n + m, n * m))
    return {
        "control_value": p, "treatment_value": q, "absolute_effect": q - p, "relative_effect": _div(q - p, p), "risk_ratio": _div(q, p), "odds_ratio": ((b + 0.5) * (n - a + 0.5)) / ((m - b + 0.5) * (a + 0.5)),
        "standard_error": se, "unpooled_error": F.sqrt(_div(p * (1 - p), n) + _div(q * (1 - q), m)), "statistic": _div(q - p, se),
    }


def welch_columns(cm: str, cv: str, cn: str, tm: str, tv: str, tn: str) -> dict[str, Column]:
    """Mean difference, standard error, t and Satterthwaite's degrees of freedom from means, variances and sizes."""
    a, v, n, b, w, m = (F.col(x).cast("double") for x in (cm, cv, cn, tm, tv, tn))
    x, y = _div(v, n), _div(w, m)
    se = F.sqrt(x + y)
    df = _div((x + y) * (x + y), _div(x * x, n - 1) + _div(y * y, m - 1))
    return {"control_value": a, "treatment_value": b, "absolute_effect": b - a, "relative_effect": _div(b - a, a), "standard_error": se, "statistic": _div(b - a, se), "degrees": df}


def adjusted(rows: DataFrame, family: list[str], method: str = "bh", p: str = "p_value") -> DataFrame:
    """Rows with adjusted_p within families: none, bonferroni or Benjamini-Hochberg's step-up."""
    group = Window.partitionBy(*family)
    m = F.count("*").over(group)
    if method == "none":
        value = F.col(p)
    elif method == "bonferroni":
        value = F.least(F.col(p) * m, F.lit(1.0))
    elif method == "bh":
        rows = rows.withColumn("_m", m).withColumn("_r", F.row_number().over(group.orderBy(p)))
        value = F.least(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(group.orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit(1.0))
    else:
        raise ValueError(f"no method {method}")
    return rows.withColumn("adjusted_p", F.bround(value, 6)).drop("_m", "_r")


def sample_size(baseline: Column, effect: float, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Users per arm to find an absolute effect on a rate."""
    z = NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)
    return F.ceil(F.lit(z * z) * 2 * baseline * (1 - baseline) / (effect * effect)).cast("long")
