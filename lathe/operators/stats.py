"""Ranks and rank correlation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_rank(df: DataFrame, value: str, tie: str, out: str, descending: bool = True) -> DataFrame:
    """Places from 1; of equal values that with the lesser ``tie`` first. For summaries: all rows meet in one task."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.col(value).desc() if descending else F.col(value), F.col(tie))).cast("long"))


def average_rank(df: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """Ranks in which equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def correlation(x: Column, y: Column, digits: int = 4) -> Column:
    """Pearson's of two columns; null if one doesn't vary."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.round(F.corr(x, y), digits))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(by..., rho, n): correlation of average ranks over rows that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "_x", by), y, "_y", by)
    # a group without variation has no correlation: corr isn't reached there
    moved = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"), F.covar_pop("_x", "_y").alias("_c"))
    return moved.select(*by, F.round(F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy"))), 4).alias("rho"), "n")


def ordinal_spearman(rank_x: Column, rank_y: Column) -> Column:
    """From places without ties: 1 - 6 sum(d^2) / (n (n^2 - 1))."""
    n = F.count("*")
    return F.round(1 - F.try_divide(6 * F.sum(F.pow(rank_x - rank_y, F.lit(2))), n * (n * n - 1)), 4)


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value by the t approximation with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return round(_beta_cdf(df / 2, 0.5, df / (df + t2)), 4)


def _beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-30, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * out


def with_p(df: DataFrame, rho: str = "rho", n: str = "n", out: str = "p_value") -> DataFrame:
    """Adds the p-value, by a Pandas UDF: there is no t distribution among the built-in functions."""
    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, k, strict=True)], dtype="float64")

    return df.withColumn(out, p(F.col(rho), F.col(n)))


def id_gaps(df: DataFrame, group: str, value: str) -> DataFrame:
    """Gaps between consecutive values of each group: (group, value, gap), the first without."""
    return df.withColumn("gap", F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(value)))


def best_significant(df: DataFrame, rho: str = "rho", p: str = "p_value", level: float = 0.05) -> DataFrame:
    """The row of the greatest correlation among those with a p-value below ``level``; of equal ones by all columns."""
    return df.where(F.col(p) < level).orderBy(F.col(rho).desc(), *df.columns).limit(1)
