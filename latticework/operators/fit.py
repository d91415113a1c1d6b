"""Least-squares polynomials by power sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int, keys=()) -> DataFrame:
    """Coefficients c0 (constant) to c<degree> and the deviation sigma of the residuals, one row per key.

    x is centred and scaled first, which keeps the normal equations well conditioned; both passes
    are plain aggregations, and the few sums of a key are solved in a vectorised function.
    """
    col = lambda c: F.col(c).cast("double")
    rows = df.select(*keys, col(x).alias("x"), col(y).alias("y")).where("x is not null and y is not null")
    base = rows.groupBy(*keys).agg(F.avg("x").alias("mx"), F.greatest(F.coalesce(F.stddev_pop("x"), F.lit(0.0)), F.lit(1e-300)).alias("sx"))
    rows = (rows.join(base, list(keys)) if keys else rows.join(F.broadcast(base))).withColumn("u", (F.col("x") - F.col("mx")) / F.col("sx"))
    sums = [F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow("u", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]
    got = rows.groupBy(*keys, "mx", "sx").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), *sums)
    n = degree + 1

    @F.pandas_udf("array<double>")
    def solve(mx, sx, yy, s, t):
        import pandas as pd

        out = []
        for m, d, q, a, b in zip(mx, sx, yy, s, t, strict=True):
            a, b = np.asarray(a), np.asarray(b)
            c = np.linalg.lstsq(a[np.add.outer(np.arange(n), np.arange(n))], b, rcond=1e-12)[0]
            rest = max(0.0, q - float(c @ b))
            free = a[0] - n
            p = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-m / d, 1 / d])).coef
            out.append([*np.pad(p, (0, n - len(p))).tolist(), float(np.sqrt(rest / free)) if free > 0 else 0.0])
        return pd.Series(out)

    got = got.select(*keys, solve("mx", "sx", "yy", F.array(*[f"s{k}" for k in range(2 * degree + 1)]), F.array(*[f"t{k}" for k in range(n)])).alias("c"))
    return got.select(*keys, *[F.col("c")[k].alias(f"c{k}") for k in range(n)], F.col("c")[n].alias("sigma"))


def linear_fit(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """slope, intercept and sigma per key, in one aggregation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*keys, a.alias("x"), b.alias("y")).where("x is not null and y is not null")
    got = rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("xx"), F.regr_sxy("y", "x").alias("xy"), F.regr_syy("y", "x").alias("yy"), F.count(F.lit(1)).alias("n"))
    rest = F.greatest(F.lit(0.0), F.col("yy") - F.try_divide(F.col("xy") * F.col("xy"), F.col("xx")))
    return got.select(*keys, "slope", "intercept", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).otherwise(0.0).alias("sigma"))


def parabolic_fit(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """a + b x + c x^2 and sigma."""
    return polynomial_fit(df, x, y, 2, keys).withColumnsRenamed({"c0": "a", "c1": "b", "c2": "c"})
