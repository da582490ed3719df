"""Stationarity and heteroscedasticity of series: augmented Dickey-Fuller and ARCH-LM, by symbol, from one aggregate.

Each regression is on a row's own lags, so all that it needs are sums of products of a row's lagged values: one
aggregate a group, whatever the group's length. Elimination of this small matrix, a column at a time, gives the sum of
squares of every nested model, which picks the number of lags by AIC, and the statistic of the model chosen.

Cases: a series too short for the most lags, or constant, has null statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import normal_cdf
from tidemark.operators import chunked

# fixed values: MacKinnon's response surface of the p-value for one series with a constant
TAU_MOST, TAU_LEAST, TAU_MIDDLE = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: Column) -> Column:
    poly = lambda c: sum((F.lit(a) * F.pow(tau, F.lit(i)) for i, a in enumerate(c)), F.lit(0.0))
    return F.when(tau > TAU_MOST, 1.0).when(tau < TAU_LEAST, 0.0).when(tau <= TAU_MIDDLE, normal_cdf(poly(TAU_SMALL))).otherwise(normal_cdf(poly(TAU_LARGE)))


def chi2_upper(x: Column, freedom: int) -> Column:
    """Upper tail of chi-squared for an even number of degrees of freedom, a finite sum."""
    if freedom % 2:
        raise ValueError("an even number of degrees of freedom")
    return F.exp(-x / 2) * sum((F.pow(x / 2, F.lit(k)) / math.factorial(k) for k in range(freedom // 2)), F.lit(0.0))


def products(columns: list[Column]) -> Column:
    """Sums of products of all pairs of columns, as the rows of a square matrix in one array."""
    n = len(columns)
    sums = {(i, j): F.sum(columns[i] * columns[j]) for i in range(n) for j in range(i, n)}
    return F.array(*[sums[min(i, j), max(i, j)] for i in range(n) for j in range(n)])


def elimination(matrix: Column, n: int, steps: int, shown) -> Column:
    """Array of ``shown(m)`` before elimination of column 0, 1, ... up to ``steps``; a column that depends on others is left out.

    A fold, whose state is the matrix: written out column by column the expressions would double at each.
    """

    def without(m: Column, k: Column) -> Column:
        at = lambda i, j: F.get(m, (i * n + j).cast("int"))
        pivot = at(k, k)
        return F.when(pivot > 1e-300, F.transform(m, lambda v, q: v - at(F.floor(q / n), k) * at(k, q % n) / pivot)).otherwise(m)

    start = F.struct(matrix.alias("m"), F.array().cast("array<array<double>>").alias("out"))
    step = lambda s, k: F.struct(without(s["m"], k).alias("m"), F.array_append(s["out"], shown(s["m"])).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, step)["out"]


def dickey_fuller(df: DataFrame, x: str, most: int = 10, by: str = "symbol", order: tuple[str, ...] = ("ts",), span: float = chunked.SPAN) -> DataFrame:
    """by, adf_lags, adf_statistic and adf_p: regression of the change on a constant, the level before and lagged changes.

    Lags are chosen by AIC on the rows that have ``most`` lags; the statistic is of all rows that have the lags chosen.
    """
    lagged = chunked.with_lags(df.where(F.col(x).isNotNull()), {f"_l{i}": (x, i) for i in range(1, most + 2)}, by, order, span)
    v = [F.col(x), *[F.col(f"_l{i}") for i in range(1, most + 2)]]
    known = sum((c.isNotNull().cast("int") for c in v[1:]), F.lit(0))
    changes = [F.coalesce(v[i] - v[i + 1], F.lit(0.0)) for i in range(most + 1)]
    columns = [F.lit(1.0), *changes[1:], F.coalesce(v[1], F.lit(0.0)), changes[0]]
    n, level, change = most + 3, most + 1, most + 2
    classes = lagged.where(known > 0).groupBy(by, known.alias("known")).agg(products(columns).alias("m"), F.count(F.lit(1)).alias("rows"))
    # a row that knows k values before it is in the samples of up to k - 1 lags
    samples = classes.withColumn("lags", F.explode(F.sequence(F.lit(0), F.col("known") - 1)))
    whole = samples.groupBy(by, "lags").agg(F.sum("rows").alias("rows"), F.array(*[F.sum(F.col("m")[i]) for i in range(n * n)]).alias("m0"))

    entry = lambda m, i, j: F.get(m, F.lit(i * n + j))
    path = elimination(F.col("m0"), n, most + 1, lambda m: F.array(entry(m, level, level), entry(m, level, change), entry(m, change, change)))

    def fit(e: Column, k: Column) -> Column:
        """lags, AIC and the level's t of the model of k lags, from the entries after its columns' elimination."""
        xx, xy, yy = e[0], e[1], e[2]
        ssr, free = yy - xy * xy / xx, F.col("rows") - k - 2
        ok = (xx > 1e-300) & (ssr > 0) & (free > 0)
        return F.when(ok, F.struct(k.alias("lags"), (F.col("rows") * F.ln(ssr / F.col("rows")) + 2 * (k + 2)).alias("aic"), (xy / xx / F.sqrt(ssr / free / xx)).alias("t")))

    found = F.transform(F.slice("path", 2, most + 1), fit)
    fits = whole.select(by, "rows", F.col("lags").alias("sample"), path.alias("path")).select(by, "sample", found.alias("fits"))
    best = F.array_min(F.transform(F.array_compact("fits"), lambda f: F.struct(f["aic"].alias("aic"), f["lags"].alias("lags"))))
    chosen = fits.where(F.col("sample") == most).select(F.col(by).alias("_by"), best["lags"].alias("adf_lags"))
    met = fits.join(chosen, F.col(by).eqNullSafe(F.col("_by")) & (F.col("sample") == F.col("adf_lags")))
    tau = F.col("fits")[F.col("adf_lags")]["t"]
    found = met.select(F.col("_by"), "adf_lags", tau.alias("adf_statistic"), mackinnon_p(tau).alias("adf_p"))
    return df.select(by).distinct().join(found, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def arch_lm(df: DataFrame, x: str, lags: int = 10, by: str = "symbol", order: tuple[str, ...] = ("ts",), span: float = chunked.SPAN) -> DataFrame:
    """by, arch_lm and arch_p: n R^2 of the regression of squares on their lags."""
    squared = df.where(F.col(x).isNotNull()).withColumn("_q", F.col(x) * F.col(x))
    lagged = chunked.with_lags(squared, {f"_q{i}": ("_q", i) for i in range(1, lags + 1)}, by, order, span).where(f"_q{lags} is not null")
    n = lags + 2
    table = lagged.groupBy(by).agg(products([F.lit(1.0), *[F.col(f"_q{i}") for i in range(1, lags + 1)], F.col("_q")]).alias("m0"), F.count(F.lit(1)).alias("rows"))
    table = table.withColumn("path", elimination(F.col("m0"), n, lags + 1, lambda m: F.array(F.get(m, F.lit(n * n - 1)))))
    whole, left = F.col("path")[1][0], F.col("path")[lags + 1][0]
    lm = F.when(whole > 0, F.col("rows") * (1 - left / whole))
    found = table.select(F.col(by).alias("_by"), lm.alias("arch_lm"), chi2_upper(lm, lags).alias("arch_p"))
    return df.select(by).distinct().join(found, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
