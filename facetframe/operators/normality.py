"""Tests of normality per group: Shapiro-Wilk up to 5000 values, K-squared above.

Large groups are judged from their moments, which combine before the shuffle;
only groups known to hold at most 5000 values are ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.numbers import without_nan
from facetframe.operators.filters import number_in
from facetframe.operators.frames import cell

SMALLEST = 8
LARGEST_SORTED = 5000

# Published coefficients of algorithm AS 241 (normal quantile).
QUANTILE_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
QUANTILE_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
# A published Chebyshev fit of the complementary error function.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
            -0.82215223, 0.17087277)
# Published coefficients of algorithm AS R94 (Shapiro-Wilk).
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SMALL_LOG_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_DEVIATION = (-0.4803, -0.082676, 0.0030302)


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    """c0 + c1 x + c2 x^2 + ... by Horner's rule."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, for p well inside (0, 1)."""
    q = p - 0.5
    near = F.lit(0.180625) - q * q
    far = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p))) - 1.6
    tail = polynomial(QUANTILE_TAIL[0], far) / polynomial(QUANTILE_TAIL[1], far)
    return F.when(
        F.abs(q) <= 0.425, q * polynomial(QUANTILE_CENTRE[0], near) / polynomial(QUANTILE_CENTRE[1], near)
    ).otherwise(F.signum(q) * tail)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z), relative error near 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (x * 0.5 + 1.0)
    half = t * F.exp(-x * x + polynomial(ERFC_FIT, t)) / 2.0
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def _k_squared(n: Column, g1: Column, g2: Column) -> Column:
    """Sum of the squared normal scores of skewness and kurtosis."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = (
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2.0 * (beta2 - 1.0)) - 1.0
    delta = F.lit(1.0) / F.sqrt(0.5 * F.log(w2))
    ratio = y / F.sqrt(F.lit(2.0) / (w2 - 1.0))
    z_skew = delta * F.log(ratio + F.sqrt(ratio * ratio + 1.0))

    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3.0 - expected) / F.sqrt(variance)
    root_beta = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = F.lit(8.0) / root_beta * (F.lit(2.0) / root_beta + F.sqrt(F.lit(4.0) / (root_beta * root_beta) + 1.0)) + 6.0
    base = x * F.sqrt(F.lit(2.0) / (a - 4.0)) + 1.0
    cube = F.signum(base) * F.pow(F.try_divide(F.lit(1.0) - F.lit(2.0) / a, F.abs(base)), F.lit(1.0 / 3.0))
    spread = F.lit(2.0) / (a * 9.0)
    z_kurtosis = (F.lit(1.0) - spread - cube) / F.sqrt(spread)
    return z_skew * z_skew + z_kurtosis * z_kurtosis


def _shapiro(sized: DataFrame, key: list[str]) -> DataFrame:
    """(key..., statistic, p_value); every group holds 8 to 5000 values (column `v`, size `n`)."""
    n = F.col("n").cast("double")
    ranked = sized.withColumn("i", F.row_number().over(W.partitionBy(*key).orderBy("v")))
    score = normal_quantile((F.col("i") - 0.375) / (n + 0.25))
    sums = (
        ranked.withColumn("m", score)
        .groupBy(*key, "n")
        .agg(
            F.sum(F.col("m") * F.col("m")).alias("mm"),
            F.sum(F.col("m") * F.col("v")).alias("mv"),
            F.max("m").alias("m_last"),
            F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("m_next"),
            F.max("v").alias("v_last"),
            F.min("v").alias("v_first"),
            F.max(F.when(F.col("i") == F.col("n") - 1, F.col("v"))).alias("v_next"),
            F.max(F.when(F.col("i") == 2, F.col("v"))).alias("v_second"),
            (F.var_pop("v") * F.count("v")).alias("spread"),
        )
    )
    u = F.lit(1.0) / F.sqrt(n)
    root = F.sqrt("mm")
    last = F.col("m_last") / root + polynomial(WEIGHT_LAST, u)
    following = F.col("m_next") / root + polynomial(WEIGHT_NEXT, u)
    m_last, m_next = F.col("m_last"), F.col("m_next")
    scale = F.sqrt(
        (F.col("mm") - 2.0 * m_last * m_last - 2.0 * m_next * m_next)
        / (F.lit(1.0) - 2.0 * last * last - 2.0 * following * following)
    )
    ends = F.col("v_last") - F.col("v_first")
    nexts = F.col("v_next") - F.col("v_second")
    inner = (F.col("mv") - m_last * ends - m_next * nexts) / scale
    top = inner + last * ends + following * nexts
    w = F.least(F.try_divide(top * top, F.col("spread")), F.lit(1.0))

    log_n, log_miss = F.log(n), F.log(F.lit(1.0) - F.col("w"))
    gamma = polynomial(SMALL_GAMMA, n)
    small = (
        -F.log(gamma - log_miss) - polynomial(SMALL_MEAN, n)
    ) / F.exp(polynomial(SMALL_LOG_DEVIATION, n))
    large = (log_miss - polynomial(LARGE_MEAN, log_n)) / F.exp(polynomial(LARGE_LOG_DEVIATION, log_n))
    p = (
        F.when(F.col("w") >= 1.0, F.lit(1.0))
        .when((n <= 11) & (log_miss >= gamma), F.lit(0.0))
        .otherwise(normal_upper_tail(F.when(n <= 11, small).otherwise(large)))
    )
    return sums.withColumn("w", w).select(*key, F.col("w").alias("statistic"), p.alias("p_value"))


def normality(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(by..., n, test, statistic, p_value, is_normal); groups below eight values give no row."""
    key = list(by)
    v = without_nan(number_in(df, value))
    rows = df.select(*[cell(k) for k in key], v.alias("v")).where(F.col("v").isNotNull())
    if not key:
        key = ["_all"]
        rows = rows.withColumn("_all", F.lit(1))
    sizes = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")
    )
    size = F.col("n").cast("double")
    k2 = _k_squared(size, F.col("g1"), F.col("g2"))
    large = sizes.where(F.col("n") > LARGEST_SORTED).select(
        *key,
        "n",
        F.lit("D'Agostino-Pearson").alias("test"),
        k2.alias("statistic"),
        F.exp(-k2 / 2.0).alias("p_value"),
    )
    small_sizes = sizes.where(F.col("n").between(SMALLEST, LARGEST_SORTED)).select(*key, "n")
    scores = _shapiro(rows.join(small_sizes, key), key)
    small = scores.join(small_sizes, key).select(
        *key, "n", F.lit("Shapiro-Wilk").alias("test"), "statistic", "p_value"
    )
    return large.unionByName(small).select(
        *[cell(k) for k in by],
        "n",
        "test",
        F.round("statistic", digits).alias("statistic"),
        F.round("p_value", digits).alias("p_value"),
        (F.col("p_value") > 0.05).alias("is_normal"),
    )
