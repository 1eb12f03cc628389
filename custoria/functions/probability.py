"""Normal and t probabilities, which Spark's built-in functions lack.

The normal functions are column expressions. They are added in steps, each a projection of its own: an expression that is
used many times, as the argument of a polynomial is, must be a column first, or it is repeated for every use.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def z_value(p: float) -> float:
    """Quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(p)


def _scaled_tail(z: float) -> float:
    """exp(z^2) erfc(z) for z >= 0: directly for small z, else by its continued fraction from the end."""
    if z < 2.0:
        return math.exp(z * z) * math.erfc(z)
    value = z
    for k in range(400, 0, -1):
        value = z + k / 2.0 / value
    return 1.0 / (math.sqrt(math.pi) * value)


def _tail_polynomial(degree: int = 30) -> list[float]:
    """Coefficients, lowest first, of log(exp(z^2) erfc(z) / t) in x = 2 t - 1, where t = 2 / (2 + z)."""

    def value(x: float) -> float:
        t = (x + 1.0) / 2.0
        return math.log(_scaled_tail(2.0 / t - 2.0) / t)

    fitted = np.polynomial.chebyshev.chebinterpolate(np.vectorize(value), degree)
    return np.polynomial.chebyshev.cheb2poly(fitted).tolist()


_TAIL = _tail_polynomial()

# Rational approximations of the normal quantile, algorithm AS 241, in three ranges; highest power first.
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _horner(x: Column, highest_first) -> Column:
    return reduce(lambda so_far, c: so_far * x + F.lit(c), highest_first[1:], F.lit(highest_first[0]))


def _ratio(x: Column, tables) -> Column:
    return _horner(x, tables[0]) / _horner(x, tables[1])


def add_normal_cdf(frame: DataFrame, z: Column, name: str) -> DataFrame:
    """Add the standard normal distribution function of `z`, accurate in both tails; null of null."""
    step = frame.withColumn("_z", z.cast("double"))
    step = step.withColumn("_a", F.abs("_z") / math.sqrt(2.0))
    step = step.withColumn("_t", F.lit(2.0) / (F.lit(2.0) + F.col("_a")))
    step = step.withColumn("_x", F.lit(2.0) * F.col("_t") - 1.0)
    tail = F.col("_t") * F.exp(_horner(F.col("_x"), _TAIL[::-1]) - F.col("_a") * F.col("_a")) / 2.0
    step = step.withColumn("_tail", tail)
    return step.withColumn(name, F.when(F.col("_z") <= 0, F.col("_tail")).otherwise(1.0 - F.col("_tail"))).drop(
        "_z", "_a", "_t", "_x", "_tail"
    )


def add_normal_quantile(frame: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the standard normal quantile of `p`; null outside of (0, 1)."""
    step = frame.withColumn("_p", F.when((p > 0) & (p < 1), p.cast("double")))
    step = step.withColumn("_q", F.col("_p") - 0.5)
    step = step.withColumn("_c", F.lit(0.180625) - F.col("_q") * F.col("_q"))
    step = step.withColumn("_r", F.sqrt(-F.log(F.least("_p", 1.0 - F.col("_p")))))
    step = step.withColumns({"_n": F.col("_r") - 1.6, "_f": F.col("_r") - 5.0})
    side = F.when(F.col("_q") < 0, -1.0).otherwise(1.0)
    value = (
        F.when(F.abs("_q") <= 0.425, F.col("_q") * _ratio(F.col("_c"), _CENTRE))
        .when(F.col("_r") <= 5.0, side * _ratio(F.col("_n"), _NEAR))
        .otherwise(side * _ratio(F.col("_f"), _FAR))
    )
    return step.withColumn(name, F.when(F.col("_p").isNotNull(), value)).drop("_p", "_q", "_c", "_r", "_n", "_f")


def add_power(frame: DataFrame, shift: Column, alpha: Column, name: str) -> DataFrame:
    """Add the power of a two-sided test at level `alpha` whose statistic is shifted by `shift`."""
    step = add_normal_quantile(frame.withColumn("_shift", shift), 1.0 - alpha / 2.0, "_cut")
    step = add_normal_cdf(step, F.col("_shift") - F.col("_cut"), "_upper")
    step = add_normal_cdf(step, -F.col("_shift") - F.col("_cut"), "_lower")
    return step.withColumn(name, F.col("_upper") + F.col("_lower")).drop("_shift", "_cut", "_upper", "_lower")


def add_power_shift(frame: DataFrame, alpha: Column, power: Column, name: str) -> DataFrame:
    """Add the shift at which a two-sided test at `alpha` has `power`; null unless 0 < alpha < power < 1.

    The closed form neglects the far tail; two Newton steps on both tails account for it.
    """
    sound = (alpha > 0) & (power > alpha) & (power < 1)
    step = frame.withColumns({"_alpha": F.when(sound, alpha), "_power": F.when(sound, power)})
    step = add_normal_quantile(step, 1.0 - F.col("_alpha") / 2.0, "_cut")
    step = add_normal_quantile(step, F.col("_power"), "_reach")
    step = step.withColumn("_d", F.greatest(F.col("_cut") + F.col("_reach"), F.lit(0.05)))
    for _ in range(2):
        step = add_normal_cdf(step, F.col("_d") - F.col("_cut"), "_upper")
        step = add_normal_cdf(step, -F.col("_d") - F.col("_cut"), "_lower")
        density = lambda x: F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
        slope = density(F.col("_d") - F.col("_cut")) - density(F.col("_d") + F.col("_cut"))
        moved = F.col("_d") - (F.col("_upper") + F.col("_lower") - F.col("_power")) / slope
        step = step.withColumn("_next", moved).drop("_d", "_upper", "_lower").withColumnRenamed("_next", "_d")
    return step.withColumn(name, F.col("_d")).drop("_d", "_alpha", "_power", "_cut", "_reach")


#: Degrees of freedom from which the normal deviate of t is expanded instead; its error is of order 1 / dof^3.
LARGE_DOF = 1e5
_MOST_TERMS = 20_000


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log(gamma(a + 1/2) / gamma(a)) without a difference of large numbers."""
    shift = np.where(a < 16.0, 16, 0)
    total = np.zeros_like(a)
    for i in range(16):
        total += np.where(i < shift, np.log((a + i) / (a + i + 0.5)), 0.0)
    b = a + shift
    return total + 0.5 * np.log(b) - 1 / (8 * b) + 1 / (192 * b**3) - 1 / (640 * b**5) + 17 / (14336 * b**7)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated forwards for all rows until all settle."""
    tiny = 1e-300
    safe = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    for m in range(1, _MOST_TERMS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / safe(1.0 + step * d)
            c = safe(1.0 + step / c)
            value = value * c * d
        if (np.abs(c * d - 1.0) < 1e-15).all():
            return value
    raise ArithmeticError("the incomplete beta function did not settle")


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t, row by row; NaN where dof is not positive."""
    t, dof = np.abs(np.asarray(t, float)), np.asarray(dof, float)
    out = np.full(t.shape, np.nan)
    good = np.isfinite(t) & (dof > 0)
    large = good & (dof >= LARGE_DOF)
    if large.any():
        v, s = dof[large], t[large]
        z = s * (1 - (s**2 + 1) / (4 * v) + (13 * s**4 + 8 * s**2 + 3) / (96 * v**2))
        out[large] = [math.erfc(max(0.0, x) / math.sqrt(2.0)) for x in z]
    small = good & ~large
    if small.any():
        v, s = dof[small], t[small]
        a, x = v / 2.0, v / (v + s * s)
        y = s * s / (v + s * s)
        with np.errstate(divide="ignore"):
            front = np.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * np.log1p(-y) + 0.5 * np.log(y))
        low = x < (a + 1.0) / (a + 2.5)
        half = np.full_like(a, 0.5)
        p = np.where(
            low,
            front * _fraction(a, half, np.where(low, x, 0.0)) / a,
            1.0 - front * _fraction(half, a, np.where(low, 0.0, y)) / 0.5,
        )
        out[small] = np.where(s == 0, 1.0, p)
    return out


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy("float64", na_value=np.nan), dof.to_numpy("float64", na_value=np.nan))
    return pd.Series(np.where(np.isnan(p), None, p), dtype="float64")
