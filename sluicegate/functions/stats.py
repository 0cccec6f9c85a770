"""Statistics as column expressions, and exact quantiles as plain functions for one-row results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed value: the 0.975 quantile of the normal distribution.
Z = 1.959963984540054


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson(k: Column | str, n: Column | str, z: float = Z, empty: float = float("nan")) -> tuple[Column, Column]:
    """Lower and upper Wilson limits of k of n; empty where n <= 0 (NaN, or 0 in the variant that shows [0, 0])."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p, z2 = k / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    side = lambda x: F.when(n > 0, x).otherwise(F.lit(empty))
    return side(F.greatest(F.lit(0.0), centre - margin)), side(F.least(F.lit(1.0), centre + margin))


def _choose_terms(n: Column, to: Column) -> Column:
    """Sum over i = 0..to of C(n, i) / 2^n, each term from the one before in log space."""
    ln2 = math.log(2)
    start = F.struct((-n * ln2).alias("l"), F.exp(-n * ln2).alias("s"))
    step = lambda a, i: F.struct((a["l"] + F.log((n - i + 1) / i)).alias("l"), (a["s"] + F.exp(a["l"] + F.log((n - i + 1) / i))).alias("s"))
    own = F.when(to >= 1, F.sequence(F.lit(1).cast("long"), to.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(own, start, step)["s"]


def _point(n: Column, k: Column) -> Column:
    ln2 = math.log(2)
    own = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(own, -n * ln2, lambda a, i: a + F.log((n - i + 1) / i)))


def mcnemar_p(b: Column | str, c: Column | str, method: str = "mid-p") -> Column:
    """Two-sided p of the discordant counts.

    exact: binomial; mid-p: exact less the point probability (1 - pmf at b = c); mid-p-doubled: twice the mid-p tail, 1 at
    b = c; asymptotic: chi-square without, chi2-cc: with continuity correction; auto: exact below 25, else chi2-cc.
    """
    b, c = _c(b).cast("double"), _c(c).cast("double")
    n, k = b + c, F.least(b, c)
    tail, point = _choose_terms(n, k), _point(n, k)
    exact = F.least(F.lit(1.0), 2 * tail)
    normal = lambda x: erfc(F.sqrt(x / 2))
    forms = {
        "exact": exact,
        "mid-p": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(b == c, 1.0).otherwise(exact) - point)),
        "mid-p-doubled": F.least(F.lit(1.0), 2 * (tail - 0.5 * point)),
        "asymptotic": normal((b - c) * (b - c) / n),
        "chi2-cc": normal(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0.0)), 2) / n),
    }
    forms["auto"] = F.when(n < 25, forms["exact"]).otherwise(forms["chi2-cc"])
    return F.when(n == 0, 1.0).otherwise(forms[method])


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series below 3, a continued fraction above (relative error < 1e-10)."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, i: F.struct((-a["t"] * x * x / i).alias("t"), (a["s"] - a["t"] * x * x / i / (2 * i + 1)).alias("s")))["s"]
    small = 1 - 2 / math.sqrt(math.pi) * series
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda a, i: x + i / 2 / a)
    return F.when(x < 3, small).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * frac))


def holm(df: DataFrame, p: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """reject: step-down, true while p <= alpha / (m - rank) for this and all smaller p (ties in the order of all columns
    given in by and p)."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = part.orderBy(p, *[c for c in df.columns if c not in (p, *by)])
    ranked = df.withColumn("_r", F.row_number().over(order) - 1).withColumn("_m", F.count(F.lit(1)).over(part))
    ok = F.col(p) <= alpha / (F.col("_m") - F.col("_r"))
    return ranked.withColumn("reject", F.min(ok.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1).drop("_r", "_m")


def benjamini_hochberg(df: DataFrame, p: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """reject: p is not above the largest p with p <= alpha rank / m."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranked = df.withColumn("_r", F.row_number().over(part.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(part))
    top = F.max(F.when(F.col(p) <= alpha * F.col("_r") / F.col("_m"), F.col(p))).over(part)
    return ranked.withColumn("reject", F.coalesce(F.col(p) <= top, F.lit(False))).drop("_r", "_m")


def resolvable_difference(n: Column | str, p: Column | str, z: float = Z) -> Column:
    """Half width of the normal interval of a difference of two proportions p on n items each."""
    n, p = _c(n), _c(p)
    return z * F.sqrt(2 * p * (1 - p) / n)


def kish(weight: Column | str) -> Column:
    """Effective sample size of weights (an aggregate)."""
    w = _c(weight)
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def hajek(weight: Column | str, value: Column | str) -> Column:
    """Weighted share (an aggregate)."""
    return F.sum(_c(weight) * _c(value)) / F.sum(_c(weight))


# Plain functions, for results of one row.


def beta_quantile(q: float, a: float, b: float) -> float:
    """By bisection on the regularized incomplete beta function."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    out = 1.0
    for i in range(400):  # continued fraction, even and odd terms
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    if n <= 0:
        return math.nan, math.nan
    a = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(a, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - a, k + 1, n - k))


def t_quantile(q: float, df: float) -> float:
    """Student's t."""
    if q < 0.5:
        return -t_quantile(1 - q, df)
    x = beta_quantile(2 * (1 - q), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x) if x else math.inf


def seed_summary(values: list[float], confidence: float = 0.95) -> tuple[float, float, float]:
    """Mean and t interval over seeds."""
    n, mean = len(values), sum(values) / len(values)
    if n < 2:
        return mean, math.nan, math.nan
    half = t_quantile(1 - (1 - confidence) / 2, n - 1) * math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1) / n)
    return mean, mean - half, mean + half


def tango_interval(b: int, c: int, n: int, z: float = Z) -> tuple[float, float]:
    """Score interval of the paired difference (b - c) / n, by bisection on the score statistic."""

    def score(d: float) -> float:
        # the restricted estimate of the probability of the second discordant cell
        big_a, big_b = 2 * n, -b - c + (2 * n - b + c) * d
        p21 = (math.sqrt(max(big_b * big_b + 4 * big_a * c * d * (1 - d) * 1.0, 0)) - big_b) / (2 * big_a)
        var = n * (2 * p21 + d * (1 - d))
        return (b - c - n * d) / math.sqrt(var) if var > 0 else math.copysign(math.inf, b - c - n * d)

    def solve(target: float) -> float:
        low, high = -1.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if score(mid) > target else (low, mid)
        return (low + high) / 2

    return solve(z), solve(-z)


def sample_size(p1: float, p2: float, z: float = Z, z_power: float = 0.8416212335729143) -> int:
    """Items that each arm needs for a difference of two proportions."""
    return math.ceil((z + z_power) ** 2 * (p1 * (1 - p1) + p2 * (1 - p2)) / (p1 - p2) ** 2)


def minimal_difference(n: int, discordance: float, z: float = Z, z_power: float = 0.8416212335729143) -> float:
    """Smallest paired difference that n items with this share of discordant pairs detect."""
    return (z + z_power) * math.sqrt(discordance / n)


def label_noise_ceiling(accuracy: float, noise: float, classes: int) -> float:
    """Measured accuracy of a perfect model when a share of the labels is uniformly wrong."""
    return accuracy * (1 - noise) + (1 - accuracy) * noise / max(classes - 1, 1)
