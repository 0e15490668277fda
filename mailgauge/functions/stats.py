"""Statistics as Column expressions; the two tails that Spark has no function for are Arrow functions over aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgauge.functions.arrow import arrow_function

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson interval (95 %) of a proportion; null without observations."""
    p, n = successes / n, n.cast("double")
    spread = 1 + Z95**2 / n
    middle = (p + Z95**2 / (2 * n)) / spread
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n)) / spread
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


#: Up to here the whole binomial tail is summed; beyond it the terms next to its end, in a number that grows with the square root.
WHOLE_TAIL = 5_000


def log_factorial(n: Column) -> Column:
    """ln n! for large n, by Stirling's series."""
    x = n + 1
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


def _large_tail(k: Column, n: Column) -> Column:
    """Binomial tail up to k at 1/2, from k downwards; the terms left out are below 1e-300 of the first."""
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    steps = F.sequence(F.lit(1), F.least(k, 40 * F.sqrt(n) + 50).cast("int"))

    def add(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.lit(1.0)
    return F.exp(first) * F.aggregate(steps, F.struct(one.alias("term"), one.alias("total")), add, lambda acc: acc["total"])


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of the discordant counts b and c: twice the binomial tail at 1/2, at most 1."""
    least, n = F.least(b, c).cast("double"), (b + c).cast("double")
    k = F.least(least, F.lit(WHOLE_TAIL)).cast("int")
    # Terms C(n, i) in logarithms, each from the one before; the largest tail is summed scaled by 2^-n.
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("total"))

    def add(acc, i):
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).when(least > WHOLE_TAIL, F.least(F.lit(1.0), 2 * _large_tail(least, n))).otherwise(F.least(F.lit(1.0), 2 * tail))


def matched_odds_ratio(b: Column, c: Column) -> Column:
    """b / c; infinite if only b is positive, null if neither is."""
    return F.when(c > 0, b / c).when(b > 0, F.lit(float("inf")))


@arrow_function("double")
def chi_square_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher p of [[a, b], [c, d]]: all tables with these margins that are no likelier."""
    row, column, n = a + b, a + c, a + b + c + d

    def log_choose(m, k):
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    def log_p(x):
        return log_choose(row, x) + log_choose(n - row, column - x) - log_choose(n, column)

    least, mode, terms = log_p(a) + 1e-7, (row + 1) * (column + 1) // (n + 2), []
    # From the likeliest table outwards; beyond e^-60 of the observed one nothing counts.
    for tables in (range(mode, max(0, column - (n - row)) - 1, -1), range(mode + 1, min(row, column) + 1)):
        for x in tables:
            p = log_p(x)
            if p < least - 60:
                break
            if p <= least:
                terms.append(math.exp(p))
    return min(1.0, math.fsum(terms))


@arrow_function("double")
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, t)) if all(v == v and v is not None for v in t) else None for t in zip(a, b, c, d, strict=True)], dtype="float64")


def adjusted(tests: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    """``tests`` with p_holm and p_fdr_bh within each family; rows without p stay out and get nulls."""
    has = F.col(p).isNotNull()
    by = Window.partitionBy(*family, has)
    order = by.orderBy(F.col(p))
    ranked = tests.withColumn("_m", F.count(p).over(by)).withColumn("_i", F.row_number().over(order))
    holm = F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(by.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col("_m") * F.col(p) / F.col("_i")).over(by.orderBy("_i").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("p_holm", F.when(has, F.least(F.lit(1.0), holm))).withColumn("p_fdr_bh", F.when(has, F.least(F.lit(1.0), bh))).drop("_m", "_i")
