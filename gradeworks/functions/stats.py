"""Statistical expressions over counts and chances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a proportion, within 0..1; 0 and 1 without trials."""
    p = k / F.nullif(n, F.lit(0))
    base = 1 + z * z / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - half) / base), F.least(F.lit(1.0), (centre + half) / base)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def all_right_bound(n: Column, alpha: float = 0.05) -> Column:
    """The lower bound of Clopper and Pearson where all of ``n`` trials succeed."""
    return F.when(n > 0, F.pow(F.lit(alpha), 1.0 / n)).otherwise(0.0)


def bayes(prior: Column, likelihoods: Sequence[Column]) -> Column:
    """A prior times likelihoods of the same length, normalised; uniform if nothing is left.

    Null likelihoods are evidence that is missing and change nothing.
    """
    out = prior
    for one in likelihoods:
        out = F.when(one.isNull(), out).otherwise(F.zip_with(out, one, lambda a, b: a * b))
    # The product is bound to a variable first: inside a function over its entries nothing of it is evaluated again.
    even = 1.0 / F.size(prior)

    def normalised(whole: Column) -> Column:
        total = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x)
        return F.transform(whole, lambda x: F.when(total > 0, x / total).otherwise(even))

    return F.flatten(F.transform(F.array(out), normalised))


def expected_rank(soft: Column) -> Column:
    """The sum of chances weighted by their places, from 1."""
    return F.aggregate(F.zip_with(soft, F.sequence(F.lit(1), F.size(soft)), lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)


def bell(x: Column, centre: float, width: float) -> Column:
    """An unscaled normal density."""
    return F.exp(F.lit(-0.5) * F.pow((x - centre) / width, F.lit(2.0)))
