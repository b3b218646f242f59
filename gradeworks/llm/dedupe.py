"""The last delivery of a record, which several problems start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_delivery(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key: the row greatest by ``order``, ties broken by the values kept.

    An aggregate of one struct, so copies of a key collapse before the shuffle and a key that holds
    a third of all rows costs no task more than the number of its partial results.  Null keys form
    one group like any other value.
    """
    rest = [c for c in keep if c not in keys and c not in order]
    packed = F.max(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("__last")
    last = df.groupBy(*keys).agg(packed)
    wanted = [c for c in keep if c not in keys]
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in wanted])
