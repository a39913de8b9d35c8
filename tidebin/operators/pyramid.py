"""Compaction of finer buckets into coarser ones, from ingredients alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Query, dim_name


def compact(parts: DataFrame, q: Query, level: int, time: str = "__t") -> DataFrame:
    """Ingredients by `level` seconds from ingredients by a divisor of it."""
    t = (F.col(time) - F.pmod(time, F.lit(level))).cast("long").alias(time)
    return parts.groupBy(*[F.col(dim_name(d)) for d in q.dims], t).agg(*[F.expr(f"{fn}({c})").alias(c) for c, (_, fn) in q.parts().items()])
