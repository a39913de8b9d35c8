"""Mergeable sketches as columns: distinct counts and quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import LG_K


def distinct_sketch(c: str, lg_k: int = LG_K) -> Column:
    return F.hll_sketch_agg(c, lg_k)


def distinct_union(c: str) -> Column:
    return F.hll_union_agg(c)


def distinct_estimate(c: str) -> Column:
    return F.hll_sketch_estimate(c)


def quantile_sketch(c: str) -> Column:
    return F.expr(f"kll_sketch_agg_double({c})")


def quantile_union(c: str) -> Column:
    return F.expr(f"kll_merge_agg_double({c})")


def quantile(c: str, rank: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double({c}, {rank}D)")
