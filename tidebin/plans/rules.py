"""Safety rules: the first that fires sends the query to Spark as written."""

from __future__ import annotations

from dataclasses import dataclass

from .buckets import floor_to
from .model import DAY, Query
from .sqlfront import check_step


@dataclass(frozen=True)
class Limits:
    bucket: int = DAY
    high_cardinality: frozenset[str] = frozenset()  # group-by columns not worth storing
    clustered: frozenset[str] = frozenset()  # filter columns by which the source prunes better than a store
    least_seconds: int = 0  # 0 or less: no floor
    sketches: bool = False  # approx_count_distinct and approximate medians may be answered from stored sketches
    time_step: int | None = None  # a bare time column among the groups stands for buckets of so many seconds


def high_cardinality(q: Query, c: Limits) -> bool:
    return any(cols & c.high_cardinality for cols in q.dim_columns)


def clustered_filter(q: Query, c: Limits) -> bool:
    return any(cols & c.clustered for cols in q.filter_columns)


def odd_step(q: Query, c: Limits) -> bool:
    return not check_step(q)


def short_range(q: Query, c: Limits) -> bool:
    return c.least_seconds > 0 and q.span.end - q.span.start < c.least_seconds


def part_of_bucket(q: Query, c: Limits) -> bool:
    return floor_to(q.span.start, c.bucket) == floor_to(q.span.end, c.bucket) and q.span.end - q.span.start < c.bucket - 1


RULES = (high_cardinality, clustered_filter, odd_step, short_range, part_of_bucket)


def reason(q: Query, limits: Limits) -> str | None:
    """The name of the first rule that fires. No aggregate, joins, DISTINCT and the like have been refused by then."""
    return next((r.__name__ for r in RULES if r(q, limits)), None)
