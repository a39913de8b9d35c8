"""Semantic reuse: whether a finer stored family can answer a coarser query."""

from __future__ import annotations

from ..plans.model import Query


def extra_filters(finer: Query, q: Query) -> list[str]:
    return [f for f in q.filters if f not in finer.filters]


def subsumes(finer: Query, q: Query) -> bool:
    """Same table, a superset of groups at a grain that divides, a subset of filters, all ingredients; what remains to be filtered
    reads grouped columns only, so any deterministic predicate may be applied to stored groups."""
    if finer.table.lower() != q.table.lower() or not set(finer.dims) >= set(q.dims) or not set(finer.filters) <= set(q.filters):
        return False
    if q.grain and not (finer.grain and q.grain % finer.grain == 0):
        return False
    if not set(q.parts()) <= set(finer.parts()):
        return False
    bare = {d.replace("`", "").lower() for d in finer.dims}
    cols = dict(zip(q.filters, q.filter_columns))
    return all(cols[f] <= bare for f in extra_filters(finer, q))
