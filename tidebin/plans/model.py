"""What a cacheable query is reduced to."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

DAY, STEP = 86_400, 300
LG_K = 16  # of HLL sketches, 2^16 registers: merged counts have a standard error of 0.4 %, a fifth of the 2 % that they are held to


class Unsupported(Exception):
    """The query cannot be proved safe to split; it runs on Spark as written."""


class Refused(Exception):
    """The text is no query, so it is not run at all."""


@dataclass(frozen=True)
class TimeRange:
    """Whole epoch seconds, both ends included."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise Unsupported("the time range is empty")


@dataclass(frozen=True)
class Measure:
    """One aggregate of the query: its text, and its name among those whose parts can be stored and merged."""

    text: str
    fn: str
    arg: str

    def parts(self) -> dict[str, tuple[str, str]]:
        """Stored column -> (expression that fills it, function that merges it)."""
        key = hashlib.md5(self.arg.encode()).hexdigest()[:10]
        made = {
            "sum": {f"s_{key}": (f"sum({self.arg})", "sum")},
            "count": {f"c_{key}": (f"count({self.arg})", "sum")},
            "min": {f"n_{key}": (f"min({self.arg})", "min")},
            "max": {f"x_{key}": (f"max({self.arg})", "max")},
            "hll": {f"h_{key}": (f"hll_sketch_agg({self.arg}, {LG_K})", "hll_union_agg")},
            "kll": {f"k_{key}": (f"kll_sketch_agg_double(cast({self.arg} as double))", "kll_merge_agg_double")},
        }
        if self.fn == "avg":
            return made["sum"] | made["count"]
        if self.fn in ("var_pop", "var_samp", "stddev_pop", "stddev_samp"):
            square = f"q_{key}"
            return made["sum"] | made["count"] | {square: (f"sum(cast({self.arg} as double) * ({self.arg}))", "sum")}
        return made[self.fn]

    def final(self) -> str:
        """The aggregate's value from merged parts."""
        p = list(self.parts())
        if self.fn == "avg":
            return f"try_divide(cast({p[0]} as double), {p[1]})"
        if self.fn.startswith(("var", "stddev")):
            s, c, q = p
            less = 0 if self.fn.endswith("pop") else 1
            var = f"try_divide(greatest(0D, {q} - try_divide(cast({s} as double) * {s}, {c})), {c} - {less})"
            return f"sqrt({var})" if self.fn.startswith("stddev") else var
        if self.fn == "count":
            return f"coalesce({p[0]}, 0L)"
        if self.fn == "hll":
            return f"hll_sketch_estimate({p[0]})"
        if self.fn == "kll":
            return f"kll_sketch_get_quantile_double({p[0]}, 0.5D)"
        return p[0]


@dataclass(frozen=True)
class Query:
    table: str
    span: TimeRange
    dims: tuple[str, ...]  # group-by texts without the time bucket
    dim_columns: tuple[frozenset[str], ...]  # columns each of them reads
    filters: tuple[str, ...]  # conjuncts besides the extracted bounds, sorted
    filter_columns: tuple[frozenset[str], ...]
    measures: tuple[Measure, ...]
    items: tuple[tuple[str, str], ...]  # select texts and output names
    time_texts: tuple[str, ...] = ()  # texts that stand for the time bucket
    step: int | None = None  # of the time series; 1 keeps raw seconds
    having: str | None = None
    order: tuple[tuple[str, bool, bool], ...] = ()  # text, ascending, nulls first
    limit: int | None = None
    offset: int = 0
    node: object = field(default=None, compare=False, repr=False)  # the parsed plan
    text: str = field(default="", compare=False, repr=False)  # its SQL, where it came as such

    @property
    def grain(self) -> int | None:
        """Seconds by which time is stored; every step that 300 divides shares one family."""
        return None if self.step is None else STEP if self.step % STEP == 0 else 1

    def parts(self) -> dict[str, tuple[str, str]]:
        out: dict[str, tuple[str, str]] = {}
        for m in self.measures:
            out |= m.parts()
        return out

    def family(self, source: str, bucket: int = DAY) -> str:
        """Hash over everything a stored bucket depends on; neither the window nor aliases nor the order of clauses matter."""
        held = {"source": source, "dims": sorted(self.dims), "filters": sorted(self.filters), "parts": sorted(v[0] for v in self.parts().values()), "grain": self.grain, "bucket": bucket}
        return hashlib.md5(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dim_name(text: str) -> str:
    return "d_" + hashlib.md5(text.encode()).hexdigest()[:10]
