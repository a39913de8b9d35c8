"""Registered tables: logical columns over files, and which files hold which seconds."""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.model import TimeRange
from . import files


@dataclass(frozen=True)
class Table:
    """columns: logical name -> SQL over the file's columns. raw_time: the file's timestamp column, on which ranges are pushed down;
    `time` is its logical name and holds whole epoch seconds."""

    name: str
    path: str
    columns: tuple[tuple[str, str], ...]
    time: str = "ts"
    raw_time: str | None = None
    fmt: str = "parquet"
    _schema: list[StructType] = field(default_factory=list, compare=False, repr=False)  # read from a file once

    def source(self, spark: SparkSession) -> DataFrame:
        if not self._schema:
            self._schema.append(spark.read.format(self.fmt).load(self.path).schema)
        return spark.read.format(self.fmt).schema(self._schema[0]).load(self.path)

    def frame(self, spark: SparkSession, ranges: list[TimeRange] | None = None) -> DataFrame:
        src = self.source(spark)
        if ranges is not None and self.raw_time:
            src = src.where(_either(ranges, F.col(self.raw_time), dict(src.dtypes)[self.raw_time]))
        out = src.select(*[F.expr(sql).alias(name) for name, sql in self.columns])
        if ranges is not None and not self.raw_time:
            out = out.where(_either(ranges, F.col(self.time), "bigint"))
        return out

    @property
    def identity(self) -> str:
        """What a stored family depends on besides the data."""
        return f"{self.path}@{self.fmt}@{self.columns}@{self.time}@{self.raw_time}"


class SourceIndex:
    """The first and last second of each source file. Only files that are new, or have changed, are looked at, in one job that reads the
    time column alone; what is known is kept in the store's root for other sessions. From this each bucket has a stamp: the names,
    lengths and times of the files that may hold rows of it. Data that arrives elsewhere leaves the bucket's stamp as it is."""

    def __init__(self, spark: SparkSession, table: Table, kept: str):
        self.spark, self.table, self.kept = spark, table, kept
        self.spans: dict[files.File, tuple[int, int] | None] = {}
        for line in (files.read_text(spark, kept) or "").splitlines():
            path, length, time, *span = line.split("\t")
            self.spans[files.File(path, int(length), int(time))] = (int(span[0]), int(span[1])) if span else None

    def refresh(self) -> None:
        now = files.below(self.spark, self.table.path)
        new = [f for f in now if f not in self.spans]
        if new:
            t = self.table
            second = F.expr(dict(t.columns)[t.time])
            src = self.spark.read.format(t.fmt).schema(t.source(self.spark).schema).load([f.path for f in new])
            found = src.select(F.col("_metadata.file_path").alias("f"), second.alias("t")).groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()  # a row a new file
            span = {_bare(r.f): (r.lo, r.hi) for r in found if r.lo is not None}
            self.spans |= {f: span.get(_bare(f.path)) for f in new}
        if new or len(now) < len(self.spans):
            self.spans = {f: self.spans[f] for f in now}
            rows = ["\t".join(map(str, (f.path, f.length, f.time, *(s or ())))) for f, s in self.spans.items()]
            files.write_text(self.spark, self.kept, "\n".join(rows))

    def stamps(self, starts: list[int], size: int) -> dict[int, str]:
        """The stamp of each bucket."""
        held: dict[int, list[str]] = {s: [] for s in starts}
        order = sorted(starts)
        for f, span in sorted(self.spans.items()):
            if span is not None:
                first, last = bisect.bisect_left(order, span[0] - size + 1), bisect.bisect_right(order, span[1])
                for s in order[first:last]:
                    held[s].append(f"{f.path} {f.length} {f.time}")
        return {s: hashlib.md5("\n".join(names).encode()).hexdigest()[:16] for s, names in held.items()}


def _bare(path: str) -> str:
    """A path as any writer of file URLs spells it."""
    from urllib.parse import unquote

    return unquote(path.split(":", 1)[-1]).lstrip("/")


def _either(ranges: list[TimeRange], c: Column, kind: str) -> Column:
    """OR of the ranges, with literals of the column's own type, so that the scan gets them."""
    out = F.lit(False)
    for n, r in enumerate(ranges):
        if kind.startswith("timestamp"):
            at = lambda s: F.expr(f"cast(timestamp_seconds({s}) as {kind})")
            one = (c >= at(r.start)) & (c < at(r.end + 1))
        else:
            one = c.between(r.start, r.end)
        out = out | one if n else one
    return out


class Catalog:
    """Names are looked up without regard to case."""

    def __init__(self, tables: list[Table] = ()):
        self._tables = {t.name.lower(): t for t in tables}

    def find(self, name: str) -> Table:
        if (t := self._tables.get(name.lower().replace("`", ""))) is None:
            raise KeyError(f"no table {name}")
        return t

    def tables(self) -> list[Table]:
        return list(self._tables.values())

    def register(self, spark: SparkSession) -> None:
        for t in self._tables.values():
            t.frame(spark).createOrReplaceTempView(t.name)
