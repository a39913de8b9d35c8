"""The cache engine: stored buckets and freshly computed gaps in one lazy plan."""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.dialect import to_spark
from ..plans import buckets
from ..plans.model import Query, TimeRange, Unsupported, dim_name
from ..plans.rules import Limits, reason
from ..plans.sqlfront import branches, canonicalize, over, parse, refuse_commands, run, same
from ..sources import files
from ..sources.catalog import Catalog, SourceIndex
from ..sources.store import Store
from .cube import extra_filters, subsumes


@dataclass
class Answer:
    frame: DataFrame
    cached: bool  # whether the split plan was used
    why: str = ""  # of a bypass
    stored: list[int] = field(default_factory=list)  # buckets read from the store
    computed: list[TimeRange] = field(default_factory=list)
    family: str = ""


KNOWN = 256  # families whose queries a session remembers, for reuse and warming; the least recently asked one goes first


class Engine:
    """remember: keeps votes and counts of what is asked in the store's root, so that other sessions warm by them too."""

    def __init__(self, spark: SparkSession, catalog: Catalog, store: Store | None = None, limits: Limits = Limits(), remember: bool = False):
        self.spark, self.catalog, self.store, self.limits, self.remember = spark, catalog, store or Store(spark), limits, remember
        self.known: OrderedDict[str, tuple[Query, str]] = OrderedDict()  # family -> a query of it, its source
        self.popular: Counter[str] = Counter()
        self.votes: dict[str, None] = {}
        self.indexes: dict[str, SourceIndex] = {}
        self.listed: dict[str, list[files.File]] = {}  # the files that each view was made with
        self.seen: OrderedDict[str, dict] = OrderedDict()  # what has been worked out about the last texts: their reading, schemas, expressions
        catalog.register(spark)

    # -- reading a query

    def read(self, sql) -> tuple[Query, str, str]:
        """Query, source and family of a text or a parsed plan; raises Unsupported with the reason for a bypass."""
        time = "ts"
        q = canonicalize(self.spark, sql, time, self.limits.sketches)
        try:
            table = self.catalog.find(q.table)
        except KeyError as e:
            raise Unsupported(str(e)) from e
        if table.time != time:
            q = canonicalize(self.spark, sql, table.time, self.limits.sketches)
        if self.limits.time_step and q.step == 1:
            q = replace(q, step=self.limits.time_step)
        if why := reason(q, self.limits):
            raise Unsupported(why)
        return q, table.identity, q.family(table.identity, self.limits.bucket)

    def _about(self, text: str) -> dict:
        """Notes on a text; of no text, notes that nobody keeps."""
        if not text:
            return {}
        held = self.seen.setdefault(text, {})
        self.seen.move_to_end(text)
        while len(self.seen) > KNOWN:
            self.seen.popitem(last=False)
        return held

    def _know(self, family: str, q: Query, source: str) -> None:
        self.known.setdefault(family, (q, source))
        self.known.move_to_end(family)
        while len(self.known) > KNOWN:
            self.known.popitem(last=False)

    def _index(self, q: Query) -> SourceIndex:
        table = self.catalog.find(q.table)
        if (held := self.indexes.get(q.table.lower())) is None:
            name = hashlib.md5(table.identity.encode()).hexdigest()
            held = self.indexes[q.table.lower()] = SourceIndex(self.spark, table, self.store.path(self.store.tenant, "_files", name))
        held.refresh()
        return held

    def _stamps(self, q: Query, starts: list[int]) -> dict[int, str]:
        return self._index(q).stamps(starts, self.limits.bucket) if starts else {}

    # -- ingredients

    def compute(self, q: Query, ranges: list[TimeRange], with_bucket: bool = False) -> DataFrame:
        """Ingredients of the ranges, by bucket if asked. Ranges reach the scan; ORDER BY and LIMIT do not."""
        table = self.catalog.find(q.table)
        rows = table.frame(self.spark, ranges)
        for f in q.filters:
            rows = rows.where(F.expr(f))
        keys = [F.expr(d).alias(dim_name(d)) for d in q.dims]
        t = F.col(table.time)
        if q.grain:
            keys.append((t - F.pmod(t, F.lit(q.grain))).cast("long").alias("__t"))
        if with_bucket:
            keys.append((t - F.pmod(t, F.lit(self.limits.bucket))).cast("long").alias("bucket_start"))
        return rows.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, (e, _) in q.parts().items()])

    def _stored(self, q: Query, source: str, family: str) -> tuple[DataFrame | None, list[int], list[TimeRange]]:
        """Stored rows of the family, or of the finer one that holds most buckets of the window. Only buckets whose source files are still
        the ones that they were made from count."""
        body = buckets.split(q.span, self.limits.bucket)[1]
        stamps = self._stamps(q, body)
        best, have = (family, q), self.store.covered(family, stamps) if body else {}
        for other, (finer, where) in self.known.items():
            if other != family and where == source and len(have) < len(body) and subsumes(finer, q):
                theirs = self.store.covered(other, stamps)
                if len(theirs) > len(have):
                    best, have = (other, finer), theirs
        use, ranges = buckets.gaps(q.span, have, self.limits.bucket)
        if not use:
            return None, [], ranges
        other, finer = best
        frame = self.store.read(other, [have[b] for b in use], self._schema(finer))
        for f in extra_filters(finer, q):
            bare = {d: dim_name(d) for d in finer.dims}
            frame = frame.select("*", *[F.col(c).alias(d.replace("`", "")) for d, c in bare.items()]).where(F.expr(f)).drop(*[d.replace("`", "") for d in bare])
        if other != family:
            t = [(F.col("__t") - F.pmod("__t", F.lit(q.grain))).cast("long").alias("__t")] if q.grain else []
            frame = frame.select(*[F.col(dim_name(d)) for d in q.dims], *t, *q.parts())
        return frame, use, ranges

    def _schema(self, q: Query) -> StructType:
        """Of a family's stored rows."""
        key = f"stored {q.table.lower()} {q.family('', 0)}"
        if "schema" not in (held := self._about(key)):
            held["schema"] = self.compute(q, []).schema
        return held["schema"]

    def _direct(self, node) -> DataFrame:
        """The plan as Spark runs it, over the files that the tables have now: a view keeps the listing that it was made with."""
        for t in self.catalog.tables():
            now = files.below(self.spark, t.path)
            if self.listed.get(t.name) != now:
                t.frame(self.spark).createOrReplaceTempView(t.name)
                self.listed[t.name] = now
        return run(self.spark, node)

    # -- answering

    def answer(self, sql: str, dialect: str | None = None) -> Answer:
        """A bypass and a split give the same rows, names and types. dialect: "mysql" for that spelling of functions and casts. Texts that
        are no query raise Refused. The branches of a UNION are answered each by itself."""
        if dialect is not None:
            if dialect.lower() != "mysql":
                raise ValueError(f"no dialect {dialect}")
            sql = to_spark(sql)
        held = self._about(sql)
        if "node" not in held:
            node = parse(self.spark, sql)
            refuse_commands(self.spark, node)
            held["node"] = node
        node = held["node"]
        try:
            return self._answer(node, sql)
        except Unsupported as e:
            why = str(e)
        if found := branches(node):
            parts = [self._part(b) for b in found[0]]
            if any(p.cached for p in parts):
                frame = parts[0].frame
                for p in parts[1:]:
                    frame = frame.union(p.frame)
                return Answer(frame.distinct() if found[1] else frame, True, "", *[[x for p in parts for x in of] for of in ([p.stored for p in parts], [p.computed for p in parts])], ",".join(p.family for p in parts))
        return Answer(self._direct(node), False, why)

    def _part(self, node) -> Answer:
        try:
            return self._answer(node)
        except Unsupported as e:
            return Answer(self._direct(node), False, str(e))

    def _answer(self, node, text: str = "") -> Answer:
        held = self._about(text)
        if "read" not in held:
            held["read"] = self.read(node)
        q, source, family = held["read"]
        q = replace(q, text=text)
        self._know(family, q, source)
        self.popular[family] += 1
        self._note(family, q)
        frame, use, ranges = self._stored(q, source, family)
        if frame is None:
            out = self.finish(q, self.compute(q, ranges)) if self.limits.time_step and q.step == self.limits.time_step else self._direct(node)
            return Answer(out, True, "nothing is stored", [], ranges, family)
        if ranges:
            frame = frame.unionByName(self.compute(q, ranges))
        return Answer(self.finish(q, frame), True, "", use, ranges, family)

    def finish(self, q: Query, parts: DataFrame) -> DataFrame:
        """Merges ingredients, then works out finals, HAVING, ORDER BY, OFFSET and LIMIT."""
        keys = [F.col(dim_name(d)) for d in q.dims]
        if q.step:
            keys.append((F.col("__t") - F.pmod("__t", F.lit(q.step))).cast("long").alias("__t"))
        out = parts.groupBy(*keys).agg(*[F.expr(f"{fn}({c})").alias(c) for c, (_, fn) in q.parts().items()])
        finals = {m.text: f"__m{i}" for i, m in enumerate(q.measures)}
        out = out.select("*", *[F.expr(m.final()).alias(finals[m.text]) for m in q.measures])
        swaps = {same(k): v for k, v in (finals | {d: dim_name(d) for d in q.dims} | {t: "__t" for t in q.time_texts}).items()}

        held = self._about(q.text)
        if "direct" not in held:
            held["direct"] = run(self.spark, q.node).schema  # analysis only: names and types of the direct answer
            held["over"] = {}
        direct, known = held["direct"], held["over"]

        def on_parts(text: str) -> str:
            if text not in known:
                known[text] = over(self.spark, text, swaps)
            return known[text]

        named = {f"__o{i}": F.expr(on_parts(t)).cast(f.dataType) for i, ((t, _), f) in enumerate(zip(q.items, direct))}
        out = out.select("*", *[c.alias(k) for k, c in named.items()])
        aliases = {n: f"__o{i}" for i, (_, n) in enumerate(q.items) if n}
        have = {c.lower() for c in out.columns}
        out = out.select("*", *[F.col(c).alias(n) for n, c in aliases.items() if n.lower() not in have])
        if q.having:
            out = out.where(F.expr(on_parts(q.having)))
        if q.order:
            sort = []
            for text, asc, first in q.order:
                c = F.expr(on_parts(text))
                sort.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if asc else (c.desc_nulls_first() if first else c.desc_nulls_last()))
            out = out.orderBy(*sort)
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.select(*[F.col(f"__o{i}").alias(f.name) for i, f in enumerate(direct)])

    def fetch(self, sql: str, most: int = 1_000_000) -> list:
        """Rows for a client; more than `most` is an error, found without reading them all. Where stored files turn out to be damaged, what they
        held is forgotten and computed again."""

        def read() -> list:
            return list(self.answer(sql).frame.limit(most + 1).toLocalIterator())

        try:
            rows = read()
        except Exception:
            if not sum(self.store.forget_damaged(f) for f in self.known):
                raise
            rows = read()
        if len(rows) > most:
            raise ValueError(f"the result has more than {most} rows")
        return rows

    def verify(self, sql: str, tolerance: float = 1e-9) -> bool:
        """Whether the answer and the direct one hold the same rows, numbers apart by no more than the tolerance (relative beyond 1). Rows
        are joined on everything that is not a floating number, with how often they stand there; only a count reaches the driver."""
        got, want = self.answer(sql).frame, self._direct(parse(self.spark, sql))
        if got.schema.simpleString() != want.schema.simpleString():
            return False
        loose = [i for i, f in enumerate(got.schema) if f.dataType.typeName() in ("double", "float")]
        cols = [f"c{i}" for i in range(len(got.columns))]
        keys = [c for i, c in enumerate(cols) if i not in loose]
        order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*([F.col(cols[i]) for i in loose] or [F.lit(0)]))
        a, b = (x.toDF(*cols).withColumn("at", F.row_number().over(order)) for x in (got, want))
        b = b.select(*[F.col(c).alias(f"w{c}") for c in [*cols, "at"]])
        both = a.join(b, [F.col(c).eqNullSafe(F.col(f"w{c}")) for c in [*keys, "at"]], "full")
        near = F.lit(True)
        for i in loose:
            x, y = F.col(cols[i]), F.col(f"w{cols[i]}")
            near = near & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(y)), F.lit(False)))
        return both.where(F.col("at").isNull() | F.col("wat").isNull() | ~near).limit(1).count() == 0

    # -- storing

    def _store(self, q: Query, family: str, starts: list[int], force: bool) -> dict[int, int]:
        """Stores those of the buckets that are missing, or all of them, in one job, empty ones too. Stamps are taken before the rows are
        read: what arrives meanwhile makes the bucket missing again, never wrong."""
        stamps = self._stamps(q, starts)
        have = {} if force else self.store.covered(family, stamps)
        todo = {s: stamps[s] for s in starts if s not in have}
        if not todo:
            return {}
        ranges = buckets.coalesce([TimeRange(b, b + self.limits.bucket - 1) for b in todo])
        return self.store.write(family, self.compute(q, ranges, with_bucket=True), todo)

    def warm(self, sql: str, starts: list[int] | None = None, force: bool = False, now: int | None = None) -> dict[int, int]:
        """Stores the window's whole buckets that are missing (all of them if forced); returns the rows stored by bucket."""
        q, source, family = self.read(sql)
        self._know(family, q, source)
        body = [b for b in buckets.split(q.span, self.limits.bucket)[1] if starts is None or b in starts]
        return self._store(q, family, [b for b in body if now is None or buckets.complete(b, self.limits.bucket, now)], force)

    # -- what is asked for

    def _said(self, kind: str, name: str) -> str:
        return self.store.path(self.store.tenant, f"_{kind}", name)

    def _note(self, family: str, q: Query) -> None:
        """One small file a family and session: its count, and the text that the family can be read from again."""
        if self.remember and q.text:
            files.write_text(self.spark, self._said("asked", f"{family}.{self.spark.sparkContext.applicationId}"), f"{self.popular[family]}\n{q.text}")

    def vote(self, sql: str) -> None:
        q, source, family = self.read(sql)
        self.votes.setdefault(family)
        self._know(family, q, source)
        if self.remember:
            files.write_text(self.spark, self._said("votes", family), sql)

    def recall(self) -> None:
        """Takes in the votes and counts that other sessions have left in the store's root."""
        for f in files.matching(self.spark, self._said("votes", "*")):
            self.vote(files.read_text(self.spark, f.path))
        counts: Counter[str] = Counter()
        for f in files.matching(self.spark, self._said("asked", "*")):
            n, sql = files.read_text(self.spark, f.path).split("\n", 1)
            q, source, family = self.read(sql)
            self._know(family, q, source)
            counts[family] += int(n)
        self.popular |= counts

    def warm_cycle(self, window: TimeRange, top: int = 10, now: int | None = None, force: bool = False) -> dict[str, dict[int, int]]:
        """Voted families first, then the most asked ones. Whole buckets of the window only."""
        if self.remember:
            self.recall()
        chosen = [*self.votes, *[f for f, _ in self.popular.most_common(top) if f not in self.votes]]
        self.votes.clear()
        body = [b for b in buckets.split(window, self.limits.bucket)[1] if now is None or buckets.complete(b, self.limits.bucket, now)]
        out = {}
        for family in chosen:
            if family in self.known and (done := self._store(self.known[family][0], family, body, force)):
                out[family] = done
        for f in files.matching(self.spark, self._said("votes", "*")) if self.remember else []:
            p, fs = files.at(self.spark, f.path)
            fs.delete(p, False)
        return out
