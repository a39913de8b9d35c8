"""Stored buckets: Parquet files by family and bucket, and a marker for each bucket that is whole, even if it has no rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import files


def default_root(spark: SparkSession) -> str:
    """A fresh folder in the shared one that the session names, or, on a local master only, a temporary one where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see, or the store be given a root")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='tidebin-store-')}/store-{uuid.uuid4().hex}"


def _among(starts: list[int]) -> Column:
    """bucket_start is one of these; the bounds let a scan skip files and row groups however many they are."""
    c = F.col("bucket_start")
    return c.between(min(starts), max(starts)) & c.isin(sorted(starts))


@dataclass
class Size:
    buckets: int = 0
    bytes: int = 0


@dataclass(frozen=True, order=True)
class Marker:
    """What a marker's name says: the bucket, the rows stored for it, the stamp of the source files it was made from, the attempt whose folder
    holds it, and the bytes of that folder."""

    start: int
    rows: int
    bytes: int
    stamp: str
    attempt: str

    @property
    def name(self) -> str:
        return f"{self.start}_{self.rows}_{self.bytes}_{self.stamp}_{self.attempt}"

    @staticmethod
    def of(name: str) -> Marker:
        start, rows, size, stamp, attempt = name.split("_")
        return Marker(int(start), int(rows), int(size), stamp, attempt)


class Store:
    """root/<tenant>/<family>/<attempt>/*.parquet and root/<tenant>/<family>/_whole/<marker>. Each write has a folder of its own that its
    markers name, so that nothing counts before it is whole and two writers of a bucket don't add up. Its files hold many buckets each,
    sorted by bucket_start, so that a year of small days is a few files and a scan skips what it isn't asked for. All access goes through
    Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str | None = None, tenant: str = "default"):
        self.spark, self.root, self.tenant = spark, root or default_root(spark), tenant

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _families(self, tenant: str) -> list[str]:
        return [f.name for f in files.matching(self.spark, self.path(tenant, "*")) if f.folder and not f.name.startswith("_")]

    def tenants(self) -> list[str]:
        return [f.name for f in files.matching(self.spark, self.path("*")) if f.folder]

    def markers(self, family: str, tenant: str | None = None) -> list[Marker]:
        return [Marker.of(f.name) for f in files.matching(self.spark, self.path(tenant or self.tenant, family, "_whole", "*"))]

    def covered(self, family: str, stamps: dict[int, str] | None = None) -> dict[int, Marker]:
        """Whole buckets. One whose files are gone, or are not as long as its marker says, doesn't count, nor does one that was made from
        other source files than `stamps` tells (buckets that it doesn't name are not asked for)."""
        found = self.markers(family)
        if not found:
            return {}
        there = self._bytes(self.path(self.tenant, family, "*"))
        whole = sorted(m for m in found if not m.rows or there.get(m.attempt, 0) == m.bytes)
        return {m.start: m for m in whole if stamps is None or stamps.get(m.start) == m.stamp}

    def _bytes(self, folders: str) -> dict[str, int]:
        size: dict[str, int] = defaultdict(int)
        for f in files.matching(self.spark, f"{folders}/*.parquet"):
            size[f.path.split("/")[-2]] += f.length
        return size

    def read(self, family: str, markers: list[Marker], schema: StructType) -> DataFrame:
        """Stored rows of the marked buckets."""
        wanted: dict[str, list[int]] = defaultdict(list)
        for m in markers:
            if m.rows:
                wanted[m.attempt].append(m.start)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        held = StructType([*schema, StructField("bucket_start", LongType())])
        out = None
        for attempt, starts in wanted.items():
            part = self.spark.read.schema(held).parquet(self.path(self.tenant, family, attempt)).where(_among(starts)).drop("bucket_start")
            out = part if out is None else out.unionByName(part)
        return out

    def write(self, family: str, frame: DataFrame, stamps: dict[int, str]) -> dict[int, int]:
        """frame: bucket_start and the stored columns, of the buckets in `stamps` only. One job for all buckets; markers come after the
        files, so a failed write leaves nothing that counts. Older markers of the same buckets go; their files stay for readers that
        know them, until vacuum."""
        attempt = uuid.uuid4().hex
        base = self.path(self.tenant, family, attempt)
        frame.repartition("bucket_start").sortWithinPartitions("bucket_start").write.mode("append").option("compression", "zstd").parquet(base)
        size = self._bytes(base).get(attempt, 0)
        counts = {r.bucket_start: r["n"] for r in self.spark.read.schema("bucket_start long").parquet(base).groupBy("bucket_start").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        before = self.markers(family)
        for start, stamp in stamps.items():
            files.write_text(self.spark, self.path(self.tenant, family, "_whole", Marker(start, counts.get(start, 0), size, stamp, attempt).name), "")
        for m in before:
            if m.start in stamps:
                self._delete(self.path(self.tenant, family, "_whole", m.name))
        return {s: counts.get(s, 0) for s in stamps}

    def _delete(self, path: str) -> None:
        p, fs = files.at(self.spark, path)
        fs.delete(p, True)

    def drop_buckets(self, family: str, starts: list[int]) -> None:
        for m in self.markers(family):
            if m.start in starts:
                self._delete(self.path(self.tenant, family, "_whole", m.name))

    def forget_damaged(self, family: str) -> int:
        """Reads every column of all that is marked, and drops the markers of what can't be read; returns how many buckets went."""
        held: dict[str, list[int]] = defaultdict(list)
        for m in self.markers(family):
            if m.rows:
                held[m.attempt].append(m.start)
        gone = 0
        for attempt, starts in held.items():
            try:
                self.spark.read.parquet(self.path(self.tenant, family, attempt)).write.format("noop").mode("overwrite").save()
            except Exception:
                self.drop_buckets(family, starts)
                gone += len(starts)
        return gone

    def vacuum(self, family: str) -> int:
        """Deletes the folders of attempts that no marker names, once no reader and no writer is at work; returns how many went."""
        named = {m.attempt for m in self.markers(family)}
        gone = [f for f in files.matching(self.spark, self.path(self.tenant, family, "*")) if f.folder and not f.name.startswith("_") and f.name not in named]
        for f in gone:
            self._delete(f.path)
        return len(gone)

    def size(self, tenant: str | None = None) -> dict[str, Size]:
        """Buckets and bytes by tenant."""
        out = {}
        for t in self.tenants() if tenant is None else [tenant]:
            held = [m for f in self._families(t) for m in self.markers(f, t)]
            out[t] = Size(len(held), sum({m.attempt: m.bytes for m in held}.values()))
        return out

    def flush(self, tenant: str | None = None, family_prefix: str = "") -> int:
        """Drops families by prefix, of one tenant or of all; returns how many buckets went."""
        gone = 0
        for t in self.tenants() if tenant is None else [tenant]:
            for f in self._families(t):
                if f.startswith(family_prefix):
                    gone += len(self.markers(f, t))
                    self._delete(self.path(t, f))
        return gone
