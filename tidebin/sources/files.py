"""Listings through Hadoop's file systems, with one call to the JVM a folder."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

_STATUS = re.compile(r"path=(?P<path>[^;]*); isDirectory=(?P<dir>true|false); (?:length=(?P<length>\d+); )?.*?modification_time=(?P<time>\d+)")


@dataclass(frozen=True, order=True)
class File:
    path: str
    length: int
    time: int
    folder: bool = False

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


def at(spark: SparkSession, path: str):
    """Hadoop's path, and the file system that it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, found) -> list[File]:
    text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(found) if found is not None else ""
    return [File(m["path"], int(m["length"] or 0), int(m["time"]), m["dir"] == "true") for m in _STATUS.finditer(text)]


def matching(spark: SparkSession, pattern: str) -> list[File]:
    """What a glob pattern matches; none if its folder doesn't exist."""
    p, fs = at(spark, pattern)
    return _read(spark, fs.globStatus(p))


def below(spark: SparkSession, path: str) -> list[File]:
    """The data files at a path and at any depth below it; hidden ones (_ or . first) are not data."""
    out, todo = [], [path]
    while todo:
        folder = todo.pop()
        p, fs = at(spark, folder)
        for f in _read(spark, fs.listStatus(p)):
            if f.path.rstrip("/") == folder.rstrip("/") and not f.folder:
                out.append(f)  # the path is one file
            elif not f.name.startswith(("_", ".")):
                (todo if f.folder else out).append(f.path if f.folder else f)
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = at(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
