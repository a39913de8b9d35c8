"""Session settings from three knobs (memory, cores, placement) and a kind of work."""

from __future__ import annotations

import os
from collections.abc import Mapping
from enum import Enum

from pyspark.sql import SparkSession


class Placement(Enum):
    """Driver cores and most executors."""

    SINGLE = (1, 1)
    SPREAD = (2, 8)
    COMPACT = (2, 3)
    DENSE = (2, 16)


class Work(Enum):
    ANALYTIC = True  # off-heap memory in use
    STREAMING = True, 1
    BATCH = True, 2
    MIXED = False

    @property
    def off_heap(self) -> bool:
        return self is not Work.MIXED


def memory_split(gb: int) -> dict[str, int]:
    """Overhead of a tenth (1 at least), 60 % of the rest off the heap; never more than there is."""
    over = max(1, gb // 10)
    off = max(0, (gb - over) * 6 // 10)
    return {"overhead": over, "off_heap": off, "heap": max(1, gb - over - off)}


def derive(gb: int, cores: int, placement: Placement = Placement.COMPACT, work: Work = Work.ANALYTIC) -> dict[str, str]:
    driver, executors = placement.value
    n = max(1, min(executors, cores - driver if cores > driver else 1))
    each = memory_split(max(2, gb // n))
    out = {
        "spark.executor.instances": n, "spark.executor.cores": max(1, (cores - driver) // n), "spark.executor.memory": f"{each['heap']}g", "spark.executor.memoryOverhead": f"{each['overhead']}g",
        "spark.sql.shuffle.partitions": max(2, 3 * cores), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": 128 * 2**20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 128 * 2**20, "spark.sql.parquet.compression.codec": "zstd",
    }
    if work.off_heap:
        out |= {"spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": f"{each['off_heap']}g"}
    else:
        out["spark.executor.memory"] = f"{each['heap'] + each['off_heap']}g"
    return {k: str(v) for k, v in out.items()}


def merge(static: Mapping[str, str], derived: Mapping[str, str]) -> dict[str, str]:
    return {**static, **derived}


def session(settings: Mapping[str, str] = {}, env: Mapping[str, str] = os.environ) -> SparkSession:
    """Defaults, then settings; SPARK_MASTER wins over both."""
    held = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.master": "local[*]", **settings}
    if env.get("SPARK_MASTER"):
        held["spark.master"] = env["SPARK_MASTER"]
    return SparkSession.builder.config(map=held).getOrCreate()


def integer(env: Mapping[str, str], name: str, default: int) -> int:
    """An environment setting; anything but an integer is an error that names it."""
    try:
        return int(env.get(name, default))
    except ValueError as e:
        raise ValueError(f"{name} must be an integer, not {env[name]!r}") from e
