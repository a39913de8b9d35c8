"""Helpers that the training-data operators share: inputs, written tables, label splits."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Opens one input table through Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The session names it in spark.checkpoint.dir; only where that is unset and the master is local
    (tests, a single machine) is a temporary folder made and set."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    path = named or "file://" + tempfile.mkdtemp(prefix="tidebin-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Written:
    """A table written to the shared folder: it cuts the lineage, survives lost executors and is read with column pruning."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        trim_jvm(self.spark)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by five; such rows never lend a label. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def text_of(col: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(col), F.lit(""))


def training_labels(labels: DataFrame, which: str) -> DataFrame:
    """One row (doc_id, y) for each labelled id that may be learnt from; of contradicting rows the 1 holds."""
    return (
        labels.select("doc_id", F.col(which).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def text_slices(batch: pa.RecordBatch, at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text in column `at`, of one row at least."""
    size = np.cumsum(pc.coalesce(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def give_back(spark: SparkSession | None = None) -> None:
    """Returns memory that is free in this process to the system, where its C library can: a driver has little beside its JVM. With a
    session, the driver's JVM does so too: it collects its garbage, by which Spark also learns what shuffles and broadcasts may go."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
        trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> bool:
    """Returns what the driver's JVM has freed outside its heap (compilers and codecs leave it in the C library's arenas, tens of MB a few
    queries). It takes some milliseconds. False where the JVM has no such command."""
    jvm, made = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, args = made(jvm.java.lang.Class, 4), made(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(name)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


MOST_BITMAPS = 4096  # of 4 KB each


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, their: str) -> DataFrame:
    """rows with __maybe: false only where the (binary) key is certainly not among keys. It comes from a bitmap of one bit a hash, of sixteen
    bits for each of the keys and 16 MB at most, which is broadcast: most rows that a join would shuffle in vain are found out without
    a shuffle."""
    size = 1
    n = keys.count()
    while size * 2048 < n and size < MOST_BITMAPS:
        size *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size * 32768))
    bits = keys.select(place(their).alias("p")).groupBy(F.expr("cast(p div 32768 as int)").alias("__block")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("__bits"))
    out = rows.withColumn("__p", place(key)).withColumn("__block", F.expr("cast(__p div 32768 as int)"))
    out = out.join(F.broadcast(bits), "__block", "left")
    octet = F.conv(F.hex(F.expr("substring(__bits, cast(__p % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(octet, F.expr("cast(__p % 8 as int)")) == 1, F.lit(False))
    return out.withColumn("__maybe", hit).drop("__p", "__block", "__bits")
