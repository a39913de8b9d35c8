"""Writes the whole buckets of a stream into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engine import Engine


def store_stream(engine: Engine, sql: str, stream: DataFrame, checkpoint: str, time: str = "ts", delay: str = "10 minutes", **trigger):
    """stream: rows with an event-time column `time`. Whenever the watermark closes day buckets, they are stored anew from the
    registered table, so late rows that the table has are in them. Returns the started query."""
    size = engine.limits.bucket
    closed = stream.select(F.col(time).cast("timestamp").alias("at")).withWatermark("at", delay).groupBy(F.window("at", f"{size} seconds")).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"))

    def put(batch: DataFrame, _: int) -> None:
        starts = [r.start for r in batch.select("start").distinct().collect()]  # buckets closed by this batch
        if starts:
            engine.warm(sql, starts, force=True)

    return closed.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
