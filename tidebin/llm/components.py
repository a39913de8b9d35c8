"""Connected components of a link table by alternating star contractions, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: columns a, b of any one orderable type. Returns (node, component) with one row for each node that has a link to
    another node; component is the smallest node reachable. Null ends and self-links are ignored; an empty table gives an
    empty one. Hubs are no trouble: their minimum is pre-aggregated before the shuffle and the join back is one that adaptive
    execution splits. The driver sees a count and a checksum a round, never links."""
    now = Written(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        mark = now.df().agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        after = Written(_small_star(_large_star(now.df())), "links")
        now.drop()
        now = after
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    stars = now.df()  # each link now runs from a node to the least node of its component
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
