"""Mixing sources to target weights by temperature. DataFrame functions only; the driver sees a few totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

STEPS = 10_000  # the exponent is a multiple of 1 / STEPS
BROADCAST_SOURCES = 20_000  # plans of up to so many sources (about 100 bytes each) are broadcast; beyond that the join shuffles


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def _source_key(c: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(c).cast("string")), F.lit("null"))


def _least(ok, low: int, high: int) -> int:
    """Bisection: the least k in [low, high] for which ok(k) holds; ok is monotone and ok(high) holds."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return low


def exponent(totals: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """totals: (key, tokens), tokens > 0. Bisects the exponent a in [0, 1]; weights are shares ** a, and budgets are scaled so that
    the largest source is used exactly once.

    With a repetition limit: the least a (the flattest mix) that repeats no source more than max_repetition times. With a target
    entropy in nats: the largest a whose mix still has it, raised if the limit asks for it; where even a = 0 has less, 0."""
    low, high = totals.agg(F.min("tokens"), F.max("tokens")).first()
    if low is None:
        return 1.0
    least = _least(lambda k: (high / low) ** (1 - k / STEPS) <= max_repetition, 0, STEPS) if max_repetition is not None else 0
    if target_entropy is None:
        return (least if max_repetition is not None else STEPS) / STEPS

    def entropy(k: int) -> float:  # ln Z - a * sum(p^a ln p) / Z, summed where the sources are
        x = F.log(F.col("tokens") / F.lit(float(high)))
        z, zx = totals.agg(F.sum(F.exp(x * (k / STEPS))), F.sum(F.exp(x * (k / STEPS)) * x)).first()
        return math.log(z) - k / STEPS * zx / z

    first_below = _least(lambda k: k > STEPS or entropy(k) < target_entropy, 0, STEPS + 1)
    return max(first_below - 1, least, 0) / STEPS


def mixing_plan(rows: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, blocks: int = 3) -> DataFrame:
    """rows: (key, perm, tokens). One row a source: key, epochs (whole passes), cut (the last perm that the started pass still takes,
    "" for none).

    A started pass is a permutation by `perm`, a hash, in blocks of its first `blocks` hex digits. Block totals are summed up within
    a source (4096 rows at most), and only the block at which the budget ends is looked at row by row, so a hot source costs no task
    more than a few thousandths of its rows. Rows of one perm are taken or left together."""
    totals = rows.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    a = exponent(totals.where("tokens > 0"), max_repetition, target_entropy)
    top = totals.agg(F.max("tokens")).first()[0] or 0
    target = F.floor(F.lit(float(top)) * F.pow(F.col("tokens") / F.lit(float(max(top, 1))), F.lit(a)))
    plan = totals.select("key", "tokens", F.greatest(target.cast("long"), F.col("tokens")).alias("target")).select(
        "key",
        F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(1)).alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("target % tokens")).otherwise(F.lit(-1)).alias("rest"),
    )
    block = F.substring("perm", 1, blocks)
    sums = rows.groupBy("key", block.alias("block")).agg(F.sum("tokens").alias("tokens"), F.max("perm").alias("last"))
    upto = F.sum("tokens").over(Window.partitionBy("key").orderBy("block"))
    sums = sums.withColumn("upto", upto).join(plan, "key")
    whole = sums.where("upto <= rest").groupBy("key").agg(F.max("last").alias("cut"))
    edge = sums.where("upto > rest and upto - tokens <= rest").select("key", "block", (F.col("upto") - F.col("tokens")).alias("before"), "rest")
    in_edge = rows.withColumn("block", block).join(edge, ["key", "block"])
    taken = F.col("before") + F.sum("tokens").over(Window.partitionBy("key").orderBy("perm"))
    started = in_edge.withColumn("taken", taken).where("taken <= rest").groupBy("key").agg(F.max("perm").alias("cut"))
    cuts = whole.unionByName(started).groupBy("key").agg(F.max("cut").alias("cut"))
    return plan.join(cuts, "key", "left").select("key", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def with_copies(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """Every row and column of docs, with __tokens (words) and __copies: how often the mixed corpus holds the row.

    Every row is held once at least, as the largest source is used exactly once; the others are repeated up to the limit. A null
    source is a source of its own; null and empty texts have no words; rows of one doc_id are taken together; sources without a
    single word are used once; an empty table gives an empty one."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(text_of().cast("binary"))))  # rows without an id are dealt by their texts
    perm = F.md5(F.concat(own, F.lit("|mix")).cast("binary"))
    keyed = docs.withColumns({"__key": _source_key(), "__perm": perm, "__tokens": word_count(text_of())})
    rows = keyed.select(F.col("__key").alias("key"), F.col("__perm").alias("perm"), F.col("__tokens").alias("tokens"))
    from .common import written

    rows = written(rows, "mix")  # words are counted once
    plan = written(mixing_plan(rows, max_repetition, target_entropy), "mixplan")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.select(F.col("key").alias("__key"), "epochs", "cut")
    out = keyed.join(F.broadcast(plan) if small else plan, "__key")
    copies = F.col("epochs") + F.when(F.col("__perm") <= F.col("cut"), 1).otherwise(0)
    return out.withColumn("__copies", copies.cast("long")).drop("__key", "__perm", "epochs", "cut")


def mix(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as its source's budget says."""
    held = with_copies(docs, max_repetition, target_entropy)
    return held.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) || '|mix') AS perm,
             CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents),
t AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY k),
m AS (SELECT CAST(max(tokens) AS DOUBLE) AS top, CAST(min(tokens) FILTER (WHERE tokens > 0) AS DOUBLE) AS low FROM t),
a AS (SELECT min(k / 10000.0::DOUBLE) AS a FROM m, (SELECT unnest(generate_series(0, 10000)) AS k) WHERE pow(top / low, 1 - k / 10000.0::DOUBLE) <= 2.0),
b AS (SELECT k, tokens, greatest(CAST(floor(top * pow(tokens / top, a)) AS BIGINT), tokens) AS target FROM t, m, a WHERE tokens > 0),
c AS (SELECT d.*, b.target // b.tokens AS epochs, b.target % b.tokens AS rest, sum(d.tokens) OVER (PARTITION BY d.k ORDER BY d.perm) AS upto
      FROM d LEFT JOIN b ON d.k = b.k)
SELECT doc_id, source, tokens, CAST(coalesce(epochs, 1) + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
"""
