"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, drop_path, give_back, shared_dir, text_of, written

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z lower-cased and no other letter touched."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def key_hash(key: Column) -> Column:
    """128 bits from two 64-bit hashes of different seeds. Spark seeds each column's hash with those before it, so the constant that
    sets the second one's seed comes first."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class SortedRun:
    """Rows (h1, h2, ...) laid out by hash: one sorted file a bucket, in the shared folder. Runs of one number of buckets are joined
    bucket by bucket as they lie, without a shuffle."""

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # lets a scan of one file a bucket count as sorted

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, name = rows.sparkSession, f"tidebin_run_{uuid.uuid4().hex}"
        self.name, self.path = name, f"{shared_dir(self.spark)}/tables/{name}"
        was = self.spark.conf.get(self.ORDERED, None)
        self.spark.conf.set(self.ORDERED, "true")
        try:
            laid = rows.repartition(buckets, "h1", "h2").write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2")
            laid.option("compression", "zstd").option("path", self.path).format("parquet").saveAsTable(name)
        finally:
            self.spark.conf.unset(self.ORDERED) if was is None else self.spark.conf.set(self.ORDERED, was)

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, keeper): a line's hash, in how many documents of the batch that brought it the line stood, and
    the largest doc_id among them.

    Each new batch is counted, merge-anti-joined with all runs, and what is fresh becomes a run of level 0; a hash thus stands in
    one run only. Hashes that the runs hold already stay with their batch and are added up at the end. `fanout` runs of a level
    are merged into one of the next, so a hash is rewritten once a level, and a lookup merges few runs. Batches must not share
    doc_ids. A lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.fanout, self.levels, self.batches, self.sums = fanout, [[]], [], None
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[SortedRun]:
        return [run for level in self.levels for run in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of batch (with h1, h2) whose hash no run holds."""
        for run in self.runs():
            batch = batch.join(run.df().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, occurrences: DataFrame) -> None:
        """occurrences: (id, h1, h2), one row for each line that counts. Lines repeated in a document count once."""
        counted = occurrences.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        batch = SortedRun(counted, self.buckets)
        if self.runs():
            mine = SortedRun(self.fresh(batch.df()), self.buckets)
            known = batch.df().join(mine.df().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self.batches.append(Written(known, "known"))  # not by buckets: a union of such scans would pass for one table of buckets
            batch.drop()
        else:
            mine = batch
        self.levels[0].append(mine)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            both = runs[0].df()
            for run in runs[1:]:  # a merge of sorted runs; no hash stands in two of them
                other = run.df().select("h1", "h2", F.col("n").alias("m"), F.col("keeper").alias("k"))
                both = both.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("n", "m").alias("n"), F.coalesce("keeper", "k").alias("keeper"))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(SortedRun(both, self.buckets))
            for run in runs:
                run.drop()
            level += 1

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, n, keeper) over all batches, of hashes that stand in at least so many documents."""
        more = None
        for batch in self.batches:
            more = batch.df() if more is None else more.unionByName(batch.df())
        if more is not None:
            self.sums = SortedRun(more.groupBy("h1", "h2").agg(F.sum("n").alias("m"), F.max("keeper").alias("k")), self.buckets)
            more = self.sums.df()
        out = None
        for run in self.runs():
            rows = run.df()
            if more is not None:
                rows = rows.join(more.hint("merge"), ["h1", "h2"], "left")
                rows = rows.select("h1", "h2", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keeper", "k").alias("keeper"))
            rows = rows.where(F.col("n") >= least)
            out = rows if out is None else out.unionByName(rows)
        return out

    def drop(self) -> None:
        """Deletes all runs; what has been asked of them must have been written by then."""
        for run in [*self.runs(), *self.batches, *([self.sums] if self.sums else [])]:
            run.drop()


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, version, pos, h1, h2) for each line of docs (columns id, version, text) whose key has at least min_chars code points."""
    trimmed = F.btrim("line", F.lit(SPACE))
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length(trimmed) >= min_chars)
    return lines.select("id", "version", "pos", key_hash(line_key(F.col("line"))).alias("h")).select("id", "version", "pos", "h.h1", "h.h2")


BROADCAST_LINES = 250_000  # so many frequent lines (24 bytes each) are broadcast; beyond that the join shuffles, in shares
SHARES = 16


def _with_frequent(seen: DataFrame, frequent: DataFrame) -> DataFrame:
    """seen joined with its frequent lines. A line may stand in a third of all documents: its rows are either not shuffled at all or
    dealt into shares by their document."""
    if frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        return seen.join(F.broadcast(frequent), ["h1", "h2"])
    shared = frequent.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return seen.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")).join(shared, ["h1", "h2", "share"])


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Every column of docs, with text replaced by what is left of it, n_chars (if there) set to its length, and the new columns
    n_lines (before dropping) and n_dropped (columns of these names in docs give way).

    A key of at least min_chars code points that stands in at least min_docs documents loses all its lines but those in the largest
    doc_id that holds it. Null and empty texts are one empty line and become "". Rows that share a doc_id are one document to the
    counts; null doc_ids together count as one document, which never keeps a line that another one holds too. An empty table gives
    an empty one. The work on a document is in proportion to its length, also if many of its lines go."""
    own, version = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(text_of())
    seen = occurrences(docs.select(own.alias("id"), version.alias("version"), text_of().alias("text")), min_chars)
    seen = Written(seen.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        runs.add(seen.df().where(F.col("batch") == b).select("id", "h1", "h2"))
        give_back(docs.sparkSession)
    frequent = written(runs.frequent(min_docs), "frequent")
    runs.drop()
    drops = (
        _with_frequent(seen.df(), frequent.select("h1", "h2", "keeper")).where("id <> keeper")
        .groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(F.collect_set("pos").alias("__drops"))
    )
    whole = text_of()
    lines = F.split(whole, "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops"))
    out = (
        docs.withColumns({"__id": own, "__version": version})
        .join(drops, ["__id", "__version"], "left")
        .withColumns({"__lines": F.size(lines).cast("long"), "__kept": F.when(F.col("__drops").isNotNull(), stays), "__split": F.when(F.col("__drops").isNotNull(), lines)})
    )
    text = F.when(F.col("__kept").isNull(), whole).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__split", i)), "\n"))
    gone = F.when(F.col("__kept").isNull(), F.lit(0).cast("long")).otherwise(F.col("__lines") - F.size("__kept"))
    cols = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(
        *[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.col("__lines").alias("n_lines"), gone.alias("n_dropped"),
    )


SQL = """
WITH lines AS (
  SELECT d.doc_id, u.i, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u),
frequent AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL AND l.doc_id <> f.keeper) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.k IS NULL OR l.doc_id = f.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.k = f.k GROUP BY l.doc_id
"""
