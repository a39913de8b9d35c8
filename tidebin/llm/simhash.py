"""SimHash near-duplicates: fingerprints of word shingles, and a binary trie that is joined with itself under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_in, text_of, written
from .components import components

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and bits, from the most significant one

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.uint16)


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included. Words are runs without ASCII white space, with A-Z lower-cased;
    a text of fewer words is one shingle, a text of none has fingerprint 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return majority(np.array(part, np.uint64) for part in iter(lambda: list(map(xxhash.xxh64_intdigest, islice(shingles, 65536), repeat(seed))), []))  # a very long text is counted in pieces


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes of these arrays, the highest first; 0 if there are none."""
    n, seen = 0, np.zeros(2048, np.int64)
    for part in parts:
        seen += np.bincount((part.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        n += len(part)
    total = seen.reshape(8, 256)[::-1] @ _BITS  # from the highest byte and bit
    return int.from_bytes(np.packbits(2 * total.ravel() > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(doc_id, fp), and with `keyed` the text's key: fp holds the 64 bits as a signed long. No shuffle; each text is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    src = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *([text_key().alias("key")] if keyed else []))
    return src.mapInArrow(run, "doc_id long, fp long" + ", key binary" * keyed)


def _flat(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _flat(parent)


def trie_forest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = 4, leaf: int = 1024, chunk: int = 100_000) -> np.ndarray:
    """Joins tries with themselves. values: unsigned 64-bit, ascending within each run [starts, ends), whose first `depth` bits are
    equal. Walks pairs of trie nodes down together, adds up the bits by which they differ and drops a pair once that exceeds
    `budget`, or once all of its values are known to hang together already. Small node pairs are compared value by value.
    Returns for each value the index of the least value of its group; no list of pairs is ever kept."""
    n = len(values)
    parent = np.arange(n)
    # node pairs: ranges of both nodes, depth, bits that differ so far; taken from a stack, so that memory stays bounded
    stack = [(starts[k : k + chunk], ends[k : k + chunk], starts[k : k + chunk], ends[k : k + chunk], depth, np.zeros(len(starts[k : k + chunk]), np.int8)) for k in range(0, len(starts), chunk)]
    run_of = np.zeros(n + 1, np.int64)
    np.add.at(run_of, starts, 1)
    offset = np.cumsum(run_of)[:n] - 1  # the run of each value: searches stay within it
    while stack:
        alo, ahi, blo, bhi, at, diff = stack.pop()
        if len(alo) == 0:
            continue
        turn = np.flatnonzero(np.diff(parent)) + 1  # where the group changes; a range without such a turn is one group
        turns = np.append(turn, n)
        whole = (turns[np.searchsorted(turns, alo, "right")] >= ahi) & (turns[np.searchsorted(turns, blo, "right")] >= bhi) & (parent[alo] == parent[blo])
        keep = ~whole
        alo, ahi, blo, bhi, diff = alo[keep], ahi[keep], blo[keep], bhi[keep], diff[keep]
        size = (ahi - alo) * (bhi - blo)
        small = (size <= leaf) | (at >= 64)
        if small.any():
            sa, sb, wa, wb = alo[small], blo[small], (ahi - alo)[small], (bhi - blo)[small]
            ends_at = np.cumsum(wa * wb)
            first = 0
            while first < len(sa):  # products are spelt out some millions at a time
                base = ends_at[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends_at, base + 4_000_000, "right")))
                s = slice(first, last)
                cnt = (wa * wb)[s]
                of = np.repeat(np.arange(len(cnt)), cnt)
                k = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                i, j = sa[s][of] + k // wb[s][of], sb[s][of] + k % wb[s][of]
                near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
                if near.any():
                    parent = _united(parent, i[near], j[near])
                first = last
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, diff = alo[big], ahi[big], blo[big], bhi[big], diff[big]
        bit = np.uint64(1 << (63 - at))
        above = np.uint64((~((1 << (64 - at)) - 1)) & (2**64 - 1)) if at else np.uint64(0)

        def cut(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # noqa: B023
            mid = (values[lo] & above) | bit  # noqa: B023
            out_lo, out_hi = lo.copy(), hi.copy()
            while (open_ := out_lo < out_hi).any():  # binary search in all ranges at once
                m = (out_lo + out_hi) >> 1
                up = open_ & (values[np.minimum(m, n - 1)] < mid)
                out_hi = np.where(open_ & ~up, m, out_hi)
                out_lo = np.where(up, m + 1, out_lo)
            return out_lo

        am, bm = cut(alo, ahi), cut(blo, bhi)
        same = (alo == blo) & (ahi == bhi)
        parts = [(alo, am, blo, bm, diff, None), (am, ahi, bm, bhi, diff, None), (alo, am, bm, bhi, diff + 1, None), (am, ahi, blo, bm, diff + 1, ~same)]
        nxt = []
        for a, b, c, d, e, only in parts:
            ok = (a < b) & (c < d) & (e <= budget)
            if only is not None:
                ok &= only
            nxt.append((a[ok], b[ok], c[ok], d[ok], e[ok]))
        a, b, c, d, e = (np.concatenate(x) for x in zip(*nxt))
        for k in range(0, len(a), chunk):
            s = slice(k, k + chunk)
            stack.append((a[s], b[s], c[s], d[s], at + 1, e[s].astype(np.int8)))
    return parent


def _forest(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, rv, rep) ascending by task and rv: joins the tries of many tasks at once and gives links (a, b) of spanning stars."""

    def joined(task: np.ndarray, rv: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        parent = trie_forest(rv.view(np.uint64), starts, np.r_[starts[1:], len(task)], 12, budget)
        hung = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(rep[hung]), pa.array(rep[parent[hung]])], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        rows += batch.num_rows
        if rows >= 2_000_000:  # up to the last whole task
            cols = [np.concatenate(x) for x in zip(*held)]
            stop = int(np.searchsorted(cols[0], cols[0][-1]))
            if stop:
                yield joined(*(c[:stop] for c in cols))
            held, rows = [tuple(c[stop:] for c in cols)], len(cols[0]) - stop
    if rows:
        yield joined(*(np.concatenate(x) for x in zip(*held)))


def near_links(prints: DataFrame, budget: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """prints: (fp, rep), fp distinct. Returns links (a, b) between reps whose transitive closure is exactly that of all pairs at
    `budget` (4 at most) or fewer differing bits.

    64 bits fall into five blocks, so two such fingerprints share at least one whole block: a task is a block's number and value,
    and its trie holds the fingerprints turned so that this block leads. A task of more than `bucket_rows` is dealt by a hash into
    parts, and each two parts meet in a task of their own, so that no task grows with the data and no pair is lost. The counts by
    task are at most 36,864 rows, a bound that the blocks set, and are broadcast."""
    if not 0 <= budget <= 4:
        raise ValueError("five blocks prove a shared one for at most 4 differing bits")
    turned = []
    for k, (first, bits) in enumerate(BLOCKS):
        rv = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        turned.append(F.struct(rv.alias("rv"), (F.lit(k) * 8192 + F.shiftrightunsigned(rv, 64 - bits)).alias("bucket")))
    rows = prints.select("fp", "rep", F.explode(F.array(*turned)).alias("t")).select("fp", "rep", "t.rv", "t.bucket")
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")))
    pair = F.least("part", "other").cast("long") * F.lit(1 << 20) + F.greatest("part", "other")
    tasks = (
        rows.join(F.broadcast(parts), "bucket")
        .withColumn("part", part)
        .withColumn("other", F.explode(others))
        .select((F.col("bucket") * F.lit(1 << 40) + pair).alias("task"), "rv", "rep")
    )
    return tasks.repartition("task").sortWithinPartitions("task", "rv").mapInArrow(lambda b: _forest(b, budget), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed long), component_id (the smallest doc_id reachable over links).

    Nulls and empty texts have fingerprint 0 and link like any other; repeated rows stay repeated; an empty table gives an empty
    one; other columns are not looked at. Texts of one fingerprint are one node of the graph, so a group of any number of copies
    costs one row in the join."""
    prints = written(fingerprints(docs, words, seed), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    found = components(near_links(classes, budget))
    label = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label, "fp", "left").select("doc_id", "fp", "component_id")


def text_key() -> Column:
    """16 bytes that stand for a row's text; a null text counts as an empty one."""
    return F.unhex(F.md5(text_of().cast("binary")))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs without those that another row of their group stands for. rows: (doc_id, key, grp), one row for each row of
    docs, with key as text_key() gives it.

    Of each group exactly one row stays: that of the smallest doc_id, a null one last, and of the least key among rows that share
    it. Rows alike in doc_id and text are told apart by counting alone, and any one of them stays. docs is read three times and must
    give the same rows each time."""
    mine = rows.groupBy("grp", "doc_id", "key").agg(F.count("*").alias("n"))
    first = mine.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.sum("n").alias("of")).where("of > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    marks = mine.join(first, "grp").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), stays.alias("__stays"), (F.col("n") > 1).alias("__many"))
    marks = written(marks.where("__many or not __stays"), "marks")
    keyed = maybe_in(docs.withColumns({"__own": F.col("doc_id").cast("long"), "__text": text_key()}), "__text", marks, "__key")
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    able = keyed.where("__maybe")  # the others certainly stay, and are not shuffled
    alone = able.join(marks.select("__id", "__key"), same, "left_anti")
    many = able.join(marks.where("__stays").select("__id", "__key"), same, "left_semi")
    one = many.withColumn("__at", F.row_number().over(Window.partitionBy("__own", "__text").orderBy("__own"))).where("__at = 1")
    out = None
    for part in (keyed.where("not __maybe"), alone, one):
        part = part.select(*map(_named, docs.columns))
        out = part if out is None else out.unionByName(part)
    return out


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")
