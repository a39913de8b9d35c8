"""SimHash near-duplicates by word shingles, decided by Jaccard similarity: the trie join's links, and all that it can't reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, give_back, maybe_in, text_of, text_slices, written
from .components import components
from .simhash import keep_first, majority, near_links, text_key

WORDS = 5
NEAR, OF = 4, 5  # similarity of at least 4/5, in whole numbers
SEED = 42
SEEN = 500_000  # sets a worker remembers to have given the prefix of
CELLS = 22  # bits of a hash by which shingles are counted together
CHUNK = 1 << 16  # cells that are summed up in one place
FEW = 64  # rows of a task all of whose pairs are spelt out, together with those of other such tasks
PAIRS = 200_000  # pairs that are held at once


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text, repeats included, one text after the other, and how many each text has. Words are
    taken as simhash.fingerprint takes them, each hashed once; a shingle's hash is put together from those of its words. A text of
    fewer words is one shingle, a text of none has none."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = parts.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    word, at = pc.ascii_lower(coded.dictionary).to_pylist(), coded.indices.to_numpy()  # a slice's own bytes would be misread there
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in word), np.uint64, len(word))
    if "" in word:  # white space at an end
        held = at != word.index("")
        at, of = at[held], of[held]
    w, n = hashed[at], np.bincount(of, minlength=len(texts))
    take = np.minimum(np.maximum(n, 1), words)  # words in each shingle of a text
    count = np.where(n > 0, n - take + 1, 0)
    start = np.cumsum(n) - n
    first = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
    size = np.repeat(take, count)
    h = size.astype(np.uint64)
    for j in range(words):
        more = j < size
        h = np.where(more, h * np.uint64(0x9E3779B97F4A7C15) + w[np.minimum(first + j, len(w) - 1)] if len(w) else h, h)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29)), count


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of shingle hashes of each text, ascending."""
    h, count = shingles(texts)
    return [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])] if len(texts) else []


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= NEAR * (len(a) + len(b) - both)


def prefix_length(n: int) -> int:
    """Of two sets as similar as that, which both hold at least 4/5 of the larger one, the so many first hashes share one, in whatever order
    all sets are put."""
    return n - -(-NEAR * n // OF) + 1


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of hashes falls on it. Two sets differ in at least as many elements as their bits do. The
    width, a power of two, is wide enough to tell sets that have little in common apart."""
    bits = 512
    while 4 * bits < 3 * len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def levels(docs: DataFrame) -> np.ndarray:
    """How common the shingles of each cell of hashes are: four steps to each doubling of a cell's count. All shingles of all rows are
    counted; the driver sees one byte a cell. A set's first hashes come from its cells of the lowest counts: a shingle that stands out
    from what chance makes of a cell's rare ones (about twice the root of the mean, of the mean beside it) is seldom among them, so the
    rows that meet by a hash stay few while the table grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELLS, np.uint32)
        for whole in batches:
            for b in text_slices(whole, 0):
                np.add.at(n, (shingles(b.column(0))[0] >> np.uint64(64 - CELLS)).astype(np.int32), np.uint32(1))
        for k in range(0, len(n), CHUNK):
            if (part := n[k : k + CHUNK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([np.minimum(part, 255).astype(np.uint8).tobytes()])], names=["chunk", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(part.as_buffer(), np.uint8).astype(np.int64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(4 * np.log2(1 + n)).astype(np.uint8).tobytes()])], names=["chunk", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "chunk int, n binary")  # a task's counts beyond 255 are common enough
    found = counted.repartition("chunk").mapInArrow(summed, "chunk int, n binary").toArrow()  # 64 rows of 64 KB at most
    level = np.zeros(1 << CELLS, np.uint8)
    for k, part in zip(found["chunk"].to_pylist(), found["n"]):
        level[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(part.as_buffer(), np.uint8)
    return level


def prints(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(doc_id, key, node, n, fp, bits, prefix): node is a 64-bit hash of the whole shingle set and stands for all texts of that set; n is
    the set's size, fp its SimHash fingerprint. prefix holds the first hashes by level, then by value: common shingles come last, so that few sets meet by them. A
    worker gives bits and prefix with a set's first row only, and null with the others."""
    sent = docs.sparkSession.sparkContext.broadcast(level)  # 4 MB, however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in text_slices(whole, 1):
                node, size, fp, bits, prefix = [], [], [], [], []
                for h in sets(b.column(1)):
                    v = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)) if len(h) else 0
                    node.append(v)
                    size.append(len(h))
                    first = v not in seen
                    if first:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(v)
                    bits.append(parity(h) if first else None)
                    fp.append(int(np.uint64(majority([h])).view(np.int64)) if first else None)
                    lead = None
                    if first and len(h):
                        common = sent.value[(h >> np.uint64(64 - CELLS)).astype(np.int32)]
                        lead = h[np.argsort(common, kind="stable")][: prefix_length(len(h))].view(np.int64)
                    prefix.append(lead)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "node", "n", "fp", "bits", "prefix"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), text_key().alias("key"))
    return src.mapInArrow(run, "doc_id long, key binary, node long, n int, fp long, bits array<long>, prefix array<long>")


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches ascending by their first column, cut only where that changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(at, at[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != at[0]):
            if cut:
                held.append(b.slice(0, cut))
            if held:
                yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, node) ascending by both: the rows of hashes that at least two nodes hold, with the least and the largest of these."""
    for t in _whole_tasks(batches):
        h, v = (t.column(i).to_numpy() for i in range(2))
        new = np.r_[True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])]
        h, v = h[new], v[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        cnt = np.diff(np.r_[start, len(h)])
        many = np.repeat(cnt > 1, cnt)
        if many.any():
            low, high = np.repeat(v[start], cnt)[many], np.repeat(v[start + cnt - 1], cnt)[many]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[many], v[many], low, high)], names=["hash", "node", "low", "high"])


def _spelt(first: np.ndarray, stop: np.ndarray, node: np.ndarray, grp: np.ndarray, n: np.ndarray, flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What _across looks for, among all pairs of each row of `first` with the rows after it up to `stop`: some pairs at a time."""
    upto = np.cumsum(stop - first - 1)
    k = 0
    while k < len(first):
        base = upto[k - 1] if k else 0
        last = max(k + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        cnt = (stop - first - 1)[k:last]
        i = np.repeat(first[k:last], cnt)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        k = last
        fit = (grp[i] != grp[j]) & (OF * np.minimum(n[i], n[j]) >= NEAR * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        swap = n[i] > n[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        width, wide = at[i + 1] - at[i], at[j + 1] - at[j]
        for w in np.unique(width):
            for m in (1, 2):  # a partner at most 5/4 as large has as many bits or twice as many
                a, b = (x[(width == w) & (wide == m * w)] for x in (i, j))
                if len(a):
                    theirs = flat[at[b][:, None] + np.arange(m * w)]
                    if m == 2:
                        theirs = theirs[:, :w] ^ theirs[:, w:]
                    apart = np.bitwise_count(theirs ^ flat[at[a][:, None] + np.arange(w)]).sum(1, dtype=np.int64)
                    fit = (OF + NEAR) * apart <= (OF - NEAR) * (n[a].astype(np.int64) + n[b])
                    yield node[a[fit]], node[b[fit]]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, node, grp, n, bits) ascending by task: pairs of one task and different groups whose sizes and bits allow the similarity."""
    for t in _whole_tasks(batches):
        task, node, grp, n = (t.column(i).to_numpy() for i in range(4))
        lists = t.column(4).combine_chunks()
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]  # of signed ones numpy counts the bits of the absolute value
        start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        end = np.r_[start[1:], len(task)]
        cnt = end - start
        few = np.flatnonzero(np.repeat(cnt <= FEW, cnt))
        for x, y in _spelt(few, np.repeat(end, cnt)[few], node, grp, n, flat, at):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
        for s, e in zip(start[cnt > FEW], end[cnt > FEW]):
            if (grp[s:e] == grp[s]).all():
                continue
            rows = s + np.argsort(n[s:e], kind="stable")
            width = np.diff(at)[rows]  # ascending with n
            blocks = [(w, rows[width == w]) for w in np.unique(width)]
            stacked = [np.stack([flat[at[r] : at[r + 1]] for r in r_]) for _, r_ in blocks]
            for k, (w, mine) in enumerate(blocks):
                a, b = [], []
                for m in (k, k + 1):  # partners at most 5/4 as large are of this width or of the next one
                    if m == len(blocks):
                        continue
                    other, theirs = blocks[m][1], stacked[m]
                    if m > k:
                        if blocks[m][0] != 2 * w:
                            continue
                        theirs = theirs[:, :w] ^ theirs[:, w:]
                    for i, r in enumerate(mine):
                        lo, hi = (i + 1 if m == k else 0), int(np.searchsorted(n[other], OF * n[r] // NEAR, "right"))
                        if lo >= hi:
                            continue
                        apart = np.bitwise_count(theirs[lo:hi] ^ stacked[k][i]).sum(1, dtype=np.int64)
                        fit = ((OF + NEAR) * apart <= (OF - NEAR) * (n[other[lo:hi]].astype(np.int64) + n[r])) & (grp[other[lo:hi]] != grp[r])
                        got = other[lo:hi][fit]
                        a.append(np.full(len(got), node[r]))
                        b.append(node[got])
                if a:
                    x, y = np.concatenate(a), np.concatenate(b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b): the pairs whose shingle sets are similar enough."""
    last, held = None, np.zeros(0, np.uint64)
    for whole in batches:
        for b in text_slices(whole, 3):
            yes = []
            for i, other in enumerate(sets(b.column(3))):
                key = b.column(0)[i].as_py()
                if key != last:
                    last, held = key, sets(pa.array([b.column(2)[i].as_py()]))[0]
                yes.append(near(held, other))
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, with a < b."""
    sizes = nodes.select("node", "n", "bits")
    apart = F.aggregate(F.zip_with("bits", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fit = (OF * F.least("n", "n_b") >= NEAR * F.greatest("n", "n_b")) & ((F.size("bits") != F.size("bits_b")) | ((OF + NEAR) * apart <= (OF - NEAR) * (F.col("n") + F.col("n_b"))))
    other = sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    able = Written(pairs.join(sizes.withColumnRenamed("node", "a"), "a").join(other, "b").where(fit).select("a", "b"), "pairs")
    want = able.df().select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = seen.join(want, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"))
    rows = written(rows.select("node", F.col("r.doc_id").alias("id"), F.col("r.key").alias("k")), "wanted")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), text_key().alias("key"))
    src = maybe_in(src, "key", rows, "k").where("__maybe")
    texts = src.join(rows, src.doc_id.eqNullSafe(rows.id) & (src.key == rows.k)).select("node", "text").dropDuplicates(["node"])
    texts = Written(texts, "texts")
    left, right = (texts.df().select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    # hubs (a) come last: by then rows are as long as their texts, so that a hub of many pairs shows as a skewed partition and is split
    both = able.df().join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    out = Written(both.mapInArrow(_confirmed, "a long, b long"), "links")
    texts.drop()
    able.drop()
    give_back(docs.sparkSession)
    return out.df()


def near_groups(docs: DataFrame, part_rows: int = 4096) -> DataFrame:
    """(doc_id, key, grp), one row for each row of docs: rows hang together if a chain of pairs with Jaccard similarity of at least 0.8
    between their sets of five-word shingles leads from one to the other. No such pair is missed: both sets of a pair hold a hash in
    common among the first fifth of their hashes, pairs are only dropped by bounds that hold for certain, and those left are compared
    in full, by 64-bit hashes. Nulls and texts without words are one group.

    It starts from the SimHash operator: fingerprints of five-word shingles, whose tries are joined with themselves, propose links. SimHash
    alone can't give this result, as most pairs of 0.8 to 0.95 differ in more bits than any trie can prune by. So each node is also
    compared with the least and the largest node of each of its hashes, which gathers large groups of copies in few comparisons;
    after that only nodes of different groups meet. A hash of many nodes is dealt into parts that meet by twos."""
    seen = written(prints(docs, levels(docs)), "sets")
    nodes = written(seen.where("bits is not null").select("node", "n", "fp", "bits").dropDuplicates(["node"]), "nodes")
    rows = seen.where("prefix is not null").select(F.explode("prefix").alias("hash"), "node")
    shared = written(rows.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(_shared, "hash long, node long, low long, high long"), "shared")
    give_back(docs.sparkSession)
    stars = shared.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    stars = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    prints_ = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    alike = nodes.join(prints_, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    trie = near_links(prints_).unionByName(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _links(stars.unionByName(trie).distinct(), docs, nodes, seen)
    found = components(links)
    now = written(shared.select("hash", "node").join(found, "node", "left").select("hash", "node", F.coalesce("component", "node").alias("grp")), "now")
    give_back(docs.sparkSession)
    split = now.groupBy("hash").agg(F.min("grp").alias("g"), F.max("grp").alias("h"), F.count("*").alias("m")).where("g <> h").select("hash", F.ceil(F.col("m") / part_rows).cast("int").alias("parts"))
    dealt = now.join(split, "hash").join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")))
    tasks = dealt.withColumn("other", F.explode(others)).select(F.xxhash64("hash", F.least("part", "other"), F.greatest("part", "other")).alias("task"), "node", "grp", "n", "bits")
    pairs = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_across, "a long, b long").distinct()
    found = components(links.unionByName(_links(pairs, docs, nodes, seen)))
    give_back(docs.sparkSession)
    return seen.select("doc_id", "key", "node").join(found, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("grp"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near_groups one row of docs, by the rules of simhash.keep_first."""
    return keep_first(docs, near_groups(docs))
