"""Toxicity: bags of hashed subwords, averaged into a linear softmax; embeddings and softmax are trained together in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, text_of, text_slices, training_labels

BITS = 20
SOME = 16_384  # words whose subwords are held at once
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' subwords, and which word each belongs to: a word as such and its runs of 3 to 5 characters, with marks for
    its ends, hashed all together."""
    marked = [f"<{w.strip(_EDGE) or w}>" for w in words]
    if not marked:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start, word = np.cumsum(size) - size, np.repeat(np.arange(len(words)), size)
    at = np.arange(len(c)) - start[word]
    power = np.cumprod(np.full(size.max(), _P))
    ids, of = [_bucket(np.add.reduceat(c * power[at], start))], [np.arange(len(words))]
    for n in (3, 4, 5):
        i = np.flatnonzero(at + n <= size[word])
        h = np.full(len(i), n, np.uint64)
        for j in range(n):
            h = h * _P + c[i + j]
        ids.append(_bucket(h))
        of.append(word[i])
    return np.concatenate(ids), np.concatenate(of)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of these texts in lower case, each once; which of them stand in the texts, one text after the other; and how many words
    each text has. Words are what Unicode white space parts."""
    parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    coded = parts.flatten().dictionary_encode()
    words, at = [w.lower() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    of = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    if "" in words:  # white space at an end
        held = at != words.index("")
        at, of = at[held], of[held]
    return words, at, np.bincount(of, minlength=len(texts))


class SubwordModel:
    """mean over a text's words of (mean over the word's subwords of their vectors), then softmax of a linear map."""

    def __init__(self, dims: int = 4, epochs: int = 12, steps: int = 200, rate: float = 0.5, batch: int = 32, decay: float = 0.0, scale: float = 50.0, deviations: float = 5.0, power: float = 8.0, seed: int = 7):
        self.dims, self.epochs, self.steps, self.rate, self.batch, self.decay, self.scale, self.deviations, self.power, self.seed = dims, epochs, steps, rate, batch, decay, scale, deviations, power, seed

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> SubwordModel:
        rng = np.random.default_rng(self.seed)
        words, held, long = words_of(pa.array(texts, pa.large_string()))
        of, share, after = [], [], np.cumsum(long)
        for stop, total in zip(after, long):
            ws, cnt = np.unique(held[stop - total : stop], return_counts=True)
            of.append(ws.astype(np.int32))
            share.append((cnt / max(total, 1)).astype(np.float32))
        grams, sizes = [], []
        for k in range(0, len(words), SOME):  # some at a time, as the driver has little room
            ids, owner = subwords(words[k : k + SOME])
            grams.append(ids[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner).astype(np.int32))
        flat = np.concatenate([*grams, np.zeros(0, np.int32)])
        sizes = np.concatenate([*sizes, np.zeros(0, np.int32)])
        del words, held, grams
        give_back()
        at = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        d, n = self.dims, len(texts)
        # a subword counts by how far its share of documents differs between the classes: one that differs by chance alone is
        # shrunk to next to nothing and can't be learnt by heart, one that differs clearly keeps most of its weight
        spread = np.zeros((2, 1 << BITS), np.float32)
        for ws, v in zip(of, labels):
            cnt = sizes[ws]
            spread[v, np.unique(flat[np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(at[ws], cnt)])] += 1
        size = np.maximum(np.bincount(labels, minlength=2), 1)
        share_all = spread.sum(0) / n
        sd = np.sqrt(share_all * (1 - share_all) * (1 / size[0] + 1 / size[1]))
        odds = (np.abs(spread[1] / size[1] - spread[0] / size[0]) / np.maximum(sd, 1e-9) / self.deviations) ** self.power
        shrunk = odds / (1 + odds)
        shrunk = np.where(shrunk < 1e-3, 0, shrunk).astype(np.float32)  # so little moves no score: spared in the sums
        del spread, odds
        active = np.flatnonzero(shrunk)
        place = np.full(1 << BITS, -1, np.int32)
        place[active] = np.arange(len(active))
        shrunk = shrunk[active]
        flat = place[flat]
        held = flat >= 0
        flat, true_sizes = flat[held], sizes
        at = np.r_[0, np.cumsum(held, dtype=np.int32)][at]
        del held, place
        sizes = np.diff(at).astype(np.int32)
        # each document once as a sparse row: subwords and their shares of it
        rows_of = []
        for ws, sh in zip(of, share):
            cnt = sizes[ws]
            idx = flat[np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(at[ws], cnt)]
            hit, inv = np.unique(idx, return_inverse=True)
            c = np.bincount(inv, np.repeat(sh / np.maximum(true_sizes[ws], 1), cnt), len(hit))
            rows_of.append((hit.astype(np.int32), (self.scale * c * shrunk[hit]).astype(np.float32)))
        del of, share, flat
        give_back()
        E = rng.normal(0, 0.1, (len(active), d)).astype(np.float32)
        W, b = rng.normal(0, 0.5, (d, 2)).astype(np.float32), np.zeros(2, np.float32)
        gE, gW, gb = np.full_like(E, 1e-6), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
        y = np.eye(2, dtype=np.float32)[labels]
        epochs = max(self.epochs, -(-self.steps * self.batch // max(n, 1)))  # few documents are gone through more often
        for epoch in range(epochs):
            rate = self.rate * (1 - epoch / epochs)
            order = rng.permutation(n)
            for k in range(0, n, self.batch):
                rows = order[k : k + self.batch]
                doc = np.repeat(np.arange(len(rows)), [len(rows_of[r][0]) for r in rows])
                hit, inv = np.unique(np.concatenate([rows_of[r][0] for r in rows]), return_inverse=True)
                mix = np.zeros((len(rows), len(hit)), np.float32)
                mix[doc, inv] = np.concatenate([rows_of[r][1] for r in rows])
                own = E[hit]
                h = mix @ own
                z = h @ W + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = (p - y[rows]) * weights[rows, None] / len(rows)
                dE = mix.T @ (g @ W.T) + self.decay * own
                dW, db = h.T @ g, g.sum(0)
                gE[hit] += dE**2
                gW += dW**2
                gb += db**2
                E[hit] -= rate * dE / np.sqrt(gE[hit])
                W -= 0.1 * rate * dW / np.sqrt(gW)
                b -= 0.1 * rate * db / np.sqrt(gb)
        self.subword_scores = np.zeros(1 << BITS, np.float32)  # by bucket; the softmax of two classes needs their difference alone
        self.subword_scores[active] = self.scale * shrunk * (E @ (W[:, 1] - W[:, 0]))
        self.bias = float(b[1] - b[0])
        return self


def logistic(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text: the mean over its words of the mean over their subwords of what the table gives, put through a sigmoid."""
    words, at, n = words_of(pc.fill_null(texts, ""))
    each = np.zeros(len(words))
    for k in range(0, len(words), SOME):
        ids, of = subwords(words[k : k + SOME])
        each[k : k + SOME] = np.bincount(of, table[ids]) / np.bincount(of)
    z = bias + np.bincount(np.repeat(np.arange(len(n)), n), each[at], len(n)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_texts(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) of each row; every word of a text counts, no word scores the bias alone. A null or empty text has no word; repeated
    rows score alike; an empty table gives an empty one; other columns are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model.subword_scores)  # 4 MB, however large the corpus
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logistic(b.column(1), sent.value, bias))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: SubwordModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under `least`. Rows pass through Python whole, so that no join is
    needed; those that go never come back. Odd rows as with score_texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model.subword_scores)
    bias, at = model.bias, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, at):
                yield b.filter(pa.array(logistic(b.column(at), sent.value, bias) < least))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = 3000, most_bytes: int = 64_000_000) -> SubwordModel:
    """Learns from at most `most_per_class` labelled documents of each class, taken in the order of a hash of doc_id, and weighs the
    classes back to their shares among all labels that may be learnt from. What the driver gathers is bounded in bytes too: texts
    of more than a twentieth of `most_bytes` are not learnt from, and each class ends where its texts come to `most_bytes`. Held-out
    ids never take part. Without both classes the model scores every text by the one there is (0 if there are no labels)."""
    y = training_labels(labels, "toxic")
    shares = {r.y: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = SubwordModel()
    model.subword_scores, model.bias = np.zeros(1 << BITS, np.float32), 30.0 if shares.get(1) else -30.0
    if len(shares) < 2:
        return model
    taken = None
    for v in (0, 1):
        some = y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
        taken = some if taken is None else taken.unionByName(some)
    text = text_of()
    # at most 2 * most_per_class rows of two numbers
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(taken), "doc_id").where(F.octet_length("text") <= most_bytes // 20)
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "text", "y").toArrow()
    labels_ = got["y"].to_numpy().astype(np.int64)
    if len(set(labels_)) < 2:
        return model
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable")))  # the same order, however the tasks end
    labels_ = got["y"].to_numpy().astype(np.int64)
    here = np.maximum(np.bincount(labels_, minlength=2), 1)
    weights = np.array([shares[0] / here[0], shares[1] / here[1]])[labels_]
    texts = got["text"].to_pylist()
    del got
    give_back(docs.sparkSession)
    model.fit(texts, labels_, (weights / weights.mean()).astype(np.float32))
    del texts
    give_back(docs.sparkSession)
    return model
