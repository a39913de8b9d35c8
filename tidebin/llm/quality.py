"""Quality: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, training_labels, written

NAMES = ("words", "upper", "odd", "stops", "digits", "distinct", "top", "length", "repeats", "per_line", "same_lines", "letters")
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:!?'\"()-")] = True
_ODD = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)]) & ~_PLAIN


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text. Shares are log odds with pseudo-counts, so that short texts lie near the middle."""
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    upper, lower = int(octets[65:91].sum()), int(octets[97:123].sum())
    high = int(octets[192:].sum())  # first bytes of letters beyond ASCII
    letters, odd, stops, digits = upper + lower + high, int(octets[_ODD].sum()), int(octets[_PLAIN].sum()), int(octets[48:58].sum())
    top = max(counts.values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:]))
    odds = lambda k, of, a, b: float(np.log((k + a) / (max(of - k, 0) + b)))
    return [
        float(np.log1p(n)),
        odds(upper, letters, 1, 20),
        float(np.log((odd + 0.5) / (n + 10))),
        float(np.log((stops + 2) / (n + 10))),
        odds(digits, letters + digits, 0.5, 50),
        float(np.log((len(counts) + 5) / (n + 5) ** 0.9)),
        odds(top, n, 2, 30),
        float(np.log((letters + 50) / (n + 10))),
        odds(again, n, 0.3, 20),
        float(np.log((n + 10) / (len(lines) + 1))),
        odds(len(lines) - len(set(lines)), len(lines), 0.3, 10),
        odds(letters, letters + odd + stops + digits, 20, 2),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Gaussian densities of two classes. Each covariance is drawn by `shrink` towards the pooled one and by `ridge` towards its own
    mean variance; its Cholesky factor is worked out once and kept."""

    def __init__(self, shrink: float = 0.1, ridge: float = 0.01):
        self.shrink, self.ridge, self.constant, self.parts = shrink, ridge, 0.0, []

    def fit(self, count: dict[int, float], total: dict[int, np.ndarray], squares: dict[int, np.ndarray]) -> Discriminant:
        """From counts, sums and sums of outer products by class. With one class only, every score is that class's share."""
        n = sum(count.values())
        if len(count) < 2:
            self.constant = 30.0 if count.get(1) else -30.0
            return self
        mean = {c: total[c] / count[c] for c in count}
        cov = {c: squares[c] / count[c] - np.outer(mean[c], mean[c]) for c in count}
        pooled = sum(cov[c] * count[c] / n for c in count)
        for c in (0, 1):
            s = (1 - self.shrink) * cov[c] + self.shrink * pooled
            s = (1 - self.ridge) * s + self.ridge * (np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
            low = np.linalg.cholesky(s)
            self.parts.append((mean[c], np.linalg.inv(low), -np.log(np.diag(low)).sum() + np.log(count[c] / n)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            z = np.full(len(x), self.constant)
        else:
            (m0, f0, k0), (m1, f1, k1) = self.parts
            z = (k1 - 0.5 * (((x - m1) @ f1.T) ** 2).sum(1)) - (k0 - 0.5 * (((x - m0) @ f0.T) ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from every labelled row outside the held-out fold. Only sums by class reach the driver: 2 rows."""
    rows = stats.join(training_labels(labels, "quality"), "doc_id")
    d = len(NAMES)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).collect()
    count, total, squares = {}, {}, {}
    for r in sums:
        y, n, *rest = tuple(r)
        count[y], total[y] = float(n), np.array(rest[:d])
        squares[y] = np.zeros((d, d))
        for (i, j), v in zip(pairs, rest[d:]):
            squares[y][i, j] = squares[y][j, i] = v
    return Discriminant().fit(count, total, squares)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row: the probability of label 1. Texts are read once. Nulls and empty texts score as texts without
    words; repeated rows score alike; an empty table gives an empty one; other columns are not looked at."""
    stats = written(document_statistics(docs), "stats")
    model = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if b.num_rows else np.zeros(0))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
