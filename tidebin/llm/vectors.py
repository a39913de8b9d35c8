"""Exact vector operators: near-duplicates by rotated binary codes, and top-k by vector-approximation cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, FloatType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import written
from .components import components
from .simhash import _united


def usable(c: str) -> Column:
    """True for vectors that are not null, not empty and hold neither null nor non-finite components. Doubles of 1e140 or more, whose
    products are not finite either, count as such."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= 1e140))
    return F.coalesce((F.size(c) > 0) & ~bad, F.lit(False))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


class BinaryCodes:
    """Signs of randomly rotated unit vectors, and for each the stored factor c = <code, vector>.

    <code_o, q> / c_o estimates <o, q> without bias. Its error is sqrt(1 - c^2) / c * <e, q> with a unit e at right angles to o,
    and |<e, q>| <= sqrt(1 - <o, q>^2): for pairs at the threshold t this gives the width used here, which is certain, not
    only likely. Pairs whose estimate plus width stays under t need no exact recomputation; all others get one in doubles."""

    def __init__(self, dims: int, seed: int = 11):
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
        self.dims, self.rotation = dims, (q * np.sign(np.diag(r))).astype(np.float64)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, their codes (one bit a component, eight in a byte) and factors."""
        turned = (unit @ self.rotation).astype(np.float32)
        return turned, np.packbits(turned >= 0, axis=1), np.clip(np.abs(turned).sum(1) / math.sqrt(self.dims), 1e-6, 1).astype(np.float32)

    @staticmethod
    def signs(codes: np.ndarray, dims: int) -> np.ndarray:
        return (np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dims))

    @staticmethod
    def least(c: np.ndarray, t: float) -> np.ndarray:
        """The least <code, q> at which estimate plus width reaches t."""
        c = c.astype(np.float64)
        return (c * t - np.sqrt(1 - c**2) * math.sqrt(1 - t * t) - 1e-5).astype(np.float32)


_codes = lru_cache(4)(BinaryCodes)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # first of all, so that no square is too large or too small
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _rows(col: pd.Series, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), width)


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds code, factor and turned to classes; vectors are rotated here once and for all."""
    for whole in batches:
        for dims, b in whole.groupby("dims", sort=False):
            turned, code, factor = _codes(int(dims)).encode(_unit(_matrix(b["embedding"])))
            yield b.drop(columns="embedding").assign(code=[x.tobytes() for x in code], factor=factor, turned=[x.tobytes() for x in turned])


def _survivors(key: tuple, pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """One task: rotated vectors of part i (side 0) against codes of part j (side 1). Returns the classes of either side that have a
    pair whose bound reaches the threshold. At most one row for each row, however many pairs there are."""
    dims = int(key[1])
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if left.empty or right.empty:
        return pdf[:0][["label", "dims", "i", "j", "side", "h1", "h2"]]
    turned = _rows(left["data"], np.float32, dims)
    signs = BinaryCodes.signs(_rows(right["data"], np.uint8, -(-dims // 8)), dims)
    least = BinaryCodes.least(right["factor"].to_numpy(), t)
    mine, theirs = left[["h1", "h2"]].to_numpy(), right[["h1", "h2"]].to_numpy()
    one = key[2] == key[3]
    place = {tuple(h): n for n, h in enumerate(theirs)} if one else {}
    own = np.array([place.get(tuple(h), -1) for h in mine]) if one else None
    a, b = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for k in range(0, len(left), 1024):
        near = turned[k : k + 1024] @ signs.T >= least
        if one:
            near[np.arange(len(near)), own[k : k + 1024]] = False  # not with itself
        a[k : k + 1024] = near.any(1)
        b |= near.any(0)
    return pd.concat([left[a], right[b]])[["label", "dims", "i", "j", "side", "h1", "h2"]]


def _linked(key: tuple, pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """One task: exact cosines, in doubles, between the classes of both sides. Returns for each class that has a link how many members
    of other classes it links to here, and the least class of its group here. Links are counted, never listed."""
    one = key[2] == key[3]
    if one:
        pdf = pdf.drop_duplicates(["h1", "h2"])
    pdf = pdf.sort_values(["rep", "h1", "h2"], ignore_index=True)
    rep, weight, side = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy()
    unit = _unit(_matrix(pdf["embedding"]))
    parent, linked = np.arange(len(rep)), np.zeros(len(rep), np.int64)
    first, second = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for k in range(0, len(first), 1024):
        rows = first[k : k + 1024]
        for m in range(0, len(second), 4096):
            cols = second[m : m + 4096]
            i, j = np.nonzero(unit[rows] @ unit[cols].T >= t - 1e-9)
            i, j = rows[i], cols[j]
            if one:
                i, j = i[i < j], j[i < j]
            sure = np.einsum("ij,ij->i", unit[i], unit[j]) >= t
            i, j = i[sure], j[sure]
            linked += np.bincount(i, weight[j], len(rep)).astype(np.int64) + np.bincount(j, weight[i], len(rep)).astype(np.int64)
            parent = _united(parent, i, j)
    at = np.flatnonzero(linked)
    return pdf.loc[at, ["h1", "h2", "rep"]].assign(linked=linked[at], b=rep[parent[at]])


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, block_rows: int = 4096) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class, so a group of any number of copies is one row in the search. Each class is encoded once,
    and its code, factor and rotated vector are written. Classes of a label are dealt by a hash into parts of about `block_rows`;
    each two parts meet in one task, to which one side sends its rotated vectors and the other its codes and factors alone. Exact
    vectors are fetched only for the classes that have a pair there which the bound could not rule out. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null label, link with nothing; vectors of different lengths
    do not link. A repeated vec_id counts as often as it stands there; rows with a null vec_id are counted but have a null
    component if nothing else is in it. An empty table gives an empty one."""
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fit = usable("embedding") & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    keyed = src.select("vec_id", "label", "embedding", F.when(fit, F.xxhash64("label", "embedding")).alias("h1"), F.when(fit, F.xxhash64(F.lit(1), "embedding", "label")).alias("h2"))
    classes = written(
        keyed.where("h1 is not null").groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by("embedding", "vec_id").alias("embedding"), F.first("label").alias("label"))
        .where("rep is not null").withColumn("dims", F.size("embedding")),
        "classes",
    )
    label = classes.schema["label"]
    sent = classes.select("h1", "h2", "label", "dims", "embedding")
    made = StructType([*(f for f in sent.schema if f.name != "embedding"), StructField("code", BinaryType()), StructField("factor", FloatType()), StructField("turned", BinaryType())])
    codes = written(sent.mapInPandas(_encoded, made), "codes")
    parts = codes.groupBy("label", "dims").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    dealt = codes.join(parts, ["label", "dims"]).withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int"))
    task = ("label", "dims", "i", "j")
    left = dealt.select("label", "dims", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "h1", "h2", "factor", F.col("turned").alias("data"))
    right = dealt.select("label", "dims", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "h1", "h2", "factor", F.col("code").alias("data"))
    kept = StructType([label, *(StructField(c, IntegerType()) for c in ("dims", "i", "j", "side")), StructField("h1", LongType()), StructField("h2", LongType())])
    near = written(left.unionByName(right).groupBy(*task).applyInPandas(lambda k, pdf: _survivors(k, pdf, threshold), kept), "survivors")
    exact = near.join(classes.select("h1", "h2", "rep", "n", "embedding"), ["h1", "h2"])
    found = written(exact.groupBy(*task).applyInPandas(lambda k, pdf: _linked(k, pdf, threshold), "h1 long, h2 long, rep long, linked long, b long"), "found")
    comp = components(found.select(F.col("rep").alias("a"), "b"))
    linked = found.groupBy("h1", "h2").agg(F.sum("linked").alias("linked"))
    known = (
        classes.select("h1", "h2", "rep", "n").join(linked, ["h1", "h2"], "left").join(comp, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    )
    out = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    own = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def _whole(col: pd.Series) -> np.ndarray:
    return np.floor(64.0 * _matrix(col))


def _cells(pdf: pd.DataFrame, cells: int) -> pd.DataFrame:
    """One block: each component's range is cut into `cells` cells of equal whole width. A row keeps one byte a component; the grid (the
    ranges' lower ends, then the widths) is kept with the block's first row."""
    pdf = pdf.sort_values("key", ignore_index=True)
    D = _whole(pdf["embedding"])
    low, high = D.min(0), D.max(0)
    width = np.maximum(np.ceil((high / 2 - low / 2 + 0.5) / cells * 2), 1)
    code = np.clip(np.floor((D - low) / width), 0, cells - 1).astype(np.uint8)
    grid = [np.r_[low, width].tobytes()] + [None] * (len(pdf) - 1)
    return pdf[["dims", "db", "key"]].assign(code=[c.tobytes() for c in code], grid=grid)


def _scan(queries: pd.DataFrame, rows: pd.DataFrame, k: int, cells: int) -> pd.DataFrame:
    """A block of queries against the cells of a block of rows. Cells have one width a component, so that both bounds of all scores
    come from one product and a constant a query. Returns (asker, key, lower, upper) where the upper bound reaches the kth of the
    lower ones."""
    names = ("asker", "key", "lower", "upper")
    if queries.empty or rows.empty:
        return pd.DataFrame({c: np.zeros(0, t) for c, t in zip(names, ("i8", "i8", "f8", "f8"))})
    Q, dims = _whole(queries["embedding"]), int(rows["dims"].iloc[0])
    low, width = np.split(np.frombuffer(next(g for g in rows["grid"] if g is not None)), 2)
    C, key, asker = _rows(rows["code"], np.uint8, dims), rows["key"].to_numpy(), queries["key"].to_numpy()
    most = np.abs(Q) @ (np.abs(low) + width * cells)
    slack = np.where(most < 2**52, 0, most * 2.0**-40)  # whole numbers up to there are exact
    step = np.abs(Q) @ (width * (cells - 1))
    kind = np.float32 if step.max() < 2**24 else np.float64
    C = C.astype(kind).T.copy()
    out = []
    for s in range(0, len(Q), 256):
        q = Q[s : s + 256]
        scan = ((q * width).astype(kind) @ C).astype(np.float64)
        base, one = q @ low, width - 1
        down, up = base + np.minimum(q, 0) @ one - slack[s : s + 256], base + np.maximum(q, 0) @ one + slack[s : s + 256]
        scan[asker[s : s + 256, None] == key] = -np.inf  # never itself
        kth = np.partition(scan, len(key) - k, axis=1)[:, len(key) - k] if len(key) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero((scan + (up - down)[:, None] >= kth[:, None]) & (scan > -np.inf))
        out.append((asker[s + i], key[j], scan[i, j] + down[i], scan[i, j] + up[i]))
    return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out)))))


LONG = 2**63


def inner_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Row by row the exact product of whole-numbered vectors as a long; one beyond a long is held at its nearer end, and its whole
    value comes as 150 bytes that sort like it."""
    most = float((np.abs(a).max(1, initial=0) * np.abs(b).max(1, initial=0) * a.shape[1]).max(initial=0))
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64), [None] * len(a)
    if most < 2**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(1), [None] * len(a)
    full = [sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)]
    beyond = [None if -LONG < x < LONG - 1 else (x + (1 << 1199)).to_bytes(150, "big") for x in full]
    return np.array([min(max(x, -LONG), LONG - 1) for x in full], np.int64), beyond


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for _, b in whole.groupby("dims", sort=False):
            score, beyond = inner_products(_whole(b["asked"]), _whole(b["embedding"]))
            yield b[["asker", "query_id", "key", "vec_id", "upper"]].assign(score=score, beyond=beyond)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 6, query_rows: int = 4096, data_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the highest integer inner product of floor(64 * x), ties to the smaller
    vec_id, the query's own row left out.

    The approximation file holds one byte a component, the cell it lies in; it is made once and written. Blocks of queries meet
    blocks of cells in tasks of bounded size, which bound each score from both sides. Exact vectors are then read in the order of
    the bounds: first each query's k candidates of the highest bounds, whose kth exact score decides which others can still be among
    the first k; these are read next, and no others.

    Vectors that are null, empty or hold null or non-finite components, and rows with a null vec_id, take no part; only vectors of
    one length are compared. Each row is a query or a candidate of its own, also if its vec_id is repeated (its ranks then stand there
    once a row). Scores are exact for components of any size; one beyond a long ranks by its whole value and is given as the nearer
    end of long. An empty table gives an empty one."""
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q")).where(usable("embedding") & F.col("vec_id").isNotNull())
    src = written(src.withColumns({"dims": F.size("embedding"), "key": F.monotonically_increasing_id()}), "vectors")
    n, nq = src.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    qb, db = max(1, -(-nq // query_rows)), max(1, -(-n // data_rows))
    block = lambda of: F.pmod(F.xxhash64("key"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    blocks = src.select("dims", block(db).alias("db"), "key", "embedding").groupBy("dims", "db")
    cells = written(blocks.applyInPandas(lambda pdf: _cells(pdf, 1 << bits), "dims int, db int, key long, code binary, grid binary"), "cells")
    queries = src.where("q").select("key", "embedding", "dims", block(qb).alias("qb"), every(db).alias("db"))
    rows = cells.select("dims", "db", "key", "code", "grid", every(qb).alias("qb"))
    keys = ("dims", "qb", "db")
    scan = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda a, b: _scan(a, b, k, 1 << bits), "asker long, key long, lower double, upper double")
    scan = written(scan, "bounds")
    low = Window.partitionBy("asker").orderBy(F.col("lower").desc(), "key")
    least = scan.withColumn("at", F.row_number().over(low)).where(F.col("at") <= k).groupBy("asker").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    able = scan.join(least, "asker").where((F.col("n") < k) | (F.col("upper") >= F.col("least")))
    order = Window.partitionBy("asker").orderBy(F.col("upper").desc(), "key")
    able = written(able.select("asker", "key", "upper", F.row_number().over(order).alias("at")), "able")

    def exact(pairs: DataFrame) -> DataFrame:
        asked = src.where("q").select(F.col("key").alias("asker"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
        both = pairs.join(src.select("key", "vec_id", "dims", "embedding"), "key").join(asked, "asker")
        return both.select("asker", "query_id", "key", "vec_id", "upper", "dims", "asked", "embedding").mapInPandas(_scored, "asker long, query_id long, key long, vec_id long, upper double, score long, beyond binary")

    first = written(exact(able.where(F.col("at") <= k)), "first")
    sure = first.groupBy("asker").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    edge = F.col("kth").cast("double") - F.abs("kth").cast("double") * 2.0**-40
    rest = able.where(F.col("at") > k).join(sure, "asker").where((F.col("n") < k) | (F.col("kth") == -LONG) | (F.col("upper") >= edge)).select("asker", "key", "upper")
    by = Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "key")
    out = first.unionByName(exact(rest)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
