import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidebin.llm import common, linededup, mixing, packing, pii, quality, setjoin, simhash, toxicity, urlfilter, vectors
from tidebin.llm import queries as Q
from tidebin.llm.components import components

SF = "/root/testdata/sf0.001"
TOK = public_tokenizers.path("word_bpe_49k.json")
LINE = "  This is a line that is certainly longer than forty characters.\t"
ODD = [
    (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "a b\n" * 5000, None, "s", 1), (3, "a b\n" * 5000, None, "s", 1), (None, "no id at all here", "en", "t", 2),
    (4, LINE + "\nx", "en", "s", 3), (5, LINE.upper(), "en", "s", 3), (6, LINE.strip(), "en", "s", 3), (7, LINE + "\n" + LINE, "en", "s", 3), (8, "y\n" + LINE + "\nz", "en", "s", 3), (9, "Äß 𝒳 mail a.b@c.de\x1f end", "de", "u", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("fp", "score", "line", "h1", "tokens", "key", "spans", "rep")})


def roots(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# -- components, simhash


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = roots(500, links)
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_definition_and_spark(spark):
    for t in ["", " \n", "One", "a b c d", "A b C d e ÉÈ f", "w x y z " * 40000, "x\x1fy z"]:
        assert simhash.fingerprint(t) == slow_print(t)
    assert spark.sql("SELECT xxhash64('only two')").first()[0] & (2**64 - 1) == simhash.fingerprint("only two")


def test_trie_against_all_pairs():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 2**64, 25, dtype=np.uint64)[rng.integers(0, 25, 3000)]
    for _ in range(4):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    v = np.unique(v)
    got = simhash.trie_forest(v, np.array([0]), np.array([len(v)]), 0, leaf=8)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 4
    want = roots(len(v), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    assert got.tolist() == want


def test_near_links_in_parts(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 2**64, 40, dtype=np.uint64)[rng.integers(0, 40, 800)] ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64))
    v = np.unique(v)
    prints = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64))], "fp long, rep long")
    want = roots(len(v), [(i, j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4) if i < j])
    for rows in (5, 20_000):
        links = [tuple(r) for r in simhash.near_links(prints, bucket_rows=rows).collect()]
        assert roots(len(v), links) == want


def test_simhash_odd(odd):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(odd).collect()}
    assert (2, 1) in got and (3, 3) in got and (4, 4) in got
    assert setjoin.keep_one(odd).columns == odd.columns


def test_keep_one_decides_on_rows(spark):
    x, y, z = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")

    def kept(*rows):
        return sorted(((r.doc_id, r.text) for r in setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    assert kept((None, x), (None, y), (7, y)) == sorted([(None, x), (7, y)], key=str)
    assert kept((1, x), (2, x), (2, y)) == [(1, x), (2, y)]  # a doc_id with two texts loses only the near copy
    assert kept((3, x), (3, x), (None, z), (None, z), (None, z)) == [(3, x), (None, z)]


def test_driver_gives_memory_back(spark, monkeypatch):
    """Every written table lets the driver's JVM return what it has freed; the stages that work longest also let it collect garbage."""
    assert common.trim_jvm(spark)
    collected, trimmed = [], []
    monkeypatch.setattr(common, "trim_jvm", lambda s, f=common.trim_jvm: trimmed.append(f(s)))
    monkeypatch.setattr(setjoin, "give_back", lambda s, f=common.give_back: collected.append(f(s)))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in setjoin.keep_one(docs).collect()} == {1, 3}
    assert len(collected) >= 4 and len(trimmed) > len(collected)


def test_set_join_meets_by_rare_shingles(spark):
    """A shingle in a tenth of all texts, too few to stand out among 65,536 cells, leads no set's first hashes while it has rarer ones."""
    texts = [f"the same five words here {' '.join(f'w{i}x{j}' for j in range(60))}" if i % 10 == 0 else " ".join(f"w{i}x{j}" for j in range(66)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    level = setjoin.levels(df)
    h = np.concatenate([setjoin.sets(pa.array([t]))[0] for t in texts])
    cells = np.bincount((h >> np.uint64(64 - setjoin.CELLS)).astype(np.int64), minlength=1 << setjoin.CELLS)
    assert level.tolist() == (4 * np.log2(1 + cells)).astype(np.uint8).tolist()
    held = Counter(x for r in setjoin.prints(df, level).collect() for x in r.prefix)
    assert max(held.values()) == 1 and len(held) == sum(setjoin.prefix_length(len(setjoin.sets(pa.array([t]))[0])) for t in texts)


def test_pairs_across_groups(monkeypatch):
    """Tasks of few rows (all pairs at once, in pieces) and of many give the same as each pair by itself."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: (k := int(rng.integers(3, 2000)))], rng.integers(0, 2**64, k // 12 + 1, dtype=np.uint64)]) for _ in range(150)]
    sets += [np.unique(np.r_[s[: len(s) - len(s) // 9], rng.integers(0, 2**64, 2, dtype=np.uint64)]) for s in sets]
    rows = sorted((int(rng.choice([1, 2, 3, 4, 4, 4, 4])) if i % 3 else 10 + i // 6, i, int(rng.integers(0, 90)), len(s), setjoin.parity(s).tolist()) for i, s in enumerate(sets))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["task", "node", "grp", "n", "bits"])

    def able(x, y):
        (small, a), (large, b) = sorted(((x[3], x[4]), (y[3], y[4])))
        if x[2] == y[2] or 5 * small < 4 * large or len(b) not in (len(a), 2 * len(a)):
            return False
        if len(b) > len(a):
            b = [p ^ q for p, q in zip(b[: len(a)], b[len(a) :])]
        return 9 * sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(a, b)) <= small + large

    want = {(min(x[1], y[1]), max(x[1], y[1])) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and able(x, y)}
    assert len(want) > 50
    for few, pairs in ((64, 200_000), (64, 7), (1, 7), (10_000, 500)):
        monkeypatch.setattr(setjoin, "FEW", few)
        monkeypatch.setattr(setjoin, "PAIRS", pairs)
        got = [(a, b) for out in setjoin._across(iter([batch.slice(0, 100), batch.slice(100)])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert set(got) == want and len(got) == len(want)


def test_set_join_against_all_pairs(spark):
    """Planted copies at 0.75 to 0.97, of few and many words, chains of them, texts with a long passage in common, and a hash in parts."""
    rng = np.random.default_rng(5)
    texts, passage = [], [f"p{i}" for i in range(60)]
    for n in (3, 5, 7, 9, 30, 80, 200, 700, 1500):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts += [base, list(base), base[:-1]]
        for of in (8, 12, 20, 60):  # each word changed takes up to five shingles of n along
            w = list(base)
            for i in range(0, max(1, n // (5 * of) + 1)):
                w[(i * 37) % n] = f"x{of}"
            texts.append(w)
        chain = list(base)
        for k in range(4):
            chain = chain[max(1, n // 8) :] + [f"c{x}" for x in rng.integers(0, 5000, max(1, n // 12))]
            texts.append(chain)
    texts += [[f"u{x}" for x in rng.integers(0, 5000, 20)] + passage for _ in range(40)]
    texts = [" ".join(w) for w in texts] + [None, "", " "]
    words = [(t or "").lower().split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(h) for h in setjoin.sets(pa.array([t or "" for t in texts]))] == list(map(len, sets))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    assert sum(bin(simhash.fingerprint(texts[i] or "") ^ simhash.fingerprint(texts[j] or "")).count("1") > 4 for i, j in links) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (4096, 7):
        groups = defaultdict(set)
        for r in setjoin.near_groups(df, part_rows=rows).collect():  # a hash in many parts, too
            groups[r.grp].add(r.doc_id)
        assert sorted(map(sorted, groups.values())) == sorted([i for i in range(len(sets)) if want[i] == k] for k in set(want))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df.selectExpr("*", "'en' lang", "'s' source", "1L n_chars"), SF).collect()} == set(want)
    assert setjoin.keep_one(df.limit(0)).count() == 0


def test_maybe_in_misses_nothing(spark):
    keys = spark.range(3000).selectExpr("unhex(md5(cast(id as string))) k")
    rows = spark.range(60_000).selectExpr("id", "unhex(md5(cast(id as string))) key")
    got = {r.id for r in common.maybe_in(rows, "key", keys, "k").where("__maybe").select("id").collect()}
    assert set(range(3000)) <= got and len(got) < 9000
    assert common.maybe_in(rows, "key", keys.limit(0), "k").where("__maybe").count() == 0


def test_shingles_of_slices():
    """A slice of a batch gives what its texts give alone; words end at ASCII white space only, and A-Z alone are lower-cased."""
    texts = ["É à\u00a0b c\x1fd e f", "", "  X y\tz\x0bw\x0cv\r\nu ", "a B c d e F g", "ß", None] * 50
    whole = pa.array([t or "" for t in texts])
    for at in (0, 1, 133):
        got = setjoin.sets(whole.slice(at))
        assert all(np.array_equal(x, setjoin.sets(pa.array([t or ""]))[0]) for x, t in zip(got, texts[at:]))
    same = lambda a, b: np.array_equal(setjoin.sets(pa.array([a]))[0], setjoin.sets(pa.array([b]))[0])
    assert same(" A  b\tC d e ", "a b c d e") and not same("É b", "é b") and not same("a\x1fb", "a b") and not same("a\u00a0b", "a b") and not same("a b", "b a")


# -- lines


def test_line_dedup_equals_sql(spark):
    got = sorted(map(tuple, Q.op5_line_dedup(spark, SF).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(c.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({linededup.SQL})").fetchall())


def test_line_dedup_odd(odd):
    got = {r.doc_id: r for r in linededup.dedup_lines(odd).collect()}
    assert got[8].text == ODD[9][1] and got[8].n_dropped == 0  # the largest id keeps the line
    assert got[7].text == "" and got[7].n_dropped == 2 and got[4].text == "x" and got[1].text == "" and got[1].n_lines == 1
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_runs_anti_join(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    seen = Counter()
    for b in range(5):
        batch = spark.range(b * 10, b * 10 + 30).select((F.col("id") * 0 + b).alias("id"), F.col("id").alias("h1"), F.col("id").alias("h2"))
        assert runs.fresh(batch).count() == sum(x not in seen for x in range(b * 10, b * 10 + 30))
        runs.add(batch)
        seen.update(range(b * 10, b * 10 + 30))
    plan = runs.fresh(batch)._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "SortMergeJoin" in plan and "hashpartitioning(h1" not in plan.split("Scan parquet spark_catalog")[-1]
    assert {r.h1: r.n for r in runs.frequent(3).collect()} == {k: n for k, n in seen.items() if n >= 3}
    assert sum(map(len, runs.levels)) <= 3


def test_line_hash_has_128_bits(spark):
    """The second hash is no function of the first: on lines that share the first one's seed it is XXH64 of another seed."""
    got = spark.createDataFrame([("a",), ("some line",)], "k string").select(linededup.key_hash(F.col("k")).alias("h"), "k").collect()
    seed = xxhash.xxh64_intdigest(b"second", 42)
    for r in got:
        assert r.h.h1 % 2**64 == xxhash.xxh64_intdigest(r.k.encode(), 42) and r.h.h2 % 2**64 == xxhash.xxh64_intdigest(r.k.encode(), seed)
        assert r.h.h2 % 2**64 != xxhash.xxh64_intdigest(b"second", r.h.h1 % 2**64)


def test_line_dedup_rows_of_one_id(spark, monkeypatch):
    """Rows that share a doc_id lose each its own lines; also with frequent lines dealt into shares."""
    line = "a line that is longer than forty characters, surely"
    rows = [(i, f"x\n{line}\ny") for i in range(1, 6)] + [(1, f"{line}\n{line}\nz"), (1, "w"), (9, line)]
    want = sorted([(i, "x\ny") for i in range(1, 6)] + [(1, "z"), (1, "w"), (9, line)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (250_000, 0):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", most)
        assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()) == want


# -- packing


def test_packing_by_another_tokenizer(spark):
    """A tokenizer that doesn't go by words gets whole texts, and gives its own ids."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two words, it's  spaced\n\tout", "", None, "é 中 <|endoftext|> x" * 30]
    tok = Tokenizer.from_file(other)
    assert not packing.by_word(tok) and packing.by_word(Tokenizer.from_file(TOK))
    parts = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), other, size=32).collect():
        parts[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = b"".join(r.ids for r in sorted(parts[i], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [2]


def test_packing_round_trip(spark, odd):
    texts = [(i, t) for i, t in enumerate([r[1] for r in ODD] + ["it's <|endoftext|> They'LL, don't!! a''b ,x", "İstanbul ΣΑΣ é ́x", "a b\x1cc", "x" * 300, "foo's' bar.,.! 12,5%"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tok, parts = Tokenizer.from_file(TOK), defaultdict(list)
    rows = sorted(packing.pack(docs, TOK, size=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64
        at += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32
        parts[r.doc_id].append(r)
    for i, t in texts:
        ids = b"".join(r.ids for r in sorted(parts[i], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [2]
    assert {r.padded for r in rows if r.sequence_id < rows[-1].sequence_id} == {64} and rows[-1].padded & (rows[-1].padded - 1) == 0
    assert packing.pack(docs.limit(0), TOK).count() == 0 and packing.pack(odd, TOK).count() >= len(ODD)


# -- mixing


def test_mixing_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, Q.op6_mixing(spark, SF).collect())) == sorted(c.execute(mixing.SQL).fetchall())


def test_mixing_plan_that_is_not_broadcast(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.with_copies(odd).select("doc_id", "__copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.with_copies(odd).select("doc_id", "__copies").collect())) == want


def test_mixing_targets(spark, odd):
    sizes = [(k, n) for k, n in (("a", 1000), ("b", 100), ("c", 10))]
    totals = spark.createDataFrame(sizes, "key string, tokens long")
    a = mixing.exponent(totals, 4.0, None)
    assert 100 ** (1 - a) <= 4.0 < 100 ** (1 - (a - 1e-4))

    def entropy(x):
        w = np.array([n for _, n in sizes], float) ** x
        w /= w.sum()
        return -(w * np.log(w)).sum()

    e = mixing.exponent(totals, None, 0.8)
    assert entropy(e) >= 0.8 > entropy(e + 1e-4)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).where("doc_id = 2").count() >= 1
    assert mixing.mix(odd.limit(0)).count() == 0


# -- toxicity and quality


def held_rows(spark, df, which):
    return [(r[which], r.score) for r in df.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()]


def test_toxicity_held_out_and_misspelt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), 800)
    few = spark.createDataFrame([(1, "the of and idiiot that moronn stupidd on with the and for was"), (2, "the of and on that with for was"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(few, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] < 0.5
    clash = few.withColumn("score", F.lit("x"))
    kept = toxicity.below(clash, model)
    assert kept.schema == clash.schema and {r.doc_id for r in kept.collect()} == {2, 3, 4}


def test_toxicity_learns_from_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    few = spark.createDataFrame([(1, "the of trash and on that moron with the for was scum"), (2, "the of and on that with for was")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(few, model).collect()}
    assert got[1] > 0.5 > got[2]
    known = toxicity.score_texts(docs, model).join(labels, "doc_id")
    assert known.where("toxic = 1 and score >= 0.5").count() >= 6 and known.where("toxic = 0 and score >= 0.5").count() == 0


def test_toxicity_learns_rare_words():
    rng = np.random.default_rng(2)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(1200)]
    texts = [t + " vilething" * (i % 60 == 0) + " badword" * (i % 60 != 0) for i, t in enumerate(plain[:600])] + plain[600:]  # 10 of 600
    model = toxicity.SubwordModel(epochs=6).fit(texts, np.repeat([1, 0], 600), np.ones(1200, np.float32))
    assert model.subword_scores[toxicity.subwords(["vilething"])[0]].sum() > 0


def slow_score(text, table, bias):
    """The definition, word by word and subword by subword."""
    p, q, m = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 2**64

    def bucket(h):
        return ((h ^ h >> 32) * q % m) >> (64 - toxicity.BITS)

    z = []
    for w in text.lower().split():
        w = f"<{w.strip(toxicity._EDGE) or w}>"
        ids = [bucket(sum(ord(c) * pow(p, i + 1, m) for i, c in enumerate(w)) % m)]
        for n in (3, 4, 5):
            for i in range(len(w) - n + 1):
                h = n
                for c in w[i : i + n]:
                    h = (h * p + ord(c)) % m
                ids.append(bucket(h))
        z.append(sum(float(table[i]) for i in ids) / len(ids))
    z = bias + (sum(z) / len(z) if z else 0.0)
    return 1 / (1 + np.exp(-z))


def test_toxicity_scores_against_brute_force(spark):
    """Scores of every document of sf0.001 by the plain definition, of odd texts too, and the held-out accuracy over sf0.1's held-out rows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    odd = [(-1, None), (-2, ""), (-3, "  \n "), (-4, "Äß 𝒳 -- !!x!! ... é" * 50), (-5, "w" * 30_000)]
    few = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in few.collect()}
    got = {r.doc_id: r.score for r in toxicity.score_texts(few, model).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert abs(got[i] - slow_score(t, model.subword_scores, model.bias)) < 1e-6, i
    held = toxicity.score_texts(docs, model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    right = {y: np.mean([(r.score >= 0.5) == y for r in held if r.toxic == y]) for y in (0, 1)}
    assert len(held) > 300 and right[0] >= 0.99 and right[1] >= 0.9
    assert toxicity.score_texts(few.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 0.5 for r in toxicity.score_texts(odd, toxicity.train(odd, none)).collect()} == {True}
    assert quality.quality_scores(odd, none).count() == len(ODD)


def test_quality_held_out(spark):
    got = held_rows(spark, Q.op3_quality(spark, "/root/testdata/sf0.01"), "quality")
    assert np.mean([(s >= 0.3) == y for y, s in got]) > 0.95


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(2)
    x = {0: rng.normal(0, 2, (300, 3)), 1: rng.normal(1, 1, (500, 3))}
    d = quality.Discriminant().fit({c: float(len(v)) for c, v in x.items()}, {c: v.sum(0) for c, v in x.items()}, {c: v.T @ v for c, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) * len(v) / 800 for v in x.values())
    z = []
    for c, v in x.items():
        s = 0.9 * np.cov(v.T, bias=True) + 0.1 * pooled
        s = 0.99 * s + 0.01 * (np.trace(s) / 3 + 1e-9) * np.eye(3)
        m = v.mean(0)
        z.append(np.log(len(v) / 800) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", x[1] - m, np.linalg.inv(s), x[1] - m))
    assert np.allclose(d.score(x[1]), 1 / (1 + np.exp(z[0] - z[1])))


# -- vectors

VEC = "vec_id long, embedding array<float>, label int, n string"


def clustered(n=260, d=16, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + rng.normal(0, 0.11, (n, d))
    v[200:220] = v[0]
    rows = [(i, [float(x) for x in v[i]], int(i % 3 if i < 200 else 0), "x") for i in range(n)]
    bad = [(900, None, 1, "x"), (901, [0.0] * d, 1, "x"), (902, [float("nan")] + [1.0] * (d - 1), 1, "x"), (903, [None] + [1.0] * (d - 1), 1, "x"), (904, rows[3][1], None, "x"), (905, [1.0, 2.0], 0, "x"), (906, [], 0, "x"), (907, [2 * x for x in rows[0][1]], 0, "x"), (920, [1.0, 2.0], 0, "x")]
    return rows + bad


def test_embedding_groups_against_all_pairs(spark):
    rows = clustered()
    ids = [r[0] for r in rows]
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[2] is None or a[2] != b[2] or any(not r[1] or None in r[1] for r in (a, b)) or len(a[1]) != len(b[1]):
                continue
            x, y = (np.array(r[1], np.float32).astype(float) for r in (a, b))
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((i, j))
    deg, top = Counter(k for p in links for k in p), roots(len(rows), links)
    want = {ids[i]: (deg[i], min(ids[k] for k in range(len(rows)) if top[k] == top[i])) for i in range(len(rows))}
    assert len(links) > 300
    for block in (40, 4096):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.embedding_groups(spark.createDataFrame(rows, VEC), block_rows=block).collect()}
        assert got == want
    assert vectors.embedding_groups(spark.createDataFrame([], VEC)).count() == 0


def test_top_k_against_all_pairs(spark):
    rows = [r for r in clustered() if r[1] and None not in r[1]]
    fit = [(i, np.floor(64 * np.array(e, np.float32).astype(float))) for i, e, *_ in rows if np.isfinite(np.array(e)).all()]
    want = set()
    for i, q in fit:
        if i % 20 == 0:
            s = sorted((-int(q @ v), j) for j, v in fit if j != i and len(v) == len(q))
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s[:20])}
    df = spark.createDataFrame(clustered(), VEC)
    for n, d in ((4, 30), (4096, 16384)):
        assert {tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 20 == 0, query_rows=n, data_rows=d).collect()} == want
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [1e6, 1e15, 1e30])
def test_top_k_of_large_components(spark, scale):
    """Against all pairs in whole numbers, with repeated ids and scores beyond a long."""
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(size=(60, 5)) * scale, rng.normal(size=(60, 5)), -np.abs(rng.normal(size=(4, 5))) * scale]
    rows = [(int(i % 70), [float(x) for x in e], 0, "x") for i, e in enumerate(v)]
    whole = [[int(x) for x in np.floor(64 * np.array(e, np.float32).astype(float))] for _, e, *_ in rows]
    want = Counter()
    for a, (i, *_) in enumerate(rows):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), rows[b][0]) for b in range(len(rows)) if b != a)
            want.update((i, r + 1, j, max(-(2**63), min(-x, 2**63 - 1))) for r, (x, j) in enumerate(s[:20]))
    got = vectors.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, query_rows=3, data_rows=25).collect()
    assert Counter(map(tuple, got)) == want


def test_binary_codes_bounds():
    """The estimate is unbiased within its noise, and the bound never rules out a pair at the threshold."""
    rng = np.random.default_rng(8)
    a = vectors._unit(rng.normal(size=(400, 24)))
    b = vectors._unit(a + rng.normal(0, 0.08, a.shape))
    codes = vectors.BinaryCodes(24)
    turned, code, factor = codes.encode(a)
    other = codes.encode(b)[0]
    est = (vectors.BinaryCodes.signs(code, 24) * other).sum(1)
    true = (a * b).sum(1)
    assert code.shape == (400, 3) and np.allclose((vectors.BinaryCodes.signs(code, 24) * turned).sum(1), factor, atol=1e-5)
    assert abs((est / factor - true).mean()) < 0.02
    assert (est >= vectors.BinaryCodes.least(factor, 0.93))[true >= 0.93].all() and (true >= 0.93).sum() > 50


# -- URLs


def test_url_filter(spark):
    can = '<html><LINK href="http://bad.example.com/en/x" rel="Canonical"></html>'
    ref = "<meta http-equiv='refresh' content='0; url=https://a.org/mid'>"
    rows = [
        (1, "https://a.org/mid#f", can), (2, "http://b.org/q?x=1", ref), (3, "http://www.example.com/en/", can), (4, "http://c.org/", "<p>"), (5, None, can), (6, "nothing", None),
        (7, "https://X.NET/es/1", ""), (8, "http://net/es", ""), (9, "ftp://notnet/es/", ""), (10, "http://shop.com?a", ""), (10, "http://shop.com?a", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"node": F.lit(1), "host": F.lit(2), "verdict": F.lit(3)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[1] == ("a.org", "/mid", None, "block") and got[2][3] == "block"  # over two steps, to a URL that no page has
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4][3] == "allow" and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == (None, "allow") and got[9][2] is None
    assert got[10] == ("shop.com", "", None, "allow")
    more = spark.createDataFrame([("http://c.org/", "http://y.net/fr/1"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=more).collect()}[4] == "block"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_filter_resolves_targets(spark):
    link, fresh = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [
        (1, "http://a.org/x", link % "//a.net/es/"), (2, "http://b.org/d/e", link % "/to"), (3, "http://b.org/to", fresh % "http://q.net/fr/1"),
        (4, "http://b.org/d/f?z", fresh % "../to#k"), (5, "http://b.org/d/", link % "e"), (6, "http://c.org/", link % "/go?u=http://bad.net/es/"),
        (7, "http://d.org/", link % "/p?a=1&amp;b=2"), (8, "http://d.org/p?a=1&b=2", link % "http&#58;//n.net/es/"), (9, "http://e.org/", link % "mailto:x://bad.net/es/"),
        (10, "http://f.org/a", '<base href="//b.org/d/">' + link % "f?z"), (11, "http://g.org", fresh % "?u=http://bad.net/es/"),
    ]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "allow" if i in (6, 9, 11) else "block" for i in range(1, 12)}
    assert urlfilter.resolved("http://h/a/b?c", "../../x/./y/..") == "http://h/x/" and urlfilter.resolved("http://h", "x") == "http://h/x"
    more = spark.createDataFrame([("http://c.org/", "/r"), ("http://c.org/r", "//y.net/fr/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=more).collect()}[6] == "block"


# -- personal data


def luhn(x):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(x)))) % 10 == 0


def base_spans(t):
    find = lambda k, r, ok: [(k, *m.span()) for m in re.finditer(r, t) if ok(re.sub("[^0-9]", "", m[0]), m[0])]
    return [
        *find("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
        *find("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(x) <= 255 for x in m.split("."))),
        *find("card", r"[0-9]([\x20-]?[0-9])+", lambda d, m: 16 <= len(d) <= 19 and luhn(d)),
        *find("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 8 <= len(d) <= 15),
    ]


def test_pii_base_spans(spark):
    texts = [
        None, "", "a.b@c.de", "x@y", "a@b.c@d.e", "a@b.c_x@d.e @x.y", "é😀 q@w.e.r 1.2.3.4.5.6.7.8", "256.1.1.1 0000255.01.2.3 999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713 +1+1 +44.20.7946.0958 +1",
        "9" * 20000, "a" * 20000 + "@", "1 " * 9000, "4465758382889437 4465758382889437", "00000000000000000000256.1.1.1", "1.2.3.4 " * 500,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t and t[:60]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(",")) or not want
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    good = [0.95, 0.9, 0.55, 0.85, 0.6]
    truth = rng.random(4000) < 0.4
    votes = [tuple(int(np.sign((1 if t else -1) * (1 if rng.random() < g else -1))) for g in good) for t in truth]
    _, chance, post = pii.reliabilities(Counter(votes))
    assert np.mean([(post[v] > 0.5) == t for v, t in zip(votes, truth)]) > 0.95
    assert chance[0][1][1] > chance[2][1][1]


def test_classifier_learns_from_features():
    """Form and surroundings tell true spans; the weights follow the posteriors, not the votes."""
    rng = np.random.default_rng(1)
    sums = defaultdict(lambda: (0, 0.0))
    for _ in range(3000):
        f = tuple(int(rng.integers(0, n)) for n in pii.FEATURES)
        n, p = sums[f]
        sums[f] = (n + 1, p + (0.9 if f[5] == 3 or f[0] == 4 else 0.1))
    w = pii.classifier(sums)
    z = {f: w[0][0] + sum(part[i] for part, i in zip(w[1:], f)) for f in sums}
    assert np.mean([(z[f] > 0) == (p / n > 0.5) for f, (n, p) in sums.items()]) > 0.9


def test_pii_obfuscated(spark):
    """Planted data beyond the base expressions is found next to clean look-alikes; recall is counted by document."""
    plain = "the quick brown fox and the lazy dog went over the hill"
    bad = [f"{plain} mail me: jo{i}.doe [at] mail{i} [dot] org thanks" for i in range(30)] + [f"{plain} call 0044 20 79{i} 0958{i} now" for i in range(10, 30)] + [f"{plain} phone (212) 555-01{i} soon" for i in range(10, 30)]
    bad += [f"{plain} host 2001:4860:4860:0:0:0:0:88{i} up" for i in range(10, 20)]
    good = [f"{plain} release 1{i}.2.3 and section 4.{i}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    got = {r.doc_id: r.n_spans > 0 for r in pii.digest(pii.find_pii(df)).collect()}
    assert np.mean([got[i] for i in range(len(bad))]) >= 0.95 and not any(got[i] for i in range(len(bad), len(got)))


def test_pii_many_matches_and_overlaps(spark):
    """A text of 100,000 matches takes seconds; candidates that overlap a base span never come beside it."""
    text = "a1@b.cd 10.0.0.1 " * 50_000
    began = time.time()
    r = pii.digest(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_email, r.n_ip) == (50_000, 50_000) and time.time() - began < 60
    rows = pii.find_pii(spark.createDataFrame([(1, "4111 1111 1111 1111 x@y.z +1 (212) 555-0123 004111 1111 1111 11 212 555 0188 a (at) b.com 5.5.5.5")], "doc_id long, text string")).first().spans
    for x in rows:
        assert x.base or not any(y.base and y.s < x.e and x.s < y.e for y in rows)


# -- all


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > 0.7 * len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_pipeline_stages_take_odd_rows(spark, odd):
    """Each stage by itself on nulls, empty and long texts, repeated rows, a null id, clashing columns and an empty table."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert (got.columns == names) == (name != "packing")
        ids = Counter(r.doc_id for r in got.collect())
        if name in ("toxicity", "line_dedup"):
            assert ids == Counter(r[0] for r in ODD)  # none of these is toxic, and no row goes with its lines
        if name == "simhash_near_dedup":
            assert ids[None] == ids[3] == ids[1] == 1 and ids[2] == 0 and ids[9] == 1
        if name in ("mixing", "packing"):
            assert ids.keys() == {r[0] for r in ODD}
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_quality_and_fingerprints_of_an_empty_table(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.quality_scores(odd.limit(0), labels).count() == 0 and simhash.simhash_groups(odd.limit(0)).count() == 0


def test_simhash_query_against_all_pairs(spark, tmp_path):
    """The whole query on planted texts: fingerprints by their definition, components over all pairs."""
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 900, n)] for n in (1, 3, 4, 30, 200, 900)]
    texts = [" ".join(w) for w in base for _ in range(4)] + [" ".join([*w[: len(w) // 2], f"x{k}", *w[len(w) // 2 :]]) for w in base for k in range(12)] + [None, "", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in Q.op10_simhash_near_dedup(spark, f"file://{tmp_path}").collect()}
    prints = [slow_print(t or "") for t in texts]
    want = roots(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert got == {i: (prints[i], want[i]) for i in range(len(texts))}
