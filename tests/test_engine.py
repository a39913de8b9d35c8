import shutil

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebin import queries as Q
from tidebin.functions.dialect import date_format, to_spark, trigger_aliases
from tidebin.plans import buckets
from tidebin.plans.model import DAY, TimeRange, Unsupported
from tidebin.plans.sqlfront import canonicalize, parseable, time_step
from tidebin.sparkconf import Placement, Work, derive, integer, memory_split

SF = "/root/testdata/sf0.001"
SPLIT = [n for n, (_, days) in Q.SQL.items() if days is None or days]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


NEW = [
    "group_a_b", "literal_like_dimension", "mixed_case", "gap_union_all", "gap_union", "gap_subquery", "gap_subquery_columns", "time_injection", "commands_refused", "rules_fire", "cache_after_append", "cache_after_late_rows",
    "cache_corrupt_bucket", "cache_two_writers", "join_after_merge", "bounded_fetch", "votes_last", "popular_queries", "sketch_distinct", "sketch_median", "admin_size", "post_nulls_first", *Q.MYSQL,
]


@pytest.mark.parametrize("name", [*NEW, "cache_partial", "cache_vanished_bucket", "agg_avg", "agg_composite_ratio", "ts_2100", "post_order_expr", "filter_time_modulo", "range_reversed_between", "cube_or_filter", "bypass_rollup"])
def test_equals_duckdb(spark, duck, name):
    got = rows(Q.queries()[name](spark, SF))
    assert got == sorted(tuple(map(str, r)) for r in duck.execute(Q.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", SPLIT)
def test_is_split(spark, name):
    """Queries that are meant for the cache are not quietly run directly."""
    q = Q.engine(spark, SF).read(Q.SQL[name][0])[0]
    assert buckets.split(q.span)[1]


def test_split_plan_same_schema_and_pushdown(spark):
    e = Q.engine(spark, SF)
    sql = Q.SQL["agg_avg"][0]
    e.warm(sql, [Q._t(4), Q._t(5)])
    a = e.answer(sql)
    assert a.cached and a.stored == [Q._t(4), Q._t(5)] and len(a.computed) == 2
    assert a.frame.schema.simpleString() == spark.sql(sql).schema.simpleString()
    plan = a.frame._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "PushedFilters" in plan
    assert rows(a.frame) == rows(spark.sql(sql))


def test_cube_reuse(spark):
    e = Q.engine(spark, SF)
    finer, coarse = Q.CUBES["cube_filter_down"]
    e.warm(finer)
    a = e.answer(coarse)
    assert a.cached and len(a.stored) == 18 and not a.computed
    assert rows(a.frame) == rows(spark.sql(coarse))


@pytest.mark.parametrize("sql", [s for n, (s, _) in Q.SQL.items() if n.startswith("bypass")] + [
    "SELECT SUM(value), MEDIAN(value) FROM ev WHERE ts BETWEEN 1 AND 2", "SELECT SUM(value) OVER () AS s FROM ev WHERE ts BETWEEN 1 AND 2", "SELECT COUNT(*) FROM ev WHERE ts > 5", "INSERT INTO ev VALUES (1)",
])
def test_bypass(spark, sql):
    with pytest.raises(Unsupported):
        canonicalize(spark, sql)


def test_not_between_is_no_bound(spark):
    with pytest.raises(Unsupported):
        canonicalize(spark, "SELECT COUNT(*) FROM ev WHERE ts NOT BETWEEN 1 AND 5")


NAMES = st.sampled_from(["a", "b", "ab", "a_b", "aa", "s", "x"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NAMES, min_size=3, max_size=3, unique=True), st.sampled_from(["'{0}'", "'{1} {0}'", "'SUM({2})'", "'it''s {0}'"]), st.booleans())
def test_cached_equals_direct_for_any_names(spark, names, literal, composite):
    """Short names that are parts of each other, of functions and of literals: the cached answer is the direct one."""
    from tidebin.operators.engine import Engine
    from tidebin.sources.catalog import Catalog, Table

    a, b, v = names
    e = Engine(spark, Catalog([Table("named", f"{SF}/events.parquet", (("ts", "unix_seconds(cast(ts as timestamp))"), (a, "event_type"), (b, "user_id % 4"), (v, "value")), "ts", "ts")]))
    text = literal.format(a, b, v)
    item = f"SUM({v}) / COUNT({b}) + MAX({b})" if composite else f"MIN({v})"
    sql = f"SELECT {a}, {b} AS {v}{b}, CASE WHEN {a} = {text} THEN {text} ELSE {a} END AS k, ROUND({item}, 6) AS r FROM named WHERE ts >= {Q._t(3)} AND ts < {Q._t(8, 50)} GROUP BY {a}, {b} HAVING MAX({a}) <> {text}"
    e.warm(sql, [Q._t(4), Q._t(6)])
    got = e.answer(sql)
    assert got.stored == [Q._t(4), Q._t(6)] and rows(got.frame) == rows(spark.sql(sql))


def test_verify_finds_a_difference(spark):
    e = Q.engine(spark, SF)
    sql = Q.SQL["agg_avg"][0]
    e.warm(sql)
    assert e.verify(sql)
    family, root = e.read(sql)[2], e.store.path(e.store.tenant)
    m = e.store.markers(family)[3]
    wrong = spark.read.parquet(f"{root}/{family}/{m.attempt}").where(F.col("bucket_start") == m.start)
    number = next(c for c in wrong.columns if c.startswith("s_"))
    wrong = wrong.withColumn(number, F.col(number) + 1)
    e.store.write(family, wrong, {m.start: m.stamp})
    assert not e.verify(sql)
    assert e.store.vacuum(family) == 0 and len(e.answer(sql).stored) == 18


def test_fetch_gets_over_damaged_files(spark):
    """Files of the right length that hold no Parquet: an answer that is fetched is computed again."""
    from tidebin.sources import files

    e = Q.engine(spark, SF)
    sql = Q.SQL["agg_avg"][0]
    e.warm(sql)
    for f in files.matching(spark, e.store.path(e.store.tenant, e.read(sql)[2], "*", "*.parquet")):
        files.write_text(spark, f.path, "x" * f.length)
    assert len(e.answer(sql).stored) == 18
    want = sorted(tuple(map(str, r)) for r in spark.sql(sql).collect())
    assert sorted(tuple(map(str, r)) for r in e.fetch(sql)) == want and not e.answer(sql).stored


def test_bypass_sees_new_files(spark, tmp_path):
    from tidebin.operators.engine import Engine
    from tidebin.sources.catalog import Catalog, Table

    src = spark.createDataFrame([(Q.T0 + i, i) for i in range(10)], "ts long, v int")
    src.write.parquet(f"file://{tmp_path}/t/a=1")
    e = Engine(spark, Catalog([Table("grown", f"file://{tmp_path}/t", (("ts", "ts"), ("v", "v")))]))
    sql = "SELECT COUNT(DISTINCT v) AS n FROM grown WHERE ts > 5"
    assert not e.answer(sql).cached and e.answer(sql).frame.first().n == 10
    src.withColumn("v", F.col("v") + 5).write.parquet(f"file://{tmp_path}/t/a=2")
    assert e.answer(sql).frame.first().n == 15


def test_known_is_bounded(spark, monkeypatch):
    from tidebin.operators import engine as E

    monkeypatch.setattr(E, "KNOWN", 3)
    e = Q.engine(spark, SF)
    for n in range(5):
        e.read(sql := f"SELECT device, SUM(value + {n}) AS s FROM ev WHERE {Q.W18} GROUP BY device")
        e._know(e.read(sql)[2], *e.read(sql)[:2])
    assert len(e.known) == 3


def test_null_and_text_null_stay_apart(spark, tmp_path):
    from tidebin.operators.engine import Engine
    from tidebin.sources.catalog import Catalog, Table

    t0 = Q.T0
    data = [(t0 + 1, None, 1.0), (t0 + 2, "null", 2.0), (t0 + DAY + 1, None, 1.0), (t0 + DAY + 2, "null", None), (t0 + 2 * DAY, "x", None)]
    spark.createDataFrame(data, "ts long, k string, v double").write.parquet(f"file://{tmp_path}/t")
    e = Engine(spark, Catalog([Table("nulls", f"file://{tmp_path}/t", (("ts", "ts"), ("k", "k"), ("v", "v")))]))
    sql = f"SELECT k, SUM(v) AS s, AVG(v) AS a, COUNT(v) AS n FROM nulls WHERE ts >= {t0} AND ts < {t0 + 3 * DAY} GROUP BY k"
    e.warm(sql, [t0, t0 + DAY])
    a = e.answer(sql)
    assert a.cached and a.stored and rows(a.frame) == rows(spark.sql(sql)) and len(rows(a.frame)) == 3


@settings(max_examples=300, deadline=None)
@given(st.integers(-10 * DAY, 30 * DAY), st.integers(0, 20 * DAY), st.sets(st.integers(-12, 52)))
def test_gaps_partition_the_span(start, length, covered):
    span = TimeRange(start, start + length)
    use, ranges = buckets.gaps(span, {c * DAY for c in covered})
    pieces = sorted([(b, b + DAY - 1) for b in use] + [(r.start, r.end) for r in ranges])
    assert pieces[0][0] == span.start and pieces[-1][1] == span.end
    assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 * DAY), st.integers(1, 5 * DAY))
def test_pyramid_covers(start, length):
    head, days, hours, live = buckets.assemble(start, start + length)
    total = sum(r.end - r.start + 1 for r in (head, live) if r) + DAY * len(days) + 3600 * len(hours)
    assert total == length


def test_front_end_bits(spark):
    assert time_step("CAST((FLOOR((ts / 600)) * 600) AS BIGINT)", "ts") == 600 and time_step("ts", "ts") == 1 and time_step("(ts % 600)", "ts") is None
    assert parseable(spark, "SELECT 1") and not parseable(spark, "SELEC 1 FRO")


def test_dialect():
    assert to_spark("SELECT IFNULL(a, 'IFNULL(x)'), POW(2, 3), LOG(5), LOG(2, 8)") == "SELECT coalesce(a, 'IFNULL(x)'), power(2, 3), ln(5), log(2, 8)"
    assert to_spark("SELECT CAST(a AS SIGNED), STR_TO_DATE(d, '%Y-%m-%d %H:%i:%s')") == "SELECT CAST(a AS BIGINT), to_timestamp(d, 'yyyy-MM-dd HH:mm:ss')"
    assert date_format("%W %j") == "EEEE DDD" and trigger_aliases("NEW.a + OLD.b + 'NEW.c'", "n", "o") == "n.a + o.b + 'NEW.c'"


@given(st.integers(2, 500))
def test_memory_never_oversubscribed(gb):
    assert sum(memory_split(gb).values()) <= max(gb, 2)


def test_settings():
    assert derive(18, 18, Placement.COMPACT)["spark.executor.instances"] == "3"
    assert "spark.memory.offHeap.size" not in derive(18, 18, work=Work.MIXED)
    with pytest.raises(ValueError, match="N must"):
        integer({"N": "x"}, "N", 1)


def test_sketch_bounds(spark):
    from tidebin.functions import sketches as K

    df = spark.range(200_000).groupBy((F.col("id") % 3).alias("g")).agg(K.distinct_sketch("id").alias("h"), K.quantile_sketch("cast(id as double)").alias("k"))
    n, m = df.agg(K.distinct_estimate(K.distinct_union("h")), F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(k), 0.5D)")).first()
    assert abs(n - 200_000) <= 4_000 and abs(m - 100_000) <= 6_000


def test_sketch_distinct_over_many_users(spark, tmp_path):
    """Each type has 20,000 users of its own, seen on a stored day and on one of the gap: no count may be off by more than 2 %."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    types = "(VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) t(k, event_type)"
    seen = f"SELECT make_timestamp(({Q._t(3)} + d * {DAY} + u % 9 * {DAY}) * 1000000) AS ts, k * 1000000 + u AS user_id, event_type FROM range(20000) r(u), (VALUES (0), (9)) s(d), {types}"
    c.execute(f"COPY (SELECT row_number() OVER () AS event_id, ts, user_id, event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM ({seen})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in ("lineitem", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = rows(Q.queries()["sketch_distinct"](spark, f"file://{tmp_path}"))
    assert got == sorted(tuple(map(str, r)) for r in c.execute(Q.oracle_sql()["sketch_distinct"]).fetchall())


def test_stream_stores_closed_buckets(spark, tmp_path):
    from tidebin.streaming.buckets import store_stream

    e = Q.engine(spark, SF)
    sql = Q.SQL["cache_full"][0]
    src = spark.read.parquet(f"{SF}/events.parquet").select("ts").schema
    spark.read.parquet(f"{SF}/events.parquet").select("ts").write.parquet(f"file://{tmp_path}/in")
    q = store_stream(e, sql, spark.readStream.schema(src).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert q.exception() is None
    a = e.answer(sql)
    assert len(a.stored) == 18 and rows(a.frame) == rows(spark.sql(sql))
